"""Acquisition logs as tables: one fold over the lines of every file, with rules that hold across records.

Both kinds of log give (records, positions, refused): one row per accepted file, one row per position of an accepted file, and
the files that break a rule, with the line and reason of the first fault. Nothing is gathered by file; a file's lines meet in aggregates, and
only its few lines with cross-record rules are ranked.

Nulls and repeats: null lines are empty; of repeated line numbers the larger text counts as later; lines of no known kind are skipped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import tasks_for

#: fixed values: kinds of records, words of status, and the bounds and reason of a range that was not read on purpose
RETRY_FAILED = ("SECTOR_READ_FAILED", "SECTOR_RETRY_FAILED", "READ_RETRY", "RETRY")
RECOVERED = ("SECTOR_RECOVERED_AFTER_RETRY", "RETRY_RECOVERED", "RECOVERED")
STATUS = {"OK": ("OK", "SUCCESS", "COMPLETE"), "PARTIAL": ("PARTIAL",), "DERIVED": ("DERIVED",), "FAILED": ("FAILED", "FAIL", "ERROR"), "IN PROGRESS": ("IN PROGRESS", "IN_PROGRESS", "RUNNING")}
HANDOFF_REASON, MOST_RETRIES, LAST_POSITION = "usb_fast_handoff", 2, 8192
GEOMETRY = ("cylinders", "heads", "sectors_per_track", "bytes_per_sector", "total_sectors", "total_bytes")
#: numbers that have to fit into 32 bits
NARROW, WIDEST = ("heads", "sectors_per_track", "bytes_per_sector"), 0xFFFFFFFF


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0), text of small text files, each of which is one row of the scan."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))


def without_stamp(text: Column) -> Column:
    """A line without its ``[stamp] `` or ``YYYY-MM-DD h:m:s`` in front."""
    line = F.trim(F.coalesce(text, F.lit("")))
    bare = F.regexp_replace(line, r"^\[.*?\] ", "")
    dated = F.regexp_replace(line, r"^\S{4}-\S{2}-\S{2}\s+\S*:\S*\s*", "")
    return F.trim(F.when(line.startswith("["), bare).when(line.rlike(r"^\S{4}-\S{2}-\S{2}\s+\S*:"), dated).otherwise(line))


def parse_status(word: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for label, words in STATUS.items() for w in words for x in (w, label)])
    return F.coalesce(F.try_element_at(labels, F.upper(F.trim(word))), F.lit("UNKNOWN"))


def parse_number(word: Column) -> Column:
    """A whole number of digits alone; null for others and those beyond a long."""
    return F.regexp_extract(word, r"^\s*\+?([0-9]+)\s*$", 1).try_cast("long")


def _at_most(number: str, most: int) -> Column:
    return F.when(F.col(number) <= most, F.col(number))


def _hash_in(text: str) -> Column:
    return F.lower(F.nullif(F.regexp_extract(text, "(?<![0-9A-Fa-f])([0-9A-Fa-f]{64})(?![0-9A-Fa-f])", 1), F.lit("")))


def log_records(lines: DataFrame, file: str, line: str, text: str) -> DataFrame:
    """file, line, kind, body of ``KIND | k=v | k=v`` and ``KIND k=v k=v`` lines; ``field`` reads the values of a body."""
    rows = lines.select(F.col(file).alias("file"), F.col(line).cast("long").alias("line"), without_stamp(F.col(text)).alias("body"))
    return rows.withColumn("kind", F.upper(F.regexp_extract("body", r"^[^|:\s]*", 0)))


def field(name: str) -> Column:
    """The last value of a key (case ignored) in a body; null without one."""
    return F.try_element_at(F.regexp_extract_all("body", F.lit(rf"(?i)[|\s]{name}=([^|\s]*)"), F.lit(1)), F.lit(-1))


def fold_log(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row per accepted file, its damaged positions, refused files) of ``log_records``.

    The last END decides the status (IN PROGRESS without one). A position that was not read on purpose (unread) counts as bad; such a range needs
    one policy of at most two retries, the status PARTIAL, an end at the geometry's total and no position in common with the bad ones.
    Reasons: duplicate_policy, policy_budget, range_start, range_end, range_invalid, in the order of their lines; then unrecognized, unsupported_range.
    """
    kind, order = F.col("kind"), F.struct("line", "body")
    last = lambda value: F.max_by(value, F.when(value.isNotNull(), order))
    known = ("USB_HANDOFF_POLICY", "UNREAD_RANGE", "BEGIN", "GEOMETRY", "BAD_SECTOR", "END", *RETRY_FAILED, *RECOVERED)
    hashed = kind.isin("SHA256", "SHA-256") | (~kind.isin(*known) & F.upper("body").rlike("^SHA-?256="))

    rare = records.where(kind.isin("USB_HANDOFF_POLICY", "UNREAD_RANGE"))
    retries = F.when(kind == "USB_HANDOFF_POLICY", parse_number(field("retries")))
    first, end = (F.when(kind == "UNREAD_RANGE", parse_number(field(x))) for x in ("first", "end_exclusive"))
    nth = F.row_number().over(Window.partitionBy("file", "kind").orderBy("line", "body"))
    rare = rare.withColumns({"__retries": retries, "__first": first, "__end": end, "__cause": field("reason"), "__nth": nth})
    rare = rare.withColumn("policy_retries", _at_most("__retries", MOST_RETRIES))
    policy = F.when(F.col("__nth") > 1, "duplicate_policy").when(F.col("policy_retries").isNull(), "policy_budget")
    wrong = (F.col("__first") >= F.col("__end")) | (F.col("__end") > LAST_POSITION) | ~F.col("__cause").eqNullSafe(F.lit(HANDOFF_REASON)) | (F.col("__nth") > 1)
    ranged = F.when(F.col("__first").isNull(), "range_start").when(F.col("__end").isNull(), "range_end").when(wrong, "range_invalid")
    fault = F.when(kind == "UNREAD_RANGE", ranged).otherwise(policy)
    special = rare.withColumn("__fault", fault).groupBy("file").agg(
        F.min_by(F.struct("line", F.col("__fault").alias("reason")), F.when(F.col("__fault").isNotNull(), order)).alias("f"), F.max("policy_retries").alias("policy_retries"), F.max("__first").alias("__first"), F.max("__end").alias("__end")
    ).select("file", "f.line", "f.reason", "policy_retries", "__first", "__end")

    own = F.lower(F.regexp_extract(F.coalesce(field("sha256"), F.lit("")), "^[0-9A-Fa-f]{64}$", 0))
    found = F.when(kind == "END", F.coalesce(F.nullif(own, F.lit("")), _hash_in("body"))).when(F.col("__hashed"), _hash_in("body"))
    end_of = F.when(kind == "END", F.struct("line", "body", parse_status(field("status")).alias("status")))
    marked = records.withColumn("__hashed", hashed).withColumns({"__found": found, "__end": end_of, "__class": F.when(kind.isin(*RETRY_FAILED), "failed").when(kind.isin(*RECOVERED), "recovered").when(kind.isin(*known) | F.col("__hashed"), kind)})
    counted = marked.groupBy("file").agg(
        F.count("__class").alias("__records"), F.max("__end").alias("__last_end"), F.count_if(F.col("__class") == "failed").alias("retry_failures"),
        F.count_if(F.col("__class") == "recovered").alias("__recovered"), last(F.col("__found")).alias("sha256"), (F.count_if(F.col("__class") == "BEGIN") > 0).alias("begin_seen"),
    )

    # One row a pair of key and value; of a key that a line repeats the last one.
    pair = F.explode(F.regexp_extract_all("body", F.lit(r"(?i)[|\s]([^|\s=]+)=[^|\s]*(?!.*[|\s]\1=)"), F.lit(0)))
    pairs = records.where(kind.isin("BEGIN", "GEOMETRY", "END")).select("file", "line", "body", "kind", pair.alias("pair"))
    pairs = pairs.select("file", "line", "body", "kind", F.lower(F.substring(F.substring_index("pair", "=", 1), 2, 1 << 20)).alias("key"), F.regexp_replace("pair", "^[^=]*=", "").alias("value"))
    pairs = pairs.withColumn("n", parse_number(F.col("value"))).withColumn("narrow", _at_most("n", WIDEST)).withColumn("__at", F.struct("line", "body", F.col("key").isin("disk", "retry_recovered")))

    def value(kind_: str, column: str, *keys: str) -> Column:
        """Of the last line of a kind that has one of the keys with such a value; disk and retry_recovered go before their other names."""
        mine = (kind == kind_) & F.col("key").isin(*keys) & F.col(column).isNotNull()
        return F.max_by(column, F.when(mine, F.col("__at")))

    named = pairs.groupBy("file").agg(
        value("BEGIN", "narrow", "disk", "floppy").alias("disk"), value("BEGIN", "narrow", "attempt").alias("attempt"), value("BEGIN", "value", "source").alias("source"),
        *[value("GEOMETRY", "narrow" if g in NARROW else "n", g).alias(g) for g in GEOMETRY],
        value("END", "n", "retry_recovered", "recovered_after_retry").alias("__claimed"), value("END", "n", "bytes").alias("bytes_written"),
    )
    folded = counted.join(named, "file", "left").join(special, "file", "left")
    folded = folded.withColumns({"status": F.coalesce("__last_end.status", F.lit("IN PROGRESS")), "end_seen": F.col("__last_end").isNotNull(), "retry_recovered": F.coalesce("__claimed", "__recovered")})
    number = lambda *names: F.coalesce(*[parse_number(field(n)) for n in names])
    digits = F.regexp_extract("body", "[0-9]+", 0)
    at = F.coalesce(number("lba", "sector"), digits.try_cast("long"))
    bad = records.where(kind == "BAD_SECTOR").select("file", at.alias("pos")).where("pos IS NOT NULL").distinct()

    # Files with a range are few; their bad positions meet it once.
    ranges = special.where("__first IS NOT NULL AND __end IS NOT NULL").select("file", "__first", "__end")
    shared = bad.join(ranges, "file").where("pos >= __first AND pos < __end").groupBy("file").agg(F.count("*").alias("__shared"))
    judged = folded.join(shared, "file", "left")
    lacks = F.col("policy_retries").isNull() | (F.col("status") != "PARTIAL") | ~F.col("total_sectors").eqNullSafe(F.col("__end")) | F.col("__shared").isNotNull()
    reason = F.coalesce("reason", F.when(F.col("__records") == 0, "unrecognized"), F.when(F.col("__end").isNotNull() & lacks, "unsupported_range"))
    judged = judged.withColumn("reason", reason)
    fine = judged.where("reason IS NULL")
    unread = fine.where("__end IS NOT NULL").select("file", F.explode(F.sequence("__first", F.col("__end") - 1)).alias("pos"), F.lit("unread").alias("state"))
    positions = bad.join(judged.where("reason IS NOT NULL").select("file"), "file", "left_anti").select("file", "pos", F.lit("bad").alias("state")).unionByName(unread)
    counts = positions.groupBy("file").agg(F.count("*").alias("bad_positions"), F.count_if(F.col("state") == "unread").alias("unread_positions"))
    columns = ("file", "status", "disk", "attempt", "source", *GEOMETRY, "policy_retries", "retry_failures", "retry_recovered", "bytes_written", "sha256", "begin_seen", "end_seen")
    out = fine.select(*columns).join(counts, "file", "left").fillna(0, ["bad_positions", "unread_positions"])
    return out, positions, judged.where("reason IS NOT NULL").select("file", "line", "reason")


def map_log(lines: DataFrame, file: str, line: str, text: str, most_records: int | None = 65_536, end: int | None = 1_048_576, most_positions: int | None = 2_097_152) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row per accepted file, final state of its positions, refused files) of ``C|E n > > start : count`` logs.

    A pass is what lies between two of START and STOP; it goes in the direction of its first record. A START without its STOP is in progress; else
    the log is OK without a position whose last state is E. A record with a fault refuses its file, as do more records, positions
    or a further end than the three bounds allow (None: no bound). Reasons: row, direction, number, bound; then no_records.
    Line numbers lie below 2^62. ``lines`` are counted first, so that what is costly to make should be written before.
    """
    clean = F.trim(F.regexp_replace(F.trim(F.coalesce(F.col(text), F.lit(""))), "^﻿+", ""))

    def parsed(words: Column, whole: Column) -> Column:
        word = lambda i: F.try_element_at(words, F.lit(i))
        mark = F.when(F.upper(whole).startswith("START "), "start").when(F.upper(whole).startswith("STOP "), "stop")
        start, count = parse_number(word(5)), parse_number(word(7))
        direction = F.when((word(3) == ">") & (word(4) == ">"), "forward").when((word(3) == "<") & (word(4) == "<"), "reverse")
        state = F.when(mark.isNull() & word(1).isin("C", "E"), word(1))
        sector = F.when(whole.startswith("logsec="), parse_number(F.substring_index(whole, "=", -1)))
        return F.struct(
            whole.alias("text"), mark.alias("mark"), sector.alias("sector"), state.alias("state"), direction.alias("direction"), start.alias("start"), count.alias("count"),
            ((F.size(words) >= 7) & word(6).eqNullSafe(F.lit(":"))).alias("row"),
        )

    # Each line is split and matched once, before its file is dealt to one task; all branches read the few columns that this gives.
    once = F.transform(F.array(clean), lambda x: F.transform(F.array(F.split(x, r"\s+")), lambda w: parsed(w, x))[0])
    rows = lines.select(F.col(file).alias("file"), F.col(line).cast("long").alias("line"), F.inline(once)).repartition(tasks_for(lines), "file")
    fault = F.when(~F.col("row"), "row").when(F.col("direction").isNull(), "direction").when(F.col("start").isNull() | F.col("count").isNull() | (F.col("count") == 0), "number")
    if end is not None:
        fault = F.coalesce(fault, F.when(F.col("start").cast("decimal(38,0)") + F.col("count") > end, "bound"))
    rows = rows.withColumn("fault", F.when(F.col("state").isNotNull(), fault)).withColumn("good", F.col("state").isNotNull() & F.col("fault").isNull())
    # A log's passes follow its lines; logs are small by contract. All sums over a file follow the same order of its lines.
    of_file = Window.partitionBy("file").orderBy("line", "text")
    whole = of_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    good = lambda value: F.when(F.col("good"), value)
    first = F.first(F.when(F.col("fault").isNotNull(), F.struct("line", F.col("fault").alias("reason"))), ignorenulls=True)
    rows = rows.withColumn("pass", F.count("mark").over(of_file)).withColumns({
        "starts": F.count_if(F.col("mark") == "start").over(whole), "stops": F.count_if(F.col("mark") == "stop").over(whole), "sector_size": F.last("sector", ignorenulls=True).over(whole),
        "records": F.count_if(F.col("good")).over(whole), "positions": F.sum(good(F.col("count"))).over(whole), "end": F.max(good(F.col("start") + F.col("count"))).over(whole), "f": first.over(whole),
        "__nth": F.row_number().over(of_file),
    })
    over = [F.col(c) > most for c, most in (("records", most_records), ("positions", most_positions)) if most is not None]
    late = F.when(F.col("records") == 0, "no_records")
    late = late.when(reduce(lambda a, b: a | b, over), "bound") if over else late
    judged = rows.withColumn("reason", F.coalesce("f.reason", late))
    refused = judged.where("__nth = 1 AND reason IS NOT NULL").select("file", F.col("f.line").alias("line"), "reason")
    kept = judged.where("reason IS NULL AND good")
    # A file's first line and the first record of each of its passes carry what is counted once; C and E of one line are told apart by the last bit.
    opens = F.coalesce(F.lag("pass").over(of_file) != F.col("pass"), F.lit(True))
    code = F.shiftleft(F.coalesce("line", F.lit(-(1 << 61))), 1) + (F.col("state") == "E").cast("long")
    coded = kept.select("file", "starts", "stops", "sector_size", "end", "start", "count", code.alias("code"), *[(opens & (F.col("direction") == w)).cast("long").alias(w) for w in ("forward", "reverse")])
    at = F.posexplode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("__i", "pos")
    each = coded.select("file", "starts", "stops", "sector_size", "end", "code", "forward", "reverse", at)
    first = F.col("__i") == 0
    kept_once = [F.max(c).alias(c) for c in ("starts", "stops", "sector_size", "end")]
    last = each.groupBy("file", "pos").agg(F.max("code").alias("code"), *[F.sum(F.when(first, F.col(w))).alias(w) for w in ("forward", "reverse")], *kept_once)
    bit = F.col("code") % 2 == 0
    states = last.select("file", "pos", F.when(bit, "C").otherwise("E").alias("state"))
    out = last.groupBy("file").agg(F.count_if(bit).alias("copied"), F.count_if(~bit).alias("bad"), *[F.coalesce(F.sum(w), F.lit(0).cast("long")).alias(w) for w in ("forward", "reverse")], *kept_once)
    status = F.when(F.col("starts") > F.col("stops"), "IN PROGRESS").when(F.col("bad") == 0, "OK").otherwise("PARTIAL")
    out = out.select("file", status.alias("status"), "sector_size", F.greatest(F.col("forward") + F.col("reverse"), "starts").alias("passes"), "forward", "reverse", "copied", "bad", F.col("end").alias("highest"), "starts", "stops")
    return out, states, refused


def read_kv_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fold_log(log_records(text_lines(spark, path), "file", "line", "text"))


def read_map_log(spark: SparkSession, path: str, **bounds: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    return map_log(text_lines(spark, path), "file", "line", "text", **bounds)
