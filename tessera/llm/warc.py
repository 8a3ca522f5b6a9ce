"""WARC archives written and read with Spark's text source, and verified as chains of record boundaries.

Writing: of equal payloads of at least ``MIN_SHARED`` bytes the smallest page id is a response record and the others are
revisit records that name it. A record is one row of a text file, so Spark writes archives of any size in parallel.

Reading: the archives are split at the record magic wherever it occurs, inside payloads too; Hadoop's line reader deals the
pieces of one file to many tasks. A piece is a candidate record: its offset is the running sum of the lengths before it
and its header gives the offset of its successor. Pointer jumping from offset 0 (each round doubles the length of the
jumps) keeps what can be reached from the start of the file. Pieces that cannot be reached are payload of the reachable
record before them, and are put back into it.

Nulls, ties and repeats: null html is an empty payload; null urls are written empty; a null page id is written and read as
null, and is a response, as are all rows of a payload that only rows without an id have; repeated rows each get a record, those with the
smallest id of their payload responses; an empty table gives no archive and no rows. Extra columns do not matter.

All joins of the chain are merge joins: its tables grow with the archives. The pieces of a torn payload are one value, so they meet
in one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, shared_dir, staged

#: fixed values of the format
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: shorter payloads are written again rather than referred to
MIN_SHARED = 100
#: shared payloads (about 100 bytes each) that are sent to all executors; more of them are joined by a shuffle
BROADCAST_ROWS = 100_000
EMPTY_SHA = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def plan_records(pages: DataFrame) -> DataFrame:
    """Payloads that more than one row has: digest and refers_to, the smallest page id. Only digests and ids are shuffled."""
    thin = pages.select("page_id", F.octet_length("html").alias("n"), F.sha2(F.col("html").cast("binary"), 256).alias("digest")).where(F.col("n") >= MIN_SHARED)
    first = thin.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("rows"))
    return first.where("rows > 1 AND refers_to IS NOT NULL").select("digest", "refers_to")


def _record(payload: Column) -> Column:
    """One record without the last line end, which the text sink writes."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise("")
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(payload)
    return F.concat(
        F.lit(MAGIC),
        F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(payload.cast("binary"), 256))),
        line("WARC-Payload-Length", F.octet_length(payload).cast("string")),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"), body, F.lit("\r\n"),
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files below ``path``."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    shared = staged(plan_records(rows), "shared").withColumnRenamed("digest", "s_digest")
    shared = shared.hint("broadcast" if shared.count() <= BROADCAST_ROWS else "merge")
    same = (F.sha2(F.col("html").cast("binary"), 256) == F.col("s_digest")) & (F.octet_length("html") >= MIN_SHARED)
    refers = F.when(F.col("page_id") != F.col("refers_to"), F.col("refers_to"))
    records = rows.join(shared, same, "left").withColumn("refers_to", refers).select(_record(F.col("html")).alias("value"))
    records.write.option("lineSep", "\r\n").text(path)


@contextmanager
def steady_splits(spark: SparkSession) -> Iterator[None]:
    """Within it, files are cut at the same places whatever executors come or go: the number of cores has no say."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    if before is None:
        spark.conf.set(name, "1")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece that follows the magic: file, part (offset of the read block), seq in that part, body (binary)."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("body"))


def _header(name: str) -> Column:
    got = F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}: *([^\r\n]*)", 1)
    return F.when(got != "", got)


def boundary_table(spark: SparkSession, path: str) -> DataFrame:
    """Candidates without payloads: file, part, seq, start, next, own (payload bytes in this piece), and header fields.

    ``next`` is null where a piece has no readable header.
    """
    c = candidates(spark, path)
    size = len(MAGIC)
    text = F.col("body").cast("string")
    # The header is cut from the string: a position in it counts characters, and the offsets below count bytes.
    c = c.withColumn("n", F.octet_length("body").cast("long")).withColumn("head", F.when(F.contains(text, F.lit("\r\n\r\n")), F.substring_index(text, "\r\n\r\n", 1)))
    c = c.withColumn("length", F.expr("try_cast(regexp_extract(head, '(?i)(?:^|\\r\\n)Content-Length: *([0-9]+)', 1) AS BIGINT)"))
    body_at = F.octet_length("head").cast("long") + 4
    payload = F.substring(F.col("body"), body_at.cast("int") + 1, F.col("length").cast("int"))
    whole = F.col("n") >= body_at + F.col("length")
    c = c.select(
        "file", "part", "seq", "n", "length", body_at.alias("body_at"), whole.alias("whole"),
        F.when(whole, F.sha2(payload, 256)).alias("digest"),
        F.regexp_extract(_header("WARC-Record-ID"), r"page:(-?\d+)", 1).alias("id"), F.regexp_extract(_header("WARC-Refers-To"), r"page:(-?\d+)", 1).alias("ref"),
        _header("WARC-Type").alias("type"), _header("WARC-Payload-Length").alias("claimed_length"), F.regexp_replace(_header("WARC-Payload-Digest"), "^sha256:", "").alias("claimed"),
    )
    c = staged(c, "candidates")
    # The first piece of a file is what stands before the first magic (nothing in a good archive); it counts as if behind one.
    order = Window.partitionBy("file").orderBy("part", "seq")
    past = F.sum(F.col("n") + size).over(order.rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("start", F.coalesce(past, F.lit(0)) - size)
    return c.withColumn("next", F.when(F.col("length").isNotNull() & F.col("type").isNotNull(), F.col("start") + size + F.col("body_at") + F.col("length") + len(END)))


def reachable(chain: DataFrame) -> DataFrame:
    """(file, start) of all candidates on the chain of successors from offset 0, by pointer jumping over (file, start, next)."""
    jump = staged(chain.where("next IS NOT NULL").select("file", "start", "next"), "jump")
    most = jump.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    known = jump.where("start = 0").select("file", "start")
    for k in range(math.ceil(math.log2(most + 1)) if most else 0):
        ahead = known.hint("merge").join(jump, ["file", "start"]).select("file", F.col("next").alias("start"))
        known = staged(known.unionByName(ahead).distinct(), f"known{k}")
        far = jump.select("file", F.col("start").alias("next"), F.col("next").alias("beyond"))
        jump = staged(jump.hint("merge").join(far, ["file", "next"]).select("file", "start", F.col("beyond").alias("next")), f"jump{k}")
    return known


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest, verified: of every reachable record."""
    with steady_splits(spark):
        return _read(spark, path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    table = staged(boundary_table(spark, path), "boundaries")
    good = reachable(table).withColumn("real", F.lit(True))
    marked = table.hint("merge").join(good, ["file", "start"], "left")
    owner = F.last(F.when(F.col("real"), F.col("start")), ignorenulls=True).over(Window.partitionBy("file").orderBy("start"))
    marked = staged(marked.withColumn("owner", owner), "marked")
    records = marked.where("real")
    torn = records.where("not whole").select("file", F.col("start").alias("owner"), F.col("body_at").alias("o_at"), F.col("length").alias("o_length"))
    repaired = spark.createDataFrame([], "file string, start long, fixed string")
    if not torn.isEmpty():
        # Payloads that hold the magic: their pieces are read again, at the same cuts and of the same sizes, and joined in order.
        need = marked.hint("merge").join(torn, ["file", "owner"]).select("file", "part", "seq", "n", "start", "owner", "o_at", "o_length")
        again = candidates(spark, path).withColumn("n", F.octet_length("body").cast("long"))
        bodies = staged(again.hint("merge").join(need, ["file", "part", "seq", "n"]), "torn")
        if bodies.count() != need.count():
            raise RuntimeError("the archives were cut in another way when they were read again")
        whole = bodies.groupBy("file", "owner", "o_at", "o_length").agg(F.array_sort(F.collect_list(F.struct("start", "body"))).alias("pieces"))
        joined = F.aggregate("pieces", F.lit(b"").cast("binary"), lambda acc, x: F.when(F.octet_length(acc) > 0, F.concat(acc, F.lit(MAGIC).cast("binary"), x["body"])).otherwise(x["body"]))
        fixed = F.sha2(F.substring(joined, (F.col("o_at") + 1).cast("int"), F.col("o_length").cast("int")), 256)
        repaired = staged(whole.select("file", F.col("owner").alias("start"), fixed.alias("fixed")), "repaired")
    done = records.hint("merge").join(repaired, ["file", "start"], "left").withColumn("digest", F.coalesce("fixed", "digest"))
    revisit = F.col("type") == "revisit"
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    return done.select(
        number("id").alias("page_id"),
        F.when(revisit, number("claimed_length")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("claimed")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        number("ref").alias("refers_to"),
        F.when(revisit, F.col("digest") == EMPTY_SHA).otherwise(F.col("digest") == F.col("claimed")).alias("verified"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc"
    pages = read_table(spark, sf_dir, "pages")
    write_archives(pages, path)
    records = staged(read_archives(spark, path), "records")
    if records.count() != pages.count():
        raise RuntimeError("records written and records reached from the starts of the files differ")
    return records


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS s, min(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN n >= {MIN_SHARED} AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_SHARED} AND page_id <> m THEN m END AS refers_to, TRUE AS verified FROM q
"""
