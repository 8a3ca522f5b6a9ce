"""Readers of evidence: event logs, range maps, catalogs, claims, listings and archives. Acquisition logs are in ``logs``."""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

EVENT = "session string, seq long, kind string, unix_ms long, elapsed_ms long, data string"


def read_event_log(spark: SparkSession, path: str, schema: str = EVENT) -> tuple[DataFrame, DataFrame]:
    """(events, faults) of JSON-lines session logs. A last line without newline is a torn tail and is only reported; a committed
    line that does not parse is an error. Session files are small by contract, so each is one row."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("lines"))
    lines = files.select("file", F.size("lines").alias("n"), F.posexplode("lines").alias("line", "text"))
    torn = lines.where("line = n - 1 AND text <> ''").select("file", "line", F.lit("torn_tail").alias("fault"))
    whole = lines.where("line < n - 1 AND trim(text) <> ''").withColumn("e", F.from_json("text", schema + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = whole.where("e IS NULL OR e._corrupt IS NOT NULL").select("file", "line", F.lit("malformed").alias("fault"))
    return whole.where("e IS NOT NULL AND e._corrupt IS NULL").select("file", "line", "e.*").drop("_corrupt"), torn.unionByName(bad)


def range_states(ranges: DataFrame, item: str, line: str, state: str, start: str, count: str) -> DataFrame:
    """State per position of overlapping ranges: the last record wins, of equal lines the largest state."""
    each = ranges.where(F.col(count) > 0).select(item, line, state, F.explode(F.sequence(F.col(start), F.col(start) + F.col(count) - 1)).alias("pos"))
    return each.groupBy(item, "pos").agg(F.max_by(F.col(state), F.struct(line, state)).alias(state))


def numbered_passes(lines: DataFrame, file: str, line: str, text: str) -> DataFrame:
    """``lines`` with pass: the number of the START before them; null before the first one and between a STOP and the next START."""
    word = F.upper(F.regexp_extract(text, r"^\s*(START|STOP)\b", 1))
    w = Window.partitionBy(file).orderBy(line)
    begun, ended = F.sum((word == "START").cast("int")).over(w), F.max(F.when(word == "STOP", F.col(line))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    started = F.max(F.when(word == "START", F.col(line))).over(w)
    out = lines.withColumns({"__begun": begun, "__ended": ended, "__started": started})
    inside = (F.col("__begun") > 0) & (F.col("__ended").isNull() | (F.col("__ended") < F.col("__started")))
    return out.withColumn("pass", F.when(inside, F.col("__begun"))).drop("__begun", "__ended", "__started")


def read_range_map(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, state, pass of the record that decides."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    pattern = r"^\s*([CE])\b.*?(\d+)\s*:\s*(\d+)\s*$"
    part = lambda i: F.regexp_extract("text", pattern, i)
    got = numbered_passes(rows, "file", "line", "text").where(F.col("text").rlike(pattern))
    got = got.select("file", "line", F.struct(part(1).alias("state"), "pass").alias("record"), part(2).cast("long").alias("start"), part(3).cast("long").alias("count"))
    return range_states(got, "file", "line", "record", "start", "count").select("file", "pos", "record.state", "record.pass")


def read_attempt_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per attempt, ordered by item and attempt; label is the file's name. Of repeated documents of an attempt the
    one with the smallest label counts."""
    rows = spark.read.option("multiLine", True).schema(schema).json(path).withColumn("label", F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1))
    first = F.row_number().over(Window.partitionBy("disk_number", "attempt_number").orderBy("label"))
    return rows.withColumn("__nth", first).where("__nth = 1").drop("__nth").orderBy("disk_number", "attempt_number")


def read_claims_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with line ends inside fields; a byte-order mark is dropped and a ragged row fails."""
    df = spark.read.option("multiLine", True).option("header", True).option("mode", "FAILFAST").option("escape", '"').csv(path)
    names = [c.lstrip("﻿") for c in df.columns]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("a header repeats a column")
    return df.toDF(*names)


def listing_states(rows: DataFrame, file: str, path: str, size: str, mark: str) -> DataFrame:
    """State of every path (lower case) of a listing; a path that occurs more than once is ambiguous and has no size."""
    state = F.when(F.col(mark).isin("x", "xf"), "deleted").when(F.col(mark).isin(".", "f"), "live").when(F.col(mark).startswith("+."), "signature_carved").otherwise("unknown")
    g = rows.groupBy(file, F.lower(path).alias("path")).agg(F.count("*").alias("__n"), F.min(state).alias("__state"), F.min(size).alias("__size"))
    return g.select(file, "path", F.when(F.col("__n") > 1, 0).otherwise(F.col("__size")).cast("long").alias("bytes"), F.when(F.col("__n") > 1, "ambiguous").otherwise(F.col("__state")).alias("state"))


def safe_relative(name: Column) -> Column:
    """Whether a path stays below its folder and has no empty, dotted, device or control parts."""
    p = F.translate(name, "\\", "/")
    return (F.octet_length(p) <= 4096) & ~p.rlike(r"[:\x00-\x1f\x7f-\x9f]") & ~F.exists(F.split(p, "/"), lambda x: x.isin("", ".", ".."))


@F.pandas_udf(StringType())
def _decoded(content: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        little = b[:2] == b"\xff\xfe" or (len(b) > 8 and not b[1] and not b[3])
        try:
            return b.decode("utf-16-le" if little else "utf-16-be" if b[:2] == b"\xfe\xff" else "utf-8").removeprefix("\ufeff")
        except UnicodeDecodeError:
            return None

    return content.map(one)


def decode_listing(raw: DataFrame) -> DataFrame:
    """``raw`` (file, content) with text: UTF-16 by its mark or by zero bytes in the second and fourth place, else UTF-8. Null if it is
    not what it claims to be (Spark's own decoding fails the job for that)."""
    return raw.withColumn("text", _decoded("content"))


def parse_listing(files: DataFrame, file: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(states of ``listing_states``, refused files with reason) of listings: six columns (the third is the size, the sixth the state), then a path with
    spaces. Lines without a size are headings. A file that is no text (encoding) or has an unsafe path (unsafe_path) is refused whole."""
    line = F.explode(F.split(F.col(text), r"\r?\n")).alias("line")
    pattern = r"^\s*\S+\s+\S+\s+\+?(\d+)\s+\S+\s+\S+\s+(\S+)\s+(\S(?:.*\S)?)\s*$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    rows = files.where(F.col(text).isNotNull()).select(F.col(file).alias("file"), line).where(F.col("line").rlike(pattern))
    rows = rows.select("file", part(1).try_cast("long").alias("size"), part(2).alias("mark"), part(3).alias("name")).where("size IS NOT NULL")
    unsafe = rows.where(~safe_relative(F.col("name"))).select("file", F.lit("unsafe_path").alias("reason")).distinct()
    refused = unsafe.unionByName(files.where(F.col(text).isNull()).select(F.col(file).alias("file"), F.lit("encoding").alias("reason")))
    states = listing_states(rows.withColumn("name", F.translate("name", "\\", "/")).join(unsafe.select("file"), "file", "left_anti"), "file", "name", "size", "mark")
    return states, refused


def read_listing(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    return parse_listing(decode_listing(raw), "file", "text")


def binary_cells(spark: SparkSession, path: str, size: int) -> DataFrame:
    """pos, cell, sha of the cells of ``size`` bytes (128 to 4096) of one file, which may be too large for a row: Spark reads its fixed-length
    records in splits. A file that does not end with a whole cell is refused; an empty one has no cells."""
    if not 128 <= size <= 4096:
        raise ValueError("cells have 128 to 4096 bytes")
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).getLen() % size:
        raise ValueError("the last cell is not whole")
    records = spark.sparkContext.binaryRecords(path, size).zipWithIndex().map(lambda x: (x[1], bytearray(x[0])))
    return spark.createDataFrame(records, "pos long, cell binary").withColumn("sha", F.sha2("cell", 256))


def hash_inventory(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return df.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha"))


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = []
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            try:
                                rows.append((path, m.filename, m.file_size, hashlib.sha256(z.read(m)).hexdigest(), None))
                            except (zipfile.BadZipFile, NotImplementedError, RuntimeError, OSError, zlib.error) as e:
                                rows.append((path, m.filename, m.file_size, None, f"member: {e}"))
            except (zipfile.BadZipFile, ValueError, OSError) as e:
                rows = [(path, None, None, None, f"archive: {e}")]
            yield pd.DataFrame(rows, columns=["archive", "name", "bytes", "sha", "error"]).astype({"bytes": "Int64"})


def archive_inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row per ZIP member, with flags for unsafe names and for names that differ by case alone. A damaged archive or member is a row
    with an error and without a hash; it does not stop the others."""
    got = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_members, "archive string, name string, bytes long, sha string, error string")
    unsafe = F.col("name").rlike(r"^(/|\\|[A-Za-z]:)") | F.exists(F.split(F.translate("name", "\\", "/"), "/"), lambda x: x.isin("..", "."))
    return got.withColumn("unsafe", unsafe).withColumn("collides", F.count("*").over(Window.partitionBy("archive", F.lower("name"))) > 1)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("kind string, units long, elapsed_ms long, workers long, unix_ms long").json(path)
    return df.where("kind IS NOT NULL AND units > 0 AND elapsed_ms > 0 AND workers > 0")
