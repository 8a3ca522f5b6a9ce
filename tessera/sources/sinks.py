"""Writers: safe CSV, content-addressed snapshots, manifests and metric tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .scratch import Records


def safe_cell(value: Column) -> Column:
    """A value that no spreadsheet runs as a formula."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.ltrim(text).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def safe_line(df: DataFrame) -> Column:
    quoted = [F.concat(F.lit('"'), F.replace(safe_cell(F.col(c)), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    return F.concat_ws(",", *quoted)


def write_safe_csv(df: DataFrame, path: str) -> None:
    """Quoted lines with a header line in every part file, and in one alone if there is no row. There is no byte-order mark: it would have
    to stand in each part."""
    head = ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)
    if df.isEmpty():
        df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.option("lineSep", "\r\n").text(path)
        return
    lines = df.select(F.monotonically_increasing_id().alias("__id"), safe_line(df).alias("value"))
    first = F.col("__id") % F.lit(1 << 33) == 0  # the first row of a partition, which is a part file
    lines.select(F.when(first, F.concat(F.lit(head + "\r\n"), F.col("value"))).otherwise(F.col("value")).alias("value")).write.option("lineSep", "\r\n").text(path)


def build_manifest(files: DataFrame, item: str, path: str, size: str, modified: str, sha: str) -> tuple[DataFrame, DataFrame]:
    """(rows in the order of item and path, totals per item: files, bytes, last modification)."""
    rows = files.select(F.col(item).alias("item"), F.col(path).alias("path"), F.col(size).alias("bytes"), F.col(modified).alias("modified"), F.col(sha).alias("sha")).orderBy("item", "path")
    return rows, rows.groupBy("item").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified"))


def write_manifest(files: DataFrame, folder: str, **columns: str) -> None:
    rows, totals = build_manifest(files, **columns)
    rows.write.mode("errorifexists").parquet(f"{folder}/rows")
    totals.write.mode("errorifexists").parquet(f"{folder}/totals")


def content_key(df: DataFrame) -> Column:
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def _commits(spark: SparkSession, path: str) -> tuple[Records, int, list[str]]:
    """(commit records, number of the next one, batches that records name, in order)."""
    records = Records(spark, f"{path}/commits")
    names = [n for n in records.names() if n.isdigit()]
    batches = [records.read(n) for n in names]
    return records, int(names[-1]) + 1 if names else 0, [b for b in batches if len(b) == 32]  # a record cut short by a crash names none


def read_snapshot(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Published rows (with content_sha): those of committed batches alone."""
    batches = _commits(spark, path)[2]
    full = StructType([*(f for f in schema.fields if f.name != "content_sha"), StructField("content_sha", StringType())])
    return spark.read.schema(full).parquet(*[f"{path}/rows/{b}" for b in batches]) if batches else spark.createDataFrame([], full)


def write_snapshot(df: DataFrame, path: str, key: str) -> int:
    """Publish rows that are not there yet; equal content is reused, two contents of one key are refused, in the batch too. Rows published.

    A batch is a folder of its own, which readers do not see before its commit record. Records are numbered and created only where there is none: of
    two writers at once one gets the number, the other compares itself with what is there now and takes the next. A job that is
    repeated finds its rows published and adds nothing; what it left without a commit is never read. A row without a key is refused.
    """
    spark = df.sparkSession
    new = df.withColumn("content_sha", content_key(df)).dropDuplicates([key, "content_sha"])
    faults = new.groupBy(key).agg(F.count("*").alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))
    if not faults.isEmpty():
        raise ValueError("a batch holds two contents of one key, or a row without a key")
    batch = uuid.uuid4().hex
    while True:
        records, number, _ = _commits(spark, path)
        old = read_snapshot(spark, path, df.schema).select(F.col(key), F.col("content_sha").alias("old_sha"))
        if not new.join(old, key).where("content_sha <> old_sha").isEmpty():
            raise ValueError("published content differs")
        fresh = new.join(old, key, "left_anti")
        n = fresh.count()
        if not n:
            return 0
        fresh.write.mode("overwrite").parquet(f"{path}/rows/{batch}")
        if records.create(f"{number:012d}", batch):
            return n
        # Another writer was first: look at what it has published.


def verify_manifest(manifest: DataFrame, stored: DataFrame, path: str = "path") -> DataFrame:
    """Mismatches between a manifest and what is stored: missing, unlisted, size or hash."""
    a = manifest.select(path, F.col("bytes").alias("a_bytes"), F.col("sha").alias("a_sha"), F.lit(1).alias("a"))
    b = stored.select(path, F.col("bytes").alias("b_bytes"), F.col("sha").alias("b_sha"), F.lit(1).alias("b"))
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unlisted").when(~F.col("a_bytes").eqNullSafe(F.col("b_bytes")), "size").when(~F.col("a_sha").eqNullSafe(F.col("b_sha")), "hash")
    return a.join(b, path, "full_outer").select(path, kind.alias("problem")).where("problem IS NOT NULL")


def metric_table(summary: DataFrame) -> DataFrame:
    return summary.select(*[F.col(c).cast("double").alias(c) for c in summary.columns]).unpivot([], summary.columns, "metric", "value")
