"""Token ids in ORC: run-length encoded integers in stripes, with row indexes and Bloom filters on document ids.

1. Rows are dealt into ranges of (document id, hash of the text) and sorted, so that files and stripes hold disjoint ranges of
   ids. Each task tokenizes its range in order and adds to every row its range and how many ids of the range stand before it.
2. Spark's ORC writer keeps id columns and the ids of all tokens as run-length encoded integers. A stripe ends at ``STRIPE_BYTES``; it holds minima,
   maxima and a Bloom filter of the document ids for every ``STRIDE`` rows.
3. Readers take files and stripes in parallel. Totals per range come from the two narrow columns; their running sum (one row a
   range) gives each document its place in the whole. A lookup by ids is pushed down: minima and maxima drop stripes and rows, Bloom
   filters those that lie between.

Nulls, ties and repeats: null text is empty and has the end id alone; null ids come first; rows that repeat an id follow each other in the order of
the hash of their text, then of the text; rows that repeat both are rows of their own. A very long text is one row. Extra columns are
dropped. An empty table gives no rows. Memory holds one batch of texts and one text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, shared_dir, text_chunks
from .packing import CHUNK, TOKENIZER, _tokenizer

STORED = "doc_id long, range int, before long, n_tokens long, tokens array<int>"
STRIPE_BYTES = 16 << 20
#: rows of a row group: the least that ORC allows
STRIDE = 1000
#: share of ids that a Bloom filter lets through in error
FPP = 0.01


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, before = _tokenizer(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, data, offs in text_chunks(batch, "text", CHUNK):
                ids, bounds = tok(data, offs)
                n = len(bounds) - 1
                tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(before + bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()), tokens], names=[x.split()[0] for x in STORED.split(", ")])
                before += int(bounds[-1])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str) -> None:
    """Write the ids of every row of ``docs`` (doc_id, text) as ORC. ``tokenizer``: its file, at the same place on every executor."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("__hash", F.xxhash64("text"))
    ranges = rows.repartitionByRange("doc_id", "__hash").sortWithinPartitions("doc_id", "__hash", "text")
    encoded = ranges.select("doc_id", "text").mapInArrow(_encode(tokenizer), STORED)
    options = {"compression": "zstd", "orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": STRIDE, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FPP}
    encoded.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Stored rows with start, the ids of all documents before them. ``doc_ids``: read only these, by metadata where it can tell."""
    stored = spark.read.schema(STORED).orc(path)
    totals = stored.groupBy("range").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select("range", first.alias("__first"))  # one row for each task that wrote
    wanted = stored if doc_ids is None else stored.where(F.col("doc_id").isin(doc_ids))
    return wanted.join(F.broadcast(starts), "range").withColumn("start", F.col("__first") + F.col("before")).drop("__first")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens = batch.column("tokens")
        flat, cut = tokens.values.to_numpy(zero_copy_only=False).astype("<u4"), tokens.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned little-endian 32-bit numbers) of rows of ``read_tokens``."""
    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens"
    write_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), path)
    return checksums(read_tokens(spark, path))
