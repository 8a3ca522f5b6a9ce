"""Exact top-k inner products with a vector-approximation file.

Rows of equal vectors are one class with its k + 1 smallest ids (no query can need more of them), so that a vector which a third of the
rows share is searched once. Classes are packed into blocks; a block's file holds ids and, in one byte per component, the cell of
a grid of ``2**bits`` equal cells per dimension. Exact vectors stay in a table of their own.

1. Cells alone give a lower and an upper bound of the score of every pair of query and class. The (k + 1)th largest lower bound
   over all blocks is a floor for each query.
2. Classes whose upper bound reaches the floor are survivors. Only their exact vectors are fetched. They are read in the order of the
   bound, a few at a time, and reading stops when the (k + 1)th exact score is above every bound that is left.
3. Every query row takes the best k of its vector's list, without itself.

The query set is fixed by the caller (here ids divisible by 20) and is compared with all rows block by block; a block is
bounded in rows, so memory does not depend on the data. Work is queries times rows by nature.

Nulls, ties and repeats: vectors that are null or hold a null, NaN or infinite component, and null ids, take no part. Ties go
to the smaller id. A row is never its query's own result. Of rows that repeat an id, the one with the smallest vector stays. Vectors
of unequal length are compared over the shorter one. With fewer than k candidates all are returned; an empty table gives none. Extra
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged

CELLS = "block long, n int, dim int, ids binary, cells binary, low binary, width binary"
QUERY_BLOCK = "q_block long, q_n int, q_dim int, q_ids binary, q_vectors binary, q_floor binary"


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v): every component is floor(scale * x) as a long; unusable vectors are left out."""
    x = F.col(vec_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def classes_of(rows: DataFrame, most: int) -> DataFrame:
    """(id, v, ids) of each distinct vector: ids are its ``most`` smallest ones in order, id the first of them."""
    order = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("id"), "v", "ids")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows, filled up with zeros to the longest."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    v = np.zeros((len(sizes), int(sizes.max(initial=0))), "<i8")
    v[np.arange(v.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return v


def _packer(bits: int):
    def pack(table: pa.Table) -> pa.Table:
        ids, v = table.column("id").to_numpy().astype("<i8"), _matrix(table.column("v"))
        low = v.min(axis=0).astype("<f8")
        width = (v.max(axis=0) - low) / (1 << bits)
        cells = np.clip(np.floor((v - low) / np.where(width > 0, width, 1)), 0, (1 << bits) - 1).astype(np.uint8)
        row = [table.column("block")[0].as_py(), len(ids), v.shape[1], ids.tobytes(), cells.tobytes(), low.tobytes(), width.tobytes()]
        return pa.table({f.split()[0]: [x] for f, x in zip(CELLS.split(", "), row, strict=True)}, schema=pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), *[(c, pa.binary()) for c in ("ids", "cells", "low", "width")]]))

    return pack


def _query_packer(table: pa.Table) -> pa.Table:
    ids, v, floor = table.column("id").to_numpy().astype("<i8"), _matrix(table.column("v")), table.column("floor").to_numpy().astype("<f8")
    row = [table.column("block")[0].as_py(), len(ids), v.shape[1], ids.tobytes(), v.tobytes(), floor.tobytes()]
    return pa.table({f.split()[0]: [x] for f, x in zip(QUERY_BLOCK.split(", "), row, strict=True)}, schema=pa.schema([("q_block", pa.int64()), ("q_n", pa.int32()), ("q_dim", pa.int32()), *[(c, pa.binary()) for c in ("q_ids", "q_vectors", "q_floor")]]))


def in_blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """``rows`` with block, and how many blocks there are."""
    n = max(1, -(-rows.count() // size))
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n))), n


class Bounds:
    """Bounds of all scores of one block of classes against one block of queries, from cells alone."""

    def __init__(self, r: dict):
        dim = min(r["dim"], r["q_dim"])
        shape = lambda b, t, n, d: np.frombuffer(b, t).reshape(n, d)[:, :dim]
        self.ids, self.q_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
        self.floor = np.frombuffer(r["q_floor"], "<f8")
        low, width = np.frombuffer(r["low"], "<f8")[:dim], np.frombuffer(r["width"], "<f8")[:dim]
        q = shape(r["q_vectors"], "<i8", r["q_n"], r["q_dim"]).astype(np.float64)
        self.middle = q @ (low + (shape(r["cells"], np.uint8, r["n"], r["dim"]) + 0.5) * width).T
        size = np.abs(q)
        self.slack = size @ (width / 2) + 1e-9 * (1 + size @ (np.abs(low) + width * 257))  # and the rounding of the bounds themselves


def _floors(k: int):
    """For every query of a pair of blocks, its k largest lower bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = Bounds(r)
                n = b.middle.shape[1]
                best = b.middle if n <= k else np.partition(b.middle, n - k, axis=1)[:, n - k :]
                low = best - b.slack[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.q_ids, low.shape[1])), pa.array(low.ravel())], names=["query", "low"])

    return run


def _survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            b = Bounds(r)
            high = b.middle + b.slack[:, None]
            q, c = np.nonzero(high >= b.floor[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(b.q_ids[q]), pa.array(b.ids[c]), pa.array(high[q, c])], names=["query", "id", "high"])


def _dot(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    if v.size and float(np.abs(v).max()) * float(np.abs(q).max(initial=0)) * v.shape[1] < 2.0**52:
        return (v.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return v @ q  # whole numbers: exact as long as the score is a long


def _reader(k: int, chunk: int):
    """The best k ids of every query of a group, by exact vectors read in the order of their bounds."""

    def read(table: pa.Table) -> pa.Table:
        query, high = table.column("query").to_numpy(), table.column("high").to_numpy()
        order = np.lexsort((-high, query))
        cut = np.flatnonzero(np.concatenate([[True], query[order][1:] != query[order][:-1], [True]]))
        vectors, members, asked = (table.column(c) for c in ("v", "ids", "q"))
        out: list[tuple[int, int, int]] = []
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            at = order[a:z]
            q = np.array(asked[int(at[0])].as_py(), np.int64)
            best: list[tuple[int, int]] = []
            for j in range(0, len(at), chunk):
                if len(best) == k and -best[-1][0] > high[at[j]]:
                    break
                for i in at[j : j + chunk].tolist():
                    v = np.array(vectors[i].as_py(), np.int64)
                    n = min(len(v), len(q))
                    score = int(_dot(v[None, :n], q[:n])[0])
                    best += [(-score, x) for x in members[i].as_py()]
                best = sorted(best)[:k]
            out += [(int(query[at[0]]), x, -s) for s, x in best]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["query", "vec_id", "score"])

    return read


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 20, block_rows: int = 4096, query_rows: int = 512, bits: int = 6, chunk: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score. ``vectors`` and ``queries`` are (id, v) with whole-number vectors."""
    most = k + 1
    one_each = lambda rows: rows.groupBy("id").agg(F.min("v").alias("v"))
    exact = staged(classes_of(one_each(vectors), most), "vectors")
    asked = staged(one_each(queries), "queries")
    kinds = staged(asked.groupBy("v").agg(F.min("id").alias("id")), "kinds")
    dealt, _ = in_blocks(exact.select("id", "v"), block_rows)
    cells = staged(dealt.groupBy("block").applyInArrow(_packer(bits), CELLS), "cells")
    kinds, n_blocks = in_blocks(kinds, query_rows)

    def pairs(floors: DataFrame) -> DataFrame:
        packed = staged(kinds.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).groupBy("block").applyInArrow(_query_packer, QUERY_BLOCK), "asked")
        return cells.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>"))).join(packed, "q_block")

    lows = pairs(kinds.select("id", F.lit(None).cast("double").alias("floor")).limit(0)).mapInArrow(_floors(most), "query long, low double")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("low")))
    floors = lows.withColumn("nth", nth).where(F.col("nth") <= most).where(F.col("nth") == most).select(F.col("query").alias("id"), F.col("low").alias("floor"))
    left = staged(pairs(staged(floors, "floors")).mapInArrow(_survivors, "query long, id long, high double"), "survivors")
    fetched = left.join(exact, "id").join(kinds.select(F.col("id").alias("query"), F.col("v").alias("q")), "query")
    groups = max(1, n_blocks * query_rows // 64)
    best = fetched.withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups))).groupBy("group").applyInArrow(_reader(most, chunk), "query long, vec_id long, score long")
    rows = asked.select(F.col("id").alias("query_id"), "v").join(kinds.select("v", F.col("id").alias("query")), "v").select("query_id", "query").join(best, "query")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return exact_topk(v, v.where("id % 20 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
