"""Exact corpus counts of hashed keys, returned to the texts that asked for them.

Texts are dealt into blocks of bounded size by a hash. A block sends each of its distinct keys once, with how often it has it, to
one of the buckets of the key space (the map-side combine: a key that every text holds is one entry per block). A bucket
adds up, and answers every block with counts in the order of its keys, so that the answer needs no keys. Keys and
counts travel as packed arrays.

Adding up is a tree. A bucket takes what ``fan`` blocks sent, and with more blocks than that its distinct keys and sums go on to the
next level as a block would have sent them, in finer buckets; the totals come back the same way. So a block writes to
a bounded number of buckets, a key of all texts is one entry per ``fan`` blocks at the next level, a task holds about the keys of
``BLOCKS_A_BUCKET`` blocks at every level, and rows grow with the number of blocks. The totals do not depend on the depth.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import pack_counts, pack_sorted, unpack_counts, unpack_sorted

REQUESTS = "kind int, bucket int, block long, n int, keys binary, weights binary"
ANSWERS = "kind int, bucket int, block long, n int, counts binary, distinct long, total long"
#: a bucket's keys are those of about this many blocks at most
BLOCKS_A_BUCKET = 2
#: blocks whose keys one bucket takes
FAN = 256


def into_blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """``docs`` (with doc_id and text) plus block, and the number of blocks."""
    size = docs.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))), n


def requester(keys_of: Callable[[pa.Table], list[tuple[int, np.ndarray, np.ndarray, int]]], buckets: int):
    """``keys_of`` gives (kind, sorted distinct 64-bit keys, weights, low bits to drop) of a block's texts."""

    def request(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        rows = []
        for kind, keys, weights, drop in keys_of(table):
            bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cut)):
                part = slice(cut[b], cut[b + 1])
                rows.append((kind, int(b), block, int(cut[b + 1] - cut[b]), pack_sorted(keys[part] >> np.uint64(drop)), pack_counts(weights[part])))
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in REQUESTS.split(", ")])

    return request


def _entries(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Entries of each row of ``table``; keys and weights of all rows, one after the other."""
    n = table.column("n").to_numpy().astype(np.int64)
    keys = np.concatenate([unpack_sorted(x, k) for x, k in zip(table.column("keys").to_pylist(), n.tolist(), strict=True)])
    return n, keys, np.concatenate([unpack_counts(x, k) for x, k in zip(table.column("weights").to_pylist(), n, strict=True)])


def _answer_rows(table: pa.Table, n: np.ndarray, counts: np.ndarray, distinct: int, total: int) -> pa.Table:
    """ANSWERS for the rows of ``table``, which ``counts`` follows; distinct and total go with the first row."""
    first = lambda x: pa.array([x] + [0] * (len(n) - 1), pa.int64())
    packed = [pack_counts(counts[e - k : e]) for e, k in zip(np.cumsum(n), n, strict=True)]
    cols = {c: table.column(c) for c in ("kind", "bucket", "block", "n")}
    return pa.table(cols | {"counts": pa.array(packed, pa.binary()), "distinct": first(distinct), "total": first(total)})


def _answer(table: pa.Table) -> pa.Table:
    table = table.sort_by("block")
    n, keys, weights = _entries(table)
    _, inv = np.unique(keys, return_inverse=True)
    totals = np.bincount(inv, weights).astype(np.int64)
    return _answer_rows(table, n, totals[inv], int((totals > 0).sum()), int(totals.sum()))


def _finer(keys: np.ndarray, parts: int, cuts: int) -> np.ndarray:
    """Which of the ``parts`` of its bucket each key falls in. ``cuts``: the parts of all levels so far, multiplied."""
    return (((keys & np.uint64(0xFFFFFFFF)) * np.uint64(cuts)) >> np.uint64(32)).astype(np.int64) % parts


def _merger(parts: int, cuts: int):
    def merge(table: pa.Table) -> pa.Table:
        kind, bucket, parent = (table.column(c)[0].as_py() for c in ("kind", "bucket", "parent"))
        _, keys, weights = _entries(table)
        keys, inv = np.unique(keys, return_inverse=True)
        sums, part = np.bincount(inv, weights).astype(np.int64), _finer(keys, parts, cuts)
        rows = [(kind, bucket * parts + int(p), parent, int(at.sum()), pack_sorted(keys[at]), pack_counts(sums[at])) for p in np.unique(part) for at in [part == p]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in REQUESTS.split(", ")])

    return merge


def _returner(parts: int, cuts: int):
    def give_back(asked: pa.Table, got: pa.Table) -> pa.Table:
        asked, got = asked.sort_by("block"), got.sort_by("part")
        n, keys, _ = _entries(asked)
        keys, inv = np.unique(keys, return_inverse=True)
        totals = np.empty(len(keys), np.int64)
        totals[np.argsort(_finer(keys, parts, cuts), kind="stable")] = np.concatenate([unpack_counts(c, k) for c, k in zip(got.column("counts").to_pylist(), got.column("n").to_pylist(), strict=True)])
        return _answer_rows(asked, n, totals[inv], *(sum(got.column(c).to_pylist()) for c in ("distinct", "total")))

    return give_back


def _added_up(requests: DataFrame, n_blocks: int, fan: int, cuts: int) -> DataFrame:
    if n_blocks <= fan:
        return requests.groupBy("kind", "bucket").applyInArrow(_answer, ANSWERS)
    parents = -(-n_blocks // fan)
    parts = min(parents, fan)
    cuts *= parts
    asked = requests.withColumn("parent", F.expr(f"block div {fan}")).groupBy("kind", "bucket", "parent")
    above = _added_up(asked.applyInArrow(_merger(parts, cuts), REQUESTS), parents, fan, cuts)
    got = above.select("kind", F.expr(f"cast(bucket div {parts} AS INT)").alias("bucket"), F.col("block").alias("parent"), F.col("bucket").alias("part"), "n", "counts", "distinct", "total")
    return asked.cogroup(got.groupBy("kind", "bucket", "parent")).applyInArrow(_returner(parts, cuts), ANSWERS)


def answers(blocked: DataFrame, n_blocks: int, keys_of: Callable, fan: int = FAN) -> DataFrame:
    """ANSWERS rows: for every block and kind the total weights of its keys; distinct and total are sums over all rows of a kind."""
    buckets = max(1, -(-min(n_blocks, fan) // BLOCKS_A_BUCKET))
    return _added_up(blocked.groupBy("block").applyInArrow(requester(keys_of, buckets), REQUESTS), n_blocks, fan, 1)


def counts_of(table: pa.Table, kind: int) -> np.ndarray:
    """The counts that a block got for its keys of one kind, in the order of the keys."""
    rows = sorted((b, c, n) for k, b, c, n in zip(*(table.column(x).to_pylist() for x in ("kind", "bucket", "counts", "n")), strict=True) if k == kind)
    return np.concatenate([unpack_counts(c, n) for _, c, n in rows]) if rows else np.empty(0, np.int64)
