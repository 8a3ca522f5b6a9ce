"""Similarity join on word shingles: rare-first prefix filtering, verified once per pair.

1. Every text becomes the set of its distinct shingles of ``k`` words (53-bit hashes). Exact document frequencies of all
   shingles come back to the texts (``blockcounts``). A set's shingles are ordered rare first; only its prefix of
   n - ceil(t*n) + 1 shingles can hold the first match with a similar set, and shingles of one text alone match nothing.
2. Texts with equal sets are one class. From here on a class has one row, however many copies there are.
3. Classes that share a prefix shingle are candidates if their sizes (length filter) and the positions of the shared
   shingle (positional filter) allow the overlap, and if bitmaps and counts by hash ranges of their shared shingles do (suffix
   filter). In each of a few rounds, every class meets a few classes, drawn by a hash, of each of its prefix shingles, the
   likeliest by the filters is verified, and linked classes are merged. Then all pairs of classes that are still apart are
   compared; a shingle whose classes are all merged asks for nothing more. No component is lost, but the links are a connecting subset: two classes
   that others have already joined are not verified against each other. Classes of one shingle that stay
   apart are tested by the filters against all of that shingle; only pairs that pass leave the join.
4. A pair is verified once, by intersecting the sets.
5. ``n_links`` needs all links: every pair of classes of one component is verified, by pairs of blocks of classes.

Nulls, ties and repeats: a null text is empty, has no shingle and links with nothing; repeated rows and rows with a null
id are members of their class; ``component_id`` is the smallest id that is not null. An empty table gives no rows. Long texts
are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blockcounts import answers, counts_of, into_blocks
from .common import read_table, staged, text_chunks
from .components import components
from .textnum import pack_keys, shingles, unpack_keys, words

BLOCK_BYTES = 4 << 20
CHUNK = 1 << 20
DROP = np.uint64(11)
RANGE_BITS = 5
RANGES = 1 << RANGE_BITS
#: 64-bit words of the bitmap of a set's shared shingles
BITMAP_WORDS = 8
#: classes of one shingle that its other classes are compared with in a round
HEADS = 8
#: classes of a block and shingles of a slice when all links of a component are counted
GROUP, COLUMNS = 256, 4096
PROFILE = "doc_id long, n long, sig string, keys array<long>, pos array<int>, shared int, bits array<long>, spread array<int>, body binary"


def _sets(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, key) of all texts' sets, sorted by both; the number of texts."""
    docs, keys, base = [], [], 0
    for rows, data, offs in text_chunks(table, "text", CHUNK, 2048):
        owner, h = shingles(words(data, offs), k)
        x = np.sort((owner.astype(np.uint64) << np.uint64(53)) | (h >> DROP))
        x = x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
        docs.append((x >> np.uint64(53)).astype(np.int64) + base)
        keys.append(x & np.uint64((1 << 53) - 1))
        base += rows.num_rows
    cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
    return cat(docs, np.int64), cat(keys, np.uint64), base


def _requests(k: int):
    def keys_of(table: pa.Table) -> list:
        _, keys, _ = _sets(table, k)
        u, n = np.unique(keys, return_counts=True)
        return [(0, u << DROP, n, int(DROP))]

    return keys_of


def _profiles(k: int, percent: int):
    def profile(left: pa.Table, right: pa.Table) -> pa.Table:
        doc, key, n_docs = _sets(left, k)
        _, inv = np.unique(key, return_inverse=True)
        df = counts_of(right, 0)[inv]
        cut = np.searchsorted(doc, np.arange(n_docs + 1))
        size = np.diff(cut)
        prefix = size - (percent * size + 99) // 100 + 1
        single = np.bincount(doc[df == 1], minlength=n_docs)
        common = np.flatnonzero(df > 1)
        common = common[np.lexsort((key[common], df[common], doc[common]))]
        start = np.searchsorted(doc[common], np.arange(n_docs + 1))
        # How many of a set's shared shingles fall into each range of the hash space: the suffix filter's partition.
        where = doc[common] * RANGES + (key[common] >> np.uint64(53 - RANGE_BITS)).astype(np.int64)
        counts = np.bincount(where, minlength=n_docs * RANGES).reshape(n_docs, RANGES)
        # Which bits of a bitmap they set: every bit that only one of two sets has stands for a shingle that the other lacks.
        bits = np.zeros((n_docs, BITMAP_WORDS * 64), np.uint8)
        bits[doc[common], (key[common] % np.uint64(BITMAP_WORDS * 64)).astype(np.int64)] = 1
        bits = np.packbits(bits, axis=1, bitorder="little").view("<i8")
        sig, keys, pos, shared, bitmap, spread, body = [], [], [], [], [], [], []
        for i in range(n_docs):
            own = key[cut[i] : cut[i + 1]]
            sig.append(hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest() if len(own) else None)
            m = min(int(prefix[i] - single[i]), int(start[i + 1] - start[i])) if len(own) else 0
            keys.append(key[common[start[i] : start[i] + m]].astype(np.int64) if m > 0 else [])
            pos.append(np.arange(single[i], single[i] + m, dtype=np.int32) if m > 0 else [])
            shared.append(int(start[i + 1] - start[i]))
            bitmap.append(bits[i] if m > 0 else [])
            spread.append(counts[i].astype(np.int32) if m > 0 else [])
            body.append(pack_keys(own, 7) if m > 0 else None)
        return pa.table({"doc_id": left.column("doc_id"), "n": pa.array(size, pa.int64()), "sig": pa.array(sig, pa.string()), "keys": pa.array(keys, pa.list_(pa.int64())), "pos": pa.array(pos, pa.list_(pa.int32())), "shared": pa.array(shared, pa.int32()), "bits": pa.array(bitmap, pa.list_(pa.int64())), "spread": pa.array(spread, pa.list_(pa.int32())), "body": pa.array(body, pa.binary())})

    return profile


def _verifier(percent: int):
    edges = (np.arange(RANGES + 1, dtype=np.float64) * 2.0**53 / RANGES).astype(np.uint64)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, x, hx = [], None, None, None
            left, right = batch.column("body_a"), batch.column("body_b")
            for i in range(batch.num_rows):
                raw = left[i].as_buffer().to_pybytes()
                if raw is not last and raw != last:
                    last, x = raw, unpack_keys(raw, 7)
                    hx = np.diff(np.searchsorted(x, edges))
                y = unpack_keys(right[i].as_buffer().to_pybytes(), 7)
                total = len(x) + len(y)
                need = -(-percent * total // (100 + percent))
                if np.minimum(hx, np.diff(np.searchsorted(y, edges))).sum() < need:  # suffix filter
                    continue
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                if int((large[at] == small).sum()) >= need:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return verify


def _counter(percent: int):
    def count(table: pa.Table) -> pa.Table:
        """Rows that each class of one block links with in the other one (or in the same block, of a block with itself)."""
        sets = [unpack_keys(x, 7) for x in table.column("body").to_pylist()]
        seat, rows = (table.column(c).to_numpy() for c in ("seat", "rows"))
        size = np.array([len(x) for x in sets], np.int64)
        _, col = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(col, kind="stable")
        row, col = np.repeat(np.arange(len(sets)), size)[order], col[order]
        overlap = np.zeros((len(sets), len(sets)), np.float32)
        for start in range(0, int(col[-1]) + 1, COLUMNS):
            i, j = np.searchsorted(col, [start, start + COLUMNS])
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[row[i:j], col[i:j] - start] = 1
            overlap += has @ has.T
        linked = (100 + percent) * overlap.astype(np.int64) >= percent * (size[:, None] + size)
        np.fill_diagonal(linked, False)
        if table.column("lo")[0] != table.column("hi")[0]:
            linked &= seat[:, None] != seat
        return pa.table({"sig": table.column("sig"), "links": pa.array(linked @ rows)})

    return count


def link_counts(profiles: DataFrame, labels: DataFrame, percent: int, group: int = GROUP) -> DataFrame:
    """sig, links: rows of other classes that each linked class is similar to. All pairs of a component are verified.

    A component's classes are dealt into blocks of about ``group`` classes or BLOCK_BYTES of sets; every pair of blocks is one group.
    """
    classes = profiles.where("size(keys) > 0").groupBy("sig").agg(F.count("*").alias("rows"), F.first("body").alias("body"))
    known = staged(classes.join(labels.select(F.col("node").alias("sig"), "label"), "sig"), "linked")
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(group)), F.ceil(F.sum(F.octet_length("body")) / F.lit(BLOCK_BYTES)))
    dealt = known.join(known.groupBy("label").agg(blocks.alias("blocks")), "label").withColumn("seat", F.pmod(F.xxhash64("sig"), F.col("blocks")))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select("label", F.least("seat", "other").alias("lo"), F.greatest("seat", "other").alias("hi"), "seat", "sig", "rows", "body")
    return pairs.groupBy("label", "lo", "hi").applyInArrow(_counter(percent), "sig string, links long").groupBy("sig").agg(F.sum("links").alias("links"))


def _bound(percent: int) -> str:
    """Length and positional filters for a (smaller) and b that share a shingle at positions a_i and b_i of their orders.

    A similar pair is found at its first common shingle, where all of the overlap is still ahead on both sides.
    """
    return f"""100 * n_a >= {percent} * n_b AND (100 + {percent}) * least(n_a - a_i, n_b - b_i) >= {percent} * (n_a + n_b)"""


def _overlap_bound() -> Column:
    """Suffix filter: a and b share at most this many shingles, by the bitmaps and the ranges of their shared ones."""

    def lacking(x: str, y: str) -> str:
        return " + ".join(f"bit_count(bits_{x}[{w}] & ~bits_{y}[{w}])" for w in range(BITMAP_WORDS))

    by_bits = F.expr(f"least(shared_a - ({lacking('a', 'b')}), shared_b - ({lacking('b', 'a')}))")
    by_ranges = F.aggregate(F.zip_with("spread_a", "spread_b", lambda x, y: F.least(x, y)), F.lit(0), lambda x, y: x + y)
    return F.least(by_bits, by_ranges)


def similarity_links(profiles: DataFrame, percent: int, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(a connecting subset of the links between classes, labels of linked classes) of rows of PROFILE.

    ``rounds``: how often each class is first compared with the likeliest of a few classes that it shares a shingle with, and links
    are merged, before all pairs that are still apart are compared.
    """
    members = profiles.where("size(keys) > 0")
    facts = ["n", "shared", "bits", "spread"]
    classes = staged(members.groupBy("sig").agg(*[F.first(c).alias(c) for c in (*facts, "keys", "pos", "body")]), "classes")
    bodies = classes.select("sig", "body")
    postings = classes.select("sig", *facts, F.explode(F.arrays_zip("keys", "pos")).alias("p")).select(F.col("p.keys").alias("key"), "sig", F.col("p.pos").alias("i"), *facts)
    enough = (100 + percent) * _overlap_bound() >= percent * (F.col("n_a") + F.col("n_b"))

    def verified(pairs: DataFrame) -> DataFrame:
        full = pairs.join(bodies.withColumnsRenamed({"sig": "a", "body": "body_a"}), "a").join(bodies.withColumnsRenamed({"sig": "b", "body": "body_b"}), "b")
        return staged(full.select("a", "b", "body_a", "body_b").mapInArrow(_verifier(percent), "a string, b string"), "links")

    def labelled(rows: DataFrame) -> DataFrame:
        """Rows of the shingles whose classes are not all merged, with the label of their class."""
        out = rows.join(merged, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        apart = out.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
        return out.join(apart, "key")

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.select("key", F.col("sig").alias(x), F.col("i").alias(f"{x}_i"), *[F.col(c).alias(f"{c}_{x}") for c in ("label", *facts)])

    spark = profiles.sparkSession
    asked = links = spark.createDataFrame([], "a string, b string")
    merged = spark.createDataFrame([], "sig string, label string")
    for turn in range(rounds):
        rows = staged(labelled(postings), "rows")
        order = F.xxhash64("sig", "key", F.lit(turn))
        heads = rows.groupBy("key", F.pmod(order, F.lit(HEADS)).alias("seat")).agg(F.min(F.struct(order.alias("order"), "sig", "i", "label", *facts)).alias("h")).select("key", "h.*")
        # Either of the two can be the smaller one: the filters are symmetric but for the length filter.
        near = side(heads, "a").join(side(rows, "b"), "key").where(F.expr(f"label_a <> label_b AND {_bound(percent)} AND 100 * n_b >= {percent} * n_a") & enough)
        likely = (_overlap_bound() / (F.col("n_a") + F.col("n_b"))).alias("likely")
        one = near.select("a", "b", likely).join(asked, ["a", "b"], "left_anti").groupBy("b").agg(F.max(F.struct("likely", "a")).alias("h")).select("h.a", "b")
        pairs = staged(one, "asked")
        asked = asked.unionByName(pairs)
        links = links.unionByName(verified(pairs))
        merged = components(links).withColumnRenamed("node", "sig")
    left = staged(labelled(postings), "apart")
    rest = side(left, "a").join(side(left, "b"), "key").where(F.expr(f"(n_a < n_b OR n_a = n_b AND a < b) AND label_a <> label_b AND {_bound(percent)}") & enough).select("a", "b").distinct()
    tried = asked.unionByName(asked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = verified(rest.join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(more)
    return links, components(links) if not more.isEmpty() else merged.withColumnRenamed("sig", "node")


def similarity_classes(docs: DataFrame, k: int, percent: int, block_bytes: int = BLOCK_BYTES, count_links: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, set_id (equal sets), component_id of every row of ``docs`` (doc_id, text); with ``count_links`` n_links too,
    the number of other rows that a row is similar to."""
    rows, n_blocks = into_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), block_bytes)
    got = answers(rows, n_blocks, _requests(k)).select("block", "kind", "bucket", "n", "counts")
    profiles = staged(rows.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(_profiles(k, percent), PROFILE), "profiles")
    _, labels = similarity_links(profiles, percent)
    thin = profiles.select("doc_id", "n", "sig").join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    smallest = thin.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = thin.join(smallest, "label", "left")
    n_links = []
    if count_links:
        copies = thin.where("sig IS NOT NULL").groupBy("sig").agg((F.count("*") - 1).alias("copies"))
        out = out.join(copies, "sig", "left").join(link_counts(profiles, labels, percent, group), "sig", "left")
        n_links = [(F.coalesce("copies", F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links")]
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("sig").alias("set_id"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *n_links)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(read_table(spark, sf_dir, "documents"), 4, 85, count_links=True).drop("set_id")
