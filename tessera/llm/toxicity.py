"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A feature is a hashed n-gram of code points, present or absent in a text; ASCII letters are lower-cased, and white space
and ASCII marks all count as a blank. Its value is the log of
the smoothed ratio of its document counts in toxic and other texts (a training text is left out of its own counts); a
logistic regression is trained on those values. N-grams of few texts or with a ratio near 1 are not used.
The classifier is fitted on at most ``max_train`` labelled rows (about; chosen by a hash of the id), dealt into ``shards``
fixed shards: Spark sums the counts of the shards' features, each shard runs normalised stochastic gradient steps over its rows, and the shards'
weights are averaged (parameter mixing) for the next round. All texts are scored whole.

Nulls, ties and repeats: null text is empty and is scored by the intercept alone; null or repeated ids are scored row by
row; labels that are null are not used, and of several labels of an id the largest counts; without labelled rows of both
classes every score is the share of toxic rows (0.5 without any). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read_table, staged, text_chunks

BITS = 20
ORDERS = (5, 7)
CHUNK = 1 << 20
THRESHOLD = 0.3


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature), sorted and without repeats, for UTF-8 texts one after another."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4").copy()
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = lead[offs]
    if ends[-1] != len(points):  # not UTF-8: bytes stand for characters
        points, ends = data.astype(np.uint32), offs
    upper = (points >= 65) & (points <= 90)
    points[upper] += 32
    points[(points < 48) | ((points > 57) & (points < 97)) | ((points > 122) & (points < 128))] = 32  # ASCII marks and white space
    doc = np.repeat(np.arange(len(offs) - 1, dtype=np.uint64), np.diff(ends))
    keys = []
    h = points.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(points) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + points[n - 1 :]
        if n in ORDERS:
            ok = doc[: len(h)] == doc[n - 1 :]
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(n)
            x = ((x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS)
            keys.append((doc[: len(h)][ok] << np.uint64(BITS)) | x[ok])
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _examples(batches: Iterator[pa.RecordBatch]) -> list[tuple[np.ndarray, int]]:
    """(features, label) of every row, in a fixed order."""
    out = []
    for batch in batches:
        for rows, data, offs in text_chunks(batch, "text", CHUNK):
            doc, feat = features(data, offs)
            cut = np.searchsorted(doc, np.arange(rows.num_rows + 1))
            y = rows.column("toxic").to_pylist()
            key = rows.column("key").to_pylist()
            out += [(key[i], feat[cut[i] : cut[i + 1]].astype(np.int32), int(y[i])) for i in range(rows.num_rows)]
    out.sort(key=lambda x: (x[0], x[2], len(x[1])))
    return [(f, y) for _, f, y in out]


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples = _examples(batches)
    if not examples:
        return
    counts = np.zeros((2, 1 << BITS), "<i4")
    for f, y in examples:
        counts[y][f] += 1
    seen = np.flatnonzero(counts.any(axis=0)).astype(np.int32)
    yield pa.RecordBatch.from_pydict({"feature": seen, "negatives": counts[0, seen], "positives": counts[1, seen]})


class Ratios:
    """Log-count ratios of the features in use: ``all`` for texts that were not counted, ``own[y]`` for a counted text of label y."""

    def __init__(self, used: np.ndarray, counts: np.ndarray, rows: tuple[int, int], smoothing: float, min_ratio: float):
        ratio = self._of(counts, rows, smoothing, (0, 0))
        strong = np.abs(ratio) >= min_ratio
        self.used, self.all = used[strong].astype(np.int32), ratio[strong].astype(np.float32)
        part = counts[:, strong]
        self.own = [self._of(part, rows, smoothing, less).astype(np.float32) for less in ((1, 0), (0, 1))]

    @staticmethod
    def _of(counts: np.ndarray, rows: tuple[int, int], a: float, less: tuple[int, int]) -> np.ndarray:
        side = lambda y: np.log((np.maximum(counts[y] - less[y], 0) + a) / (max(rows[y] - less[y], 0) + 2 * a))
        return side(1) - side(0)


def _trainer(ratios: Ratios, start: np.ndarray, epochs: int, rate: float, seed: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = _examples(batches)
        if not examples:
            return
        slot = np.full(1 << BITS, -1, np.int32)
        slot[ratios.used] = np.arange(len(ratios.used), dtype=np.int32)
        rows = [(x[x >= 0], y) for f, y in examples for x in (slot[f],)]
        w, b = start[:-1].copy(), float(start[-1])
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                f, y = rows[i]
                x = ratios.own[y][f]
                g = 1 / (1 + np.exp(-np.clip(b + float(w[f] @ x), -35, 35))) - y
                w[f] -= (rate * g / (1 + float(x @ x))) * x
                b -= 0.02 * g
        yield pa.RecordBatch.from_pydict({"w": [np.append(w, b).astype("<f4").tobytes()], "n": [len(rows)]})

    return train


def fit(examples: DataFrame, shards: int = 4, rounds: int = 3, epochs: int = 6, rate: float = 0.5, smoothing: float = 1.0, min_docs: int = 8, min_ratio: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The features in use; their weights and, last, the intercept. ``examples``: key, text, toxic (0 or 1)."""
    labelled = examples.where(F.col("toxic").isNotNull())
    sample = staged(labelled.select(F.coalesce(F.col("key"), F.lit(-1)).alias("key"), "text", F.col("toxic").cast("int").alias("toxic")), "train")
    # A shard's rows go through one task; the sample is bounded, so the shards are.
    dealt = sample.repartition(shards, F.pmod(F.xxhash64("key"), F.lit(shards)))
    rows = {r.toxic: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    neg, pos = rows.get(0, 0), rows.get(1, 0)
    none = np.empty(0, np.int32)
    if not neg or not pos:
        return none, np.array([0.0 if not neg + pos else (30.0 if pos else -30.0)], np.float32)
    counted = dealt.mapInArrow(_counter, "feature int, negatives int, positives int").groupBy("feature").agg(F.sum("negatives").alias("negatives"), F.sum("positives").alias("positives"))
    # At most 1 << BITS features, and only those of enough texts leave the executors.
    got = counted.where(F.col("negatives") + F.col("positives") >= min_docs).toArrow().sort_by("feature")
    used, *counts = (got.column(c).to_numpy() for c in ("feature", "negatives", "positives"))
    ratios = Ratios(used, np.stack(counts), (neg, pos), smoothing, min_ratio)
    out = np.zeros(len(ratios.used) + 1, np.float32)
    out[-1] = np.log(pos / neg)
    for k in range(rounds):
        got = dealt.mapInArrow(_trainer(ratios, out, epochs, rate, k), "w binary, n long").collect()
        out = (sum(np.frombuffer(r.w, "<f4") * r.n for r in got) / sum(r.n for r in got)).astype(np.float32)
    return ratios.used, np.append(out[:-1] * ratios.all, out[-1]).astype(np.float32)


Model = tuple[np.ndarray, np.ndarray]  # features in use; their weights and, last, the intercept


def _scores(data: np.ndarray, offs: np.ndarray, model: Model) -> np.ndarray:
    used, weights = model
    dense = np.zeros(1 << BITS, np.float32)
    dense[used] = weights[:-1]
    doc, feat = features(data, offs)
    z = float(weights[-1]) + np.bincount(doc, dense[feat], len(offs) - 1)
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _scorer(weights: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in text_chunks(batch, "text", CHUNK):
                keep = [c for c in rows.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(_scores(data, offs, weights))], names=[*keep, "score"])

    return score


def labelled_sample(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """key, text, toxic of about ``max_train`` labelled rows at most, chosen by a hash of the id."""
    ids = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("key")).agg(F.max("toxic").alias("toxic"))
    ids = staged(ids, "labels")
    n = ids.count()
    if n > max_train:
        ids = ids.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    # At most about max_train ids and labels of 12 bytes: small enough for every executor, whatever the corpus.
    return docs.select(F.col("doc_id").alias("key"), "text").join(F.broadcast(ids), "key")


def score_documents(docs: DataFrame, examples: DataFrame, keep: list[str], **options) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` and score (0 to 1), by a classifier fitted on ``examples``."""
    weights = fit(examples, **options)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(_scorer(weights), f"{schema}, score double")


def filter_documents(docs: DataFrame, examples: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Rows of ``docs`` whose score is below ``threshold``; all columns."""
    weights = fit(examples, **options)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in text_chunks(batch, "text", CHUNK):
                yield rows.filter(pa.array(_scores(data, offs, weights) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def query(spark: SparkSession, sf_dir: str, max_train: int = 16000) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    scored = score_documents(docs, labelled_sample(docs, labels, max_train), ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
