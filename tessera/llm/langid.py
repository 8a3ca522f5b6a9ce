"""Language identification of code-switched texts by a linear-chain conditional random field over words.

A word is a run of letters. Its features are hashed: prefixes and suffixes of one to four bytes, inner trigrams of bytes, and
the word itself (the lexicon). A label is a language of the training rows; transition weights between the labels of
neighbouring words are learned with the feature weights. Forward-backward gives every word a posterior over languages;
the prediction of a text is the language with the largest mean posterior, and that mean is its score.

Training takes about ``max_train`` labelled rows at most (chosen by a hash of the text), dealt into ``shards`` fixed shards;
each runs adaptive gradient steps on the log-likelihood of its whole texts, and the shards' weights are averaged. A text's
label stands for all its words. Inference cuts chains into segments of ``SEGMENT`` words, multiplies the segments'
transfer matrices for all texts of a chunk at once, and joins them exactly, so that very long texts need no long loops.

Nulls, ties and repeats: ``und`` with score 0 if a text is null or has no letter, or if there are no training rows; ties
go to the first language in order; rows with null lang or null text are not learned from; repeated rows each get a row; an
empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, read_table, staged, text_chunks
from .textnum import Words, mix, words

BITS = 18
SEGMENT = 64
CHUNK = 1 << 20
TRAIN_CHUNK = 1 << 18
AFFIX = 4


class Chunk:
    """Words of some texts, and the features of the distinct ones."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.w: Words = words(data, offs, letters=True)
        _, at, self.kind = np.unique(self.w.hash, return_index=True, return_inverse=True)
        start, size, h = self.w.start[at], self.w.size[at], self.w.hash[at]
        low = data.astype(np.uint64)
        low[(data >= 65) & (data <= 90)] += np.uint64(32)
        cols = [h >> np.uint64(64 - BITS)]
        last = len(data) - 1
        for sign in (1, -1):
            acc = np.zeros(len(at), np.uint64)
            for k in range(AFFIX):
                pos = start + k if sign > 0 else start + size - 1 - k
                acc = np.where(k < size, (acc + low[np.clip(pos, 0, last)]) * np.uint64(1099511628211), acc)
                cols.append(mix(acc + np.uint64((k * 2 + (sign > 0)) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - BITS))
        self.fixed = np.stack(cols, axis=1).astype(np.int64) if len(at) else np.empty((0, 1 + 2 * AFFIX), np.int64)
        grams = np.maximum(size - 2, 0)
        self.owner = np.repeat(np.arange(len(at)), grams)
        pos = np.repeat(start, grams) + np.arange(len(self.owner)) - np.repeat(np.cumsum(grams) - grams, grams)
        tri = low[pos] | (low[pos + 1] << np.uint64(8)) | (low[pos + 2] << np.uint64(16)) if len(pos) else np.empty(0, np.uint64)
        self.gram = (mix(tri + np.uint64(1 << 40)) >> np.uint64(64 - BITS)).astype(np.int64)

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """(distinct words, labels) scores."""
        out = weights[self.fixed].sum(axis=1)
        for j in range(weights.shape[1]):
            out[:, j] += np.bincount(self.owner, weights[self.gram, j], len(out))
        return out

    def spread(self, g: np.ndarray) -> np.ndarray:
        """The transpose of emissions: gradients by distinct word to gradients by feature."""
        cols = []
        for j in range(g.shape[1]):
            x = np.bincount(self.fixed.ravel(), np.repeat(g[:, j], self.fixed.shape[1]), 1 << BITS)
            cols.append(x + np.bincount(self.gram, g[self.owner, j], 1 << BITS))
        return np.stack(cols, axis=1)


def forward_backward(first: np.ndarray, score: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every word and the sum of the posteriors of all label pairs.

    ``first``: n+1 bounds of the chains in ``score`` (words, labels); ``trans``: (labels, labels). A chain starts from an
    even distribution.
    """
    n, k = score.shape
    e = np.exp(score - score.max(axis=1, keepdims=True)) if n else score
    t = np.exp(trans - trans.max())
    counts = np.diff(first)
    segs = -(-counts // SEGMENT)
    chain = np.repeat(np.arange(len(counts)), segs)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(segs) - segs, segs)
    begin = first[:-1][chain] + nth * SEGMENT
    size = np.minimum(first[1:][chain] - begin, SEGMENT)
    order = np.argsort(-size, kind="stable")
    begin_o, size_o = begin[order], size[order]
    active = np.searchsorted(-size_o, -np.arange(SEGMENT), "left")  # segments longer than s
    # Transfer matrices of whole segments.
    mats = np.tile(np.eye(k), (len(order), 1, 1))
    for s in range(SEGMENT):
        m = active[s]
        if not m:
            break
        x = (mats[:m] @ t) * e[begin_o[:m] + s][:, None, :]
        mats[:m] = x / x.sum(axis=(1, 2), keepdims=True)
    mat = np.empty_like(mats)
    mat[order] = mats
    # Messages into each segment, one segment of every chain at a time.
    enter, leave = np.full((len(order), k), 1.0 / k), np.full((len(order), k), 1.0 / k)
    base = np.cumsum(segs) - segs
    live = np.argsort(-segs, kind="stable")
    for s in range(1, int(segs.max(initial=0))):
        c = live[: np.searchsorted(-segs[live], -s, "left")]
        a = np.einsum("ni,nij->nj", enter[base[c] + s - 1], mat[base[c] + s - 1])
        enter[base[c] + s] = a / a.sum(axis=1, keepdims=True)
        at = base[c] + segs[c] - 1 - s
        b = np.einsum("nij,nj->ni", mat[at + 1], leave[at + 1])
        leave[at] = b / b.sum(axis=1, keepdims=True)
    # Messages inside the segments.
    before, alpha, beta = np.empty((n, k)), np.empty((n, k)), np.empty((n, k))
    a = enter[order].copy()
    for s in range(SEGMENT):
        m = active[s]
        if not m:
            break
        at = begin_o[:m] + s
        before[at] = a[:m]
        x = (a[:m] @ t) * e[at]
        a[:m] = alpha[at] = x / x.sum(axis=1, keepdims=True)
    b = leave[order].copy()
    for s in range(SEGMENT - 1, -1, -1):
        m = active[s]
        if not m:
            continue
        at = begin_o[:m] + s
        beta[at] = b[:m]
        x = (e[at] * b[:m]) @ t.T
        b[:m] = x / x.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=1, keepdims=True)
    right = e * beta
    joint = np.einsum("ni,ij,nj->n", before, t, right)
    pairs = (before / joint[:, None]).T @ right * t
    return post, pairs


def _trainer(labels: list[str], epochs: int, rate: float, decay: float):
    k = len(labels)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, rows = [], 0
        whole = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if whole is not None and whole.num_rows:
            whole = whole.sort_by([("key", "ascending"), ("lang", "ascending"), ("text", "ascending")])
            for part, data, offs in text_chunks(whole, "text", TRAIN_CHUNK):
                y = np.array([labels.index(x) for x in part.column("lang").to_pylist()])
                c = Chunk(data, offs)
                rows += part.num_rows
                if len(c.kind):
                    chunks.append((c, y[c.w.doc]))
        w, t = np.zeros((1 << BITS, k)), np.zeros((k, k))
        sw, st = np.full((1 << BITS, k), 1e-2), np.full((k, k), 1e-2)
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            for i in rng.permutation(len(chunks)):
                c, y = chunks[i]
                post, pairs = forward_backward(c.w.first, c.emissions(w)[c.kind], t)
                n = len(y)
                d = -post
                d[np.arange(n), y] += 1
                g = np.stack([np.bincount(c.kind, d[:, j], len(c.fixed)) for j in range(k)], axis=1)
                gw = c.spread(g) / n - decay * w
                same = np.ones(n, bool)
                same[c.w.first[:-1][np.diff(c.w.first) > 0]] = False  # a chain's first word has no neighbour before it
                seen = np.zeros((k, k))
                np.add.at(seen, (y[same], y[same]), 1)
                pairs_start = pairs * (same.sum() / n)
                gt = (seen - pairs_start) / n - decay * t
                sw += gw * gw
                st += gt * gt
                w += rate * gw / np.sqrt(sw)
                t += rate * gt / np.sqrt(st)
        if chunks:
            yield pa.RecordBatch.from_pydict({"w": [w.astype("<f4").tobytes()], "t": [t.astype("<f8").tobytes()], "n": [rows]})

    return train


def fit(examples: DataFrame, max_train: int = 2400, shards: int = 4, epochs: int = 5, rate: float = 0.3, decay: float = 1e-6) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """(languages, feature weights, transition weights) from rows of (text, lang); None without rows."""
    rows = examples.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.xxhash64("text").alias("key"))
    known = rows.groupBy("lang").count().orderBy("lang").collect()  # as many rows as languages
    total = sum(r["count"] for r in known)
    if not total:
        return None
    labels = [r["lang"] for r in known]
    if total > max_train:
        rows = rows.where(F.pmod(F.col("key"), F.lit(1_000_000)) < max(1, int(1_000_000 * max_train / total)))
    sample = staged(rows, "sample")
    dealt = sample.repartition(shards, F.pmod(F.xxhash64("key"), F.lit(shards)))
    got = dealt.mapInArrow(_trainer(labels, epochs, rate, decay), "w binary, t binary, n long").collect()
    if not got:
        return None
    share = [r.n / sum(r.n for r in got) for r in got]
    w = sum(s * np.frombuffer(r.w, "<f4").reshape(-1, len(labels)) for s, r in zip(share, got, strict=True))
    t = sum(s * np.frombuffer(r.t, "<f8").reshape(len(labels), -1) for s, r in zip(share, got, strict=True))
    return labels, w.astype(np.float32), t


def _predictor(model: tuple[list[str], np.ndarray, np.ndarray] | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in text_chunks(batch, "text", CHUNK):
                n = rows.num_rows
                lang, score = ["und"] * n, np.zeros(n)
                if model is not None:
                    labels, w, t = model
                    c = Chunk(data, offs)
                    if len(c.kind):
                        post, _ = forward_backward(c.w.first, c.emissions(w)[c.kind].astype(np.float64), t)
                        total = np.stack([np.bincount(c.w.doc, post[:, j], n) for j in range(len(labels))], axis=1)
                        best = total.argmax(axis=1)
                        counts = np.maximum(np.diff(c.w.first), 1)
                        score = total[np.arange(n), best] / counts
                        lang = [labels[j] if x else "und" for j, x in zip(best, np.diff(c.w.first), strict=True)]
                    ascii_letter = np.concatenate([[0], np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))])
                    for i in np.flatnonzero(ascii_letter[offs[1:]] == ascii_letter[offs[:-1]]):
                        if not any(x.isalpha() for x in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")):
                            lang[i], score[i] = "und", 0.0
                keep = [c for c in rows.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1))], names=[*keep, "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, examples: DataFrame, keep: list[str], **options) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, lang_pred and score, by a model fitted on ``examples`` (text, lang)."""
    model = fit(examples, **options)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(_predictor(model), f"{schema}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, docs.where(fold("doc_id", 5) != 0).select("text", "lang"), ["doc_id"])
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
