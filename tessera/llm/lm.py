"""Language-model scores by deleted interpolation of word n-grams.

The probability of a token after its two predecessors mixes the maximum-likelihood trigram, bigram and unigram estimates and a
uniform floor. The weights depend on how often the longest context that was seen occurs: the pair before the token, else its
predecessor (buckets by powers of two of each). They are learned by expectation-maximisation on held-out counts: each training
text is deleted from the counts before its own tokens are looked up, when weights are learned and when a training text is scored,
so that scores of training and other texts compare. The look-ups of all training texts are gathered in a grid of (bucket,
quantised ratios of the estimates), whose size is bounded, and the iterations run on the grid of each bucket, in a task of its own.

Counts cover all training texts exactly; see ``blockcounts`` for how they reach the texts.

Nulls, ties and repeats: a null text is empty, which is one end token; a null id counts as the empty text in the fold;
repeated rows each count and each get a row. Without training texts every count is 0, and scores are those of the floor.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blockcounts import answers, counts_of, into_blocks
from .common import fold, read_table, staged, text_chunks
from .textnum import mix, words

BLOCK_BYTES = 8 << 20
CHUNK = 1 << 20
ITERATIONS = 30
CONTEXTS = 24
#: bins of an estimate's ratio to the floor: quarters of a power of two, from 2**-16 to 2**48; 0 stands for "never seen"
BINS = 256
_END = mix(np.array([0xE0F], np.uint64))[0]
_START = mix(np.array([0x50F], np.uint64))[0]
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
_Q3 = np.uint64(0x9E3779B97F4A7C15)
UNI, BI, TRI = 0, 1, 2
WEIGHTS = "context int, w3 double, w2 double, w1 double, w0 double"


class Tokens:
    """Tokens of a block's texts in order: their text, unigram, bigram and trigram keys, and which ones begin a text."""

    def __init__(self, table: pa.Table):
        doc, uni, prev, base = [], [], [], 0
        for rows, data, offs in text_chunks(table, "text", CHUNK):
            w = words(data, offs)
            n = rows.num_rows
            counts = np.diff(w.first)
            ends = np.cumsum(counts + 1) - 1
            h = np.full(len(w.hash) + n, _END, np.uint64)
            at = np.ones(len(h), bool)
            at[ends] = False
            h[at] = w.hash
            p = np.empty(len(h), np.uint64)
            p[1:] = h[:-1]
            p[np.concatenate([[0], ends[:-1] + 1])] = _START
            doc.append(np.repeat(np.arange(base, base + n), counts + 1))
            uni.append(h)
            prev.append(p)
            base += n
        cat = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        self.n, self.doc, self.uni, self.prev = base, cat(doc, np.int64), cat(uni, np.uint64), cat(prev, np.uint64)
        self.bi, self.begins = mix(self.prev * _Q + self.uni), self.prev == _START
        self.tri = mix(self.after(self.bi, self.prev) * _Q3 + self.uni)
        self.train = np.asarray(table.column("train").to_numpy(zero_copy_only=False), bool)

    def after(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """``x`` of the token before each token; ``start`` of the token itself where it begins a text."""
        return np.where(self.begins, start, np.concatenate([x[:1], x[:-1]]))


def _keys(table: pa.Table) -> list:
    t = Tokens(table)
    learn = t.train[t.doc].astype(np.float64)
    out = []
    for kind, x, drop in ((UNI, t.uni, 0), (BI, t.bi, 11), (TRI, t.tri, 11)):
        keys, inv = np.unique(x >> np.uint64(drop) << np.uint64(drop), return_inverse=True)
        out.append((kind, keys, np.bincount(inv, learn, len(keys)).astype(np.int64), drop))
    return out


def _looked_up(t: Tokens, table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per token: counts of the token, of its predecessor as a context, of the pair and of the three tokens that end here; and their ids
    in the block."""
    uni, i1 = np.unique(t.uni, return_inverse=True)
    i2, i3 = (np.unique(x >> np.uint64(11) << np.uint64(11), return_inverse=True)[1] for x in (t.bi, t.tri))
    c1, c2, c3 = (counts_of(table, kind) for kind in (UNI, BI, TRI))
    # A word is followed by one token each time; a start is followed as often as there are ends.
    ic = np.searchsorted(uni, np.where(t.begins, _END, t.prev))
    return [c1[i1], c1[ic], c2[i2], c3[i3]], [i1, ic, i2, i3]


def _deleted(t: Tokens, found: tuple[list[np.ndarray], list[np.ndarray]], n_train: int) -> tuple[np.ndarray, ...]:
    """Counts of token, context, pair, three tokens, the pair before (the longer context) and all tokens, without those of the token's
    own text if that is a training text."""
    train = t.train[t.doc]

    def own(i: np.ndarray) -> np.ndarray:
        _, inv, k = np.unique((t.doc.astype(np.uint64) << np.uint64(32)) | i.astype(np.uint64), return_inverse=True, return_counts=True)
        return k[inv] * train

    length = np.bincount(t.doc, minlength=t.n)[t.doc] * train
    # A context's own count is that of the predecessor as a token of the same text (an end for a start): each is followed once.
    # So is a pair that does not end its text, and the longer context of a first token is the start alone.
    c, ctx, pair, three = (x - own(i) for x, i in zip(*found, strict=True))
    return c, ctx, pair, three, t.after(pair, ctx), n_train - length


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(c, 0) + 1).astype(np.int64), CONTEXTS - 1)


def _context(ctx: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Which weights a token takes: from CONTEXTS on by the count of the pair before it, below that by its predecessor's."""
    return np.where(longer > 0, CONTEXTS + _bucket(longer), _bucket(ctx))


def _gather(n_train: int, n_types: int):
    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        cols = [np.empty(0, np.int64)] * 5
        if left.num_rows:
            t = Tokens(left)
            use = t.train[t.doc]
            c, ctx, pair, three, longer, n = (x[use] for x in _deleted(t, _looked_up(t, right), n_train))
            cell = _context(ctx, longer)
            for k, of in ((three, longer), (pair, ctx), (c, n)):
                ratio = np.maximum(k, 1) / np.maximum(of, 1) * (n_types + 1)
                cell = cell * (BINS + 1) + np.where(k > 0, np.clip(np.round(4 * np.log2(ratio)) + 65, 1, BINS), 0).astype(np.int64)
            cell, k = np.unique(cell, return_counts=True)
            at = [cell // (BINS + 1) ** d for d in (3, 2, 1, 0)]
            cols = [at[0], *(x % (BINS + 1) for x in at[1:]), k]
        return pa.table([pa.array(x, pa.int64()) for x in cols], names=["context", "bin3", "bin2", "bin1", "n"])

    return gather


def first_weights(context: int) -> np.ndarray:
    """Equal weights of the estimates that a context allows: no trigram without a pair before, no bigram without a predecessor."""
    out = np.array([context >= CONTEXTS, context > 0, 1, 1], float)
    return out / out.sum()


def learn_weights(context: int, cells: np.ndarray, iterations: int = ITERATIONS) -> np.ndarray:
    """Weights of trigram, bigram, unigram and floor of one context, from rows (bin3, bin2, bin1, n), by expectation-maximisation."""
    out = first_weights(context)
    f = np.where(cells[:, :3] > 0, 2.0 ** ((cells[:, :3] - 65) / 4), 0)
    f = np.hstack([f, np.ones((len(f), 1))])
    for _ in range(iterations):
        post = f * out
        post /= post.sum(axis=1, keepdims=True)
        got = (post * cells[:, 3:]).sum(axis=0) + [0, 0, 0, 1e-3]  # the floor never vanishes
        out = got / got.sum()
    return out


def _learn(table: pa.Table) -> pa.Table:
    bins = ["bin3", "bin2", "bin1"]
    table = table.sort_by([(c, "ascending") for c in bins])
    context = table.column("context")[0].as_py()
    got = learn_weights(context, np.stack([table.column(c).to_numpy() for c in [*bins, "n"]], axis=1))
    return pa.table([pa.array([context], pa.int32()), *(pa.array([x]) for x in got)], names=["context", "w3", "w2", "w1", "w0"])


def _scorer(n_train: int, n_types: int, weights: np.ndarray):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        t = Tokens(left)
        found = _looked_up(t, right)
        c = found[0][0]
        uni, ctx, pair, three, longer, n = _deleted(t, found, n_train)
        w = weights[_context(ctx, longer)]
        p = w[:, 0] * three / np.maximum(longer, 1) + w[:, 1] * pair / np.maximum(ctx, 1) + w[:, 2] * uni / np.maximum(n, 1) + w[:, 3] / (n_types + 1)
        base = np.log10((c + 0.5) / (n_train + 0.5 * (n_types + 1)))
        per = lambda x: np.bincount(t.doc, x, t.n)
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": pa.array(~t.train), "n_tokens": pa.array(per(np.ones(len(c))).astype(np.int64)), "n_known": pa.array(per(c > 0).astype(np.int64)),
            "train_tokens": pa.array(np.full(t.n, n_train, np.int64)), "base_score": pa.array(per(base)), "score": pa.array(per(np.log10(p))),
        })

    return score


def _fitted(docs: DataFrame, block_bytes: int) -> tuple:
    """Blocks of texts, the answers to them, tokens and types of the training texts, and the weights."""
    rows, n = into_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "train"), block_bytes)
    got = staged(answers(rows, n, _keys), "answers")
    n_types, n_train = got.where(f"kind = {UNI}").agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    mine = got.select("block", "kind", "bucket", "n", "counts")
    grid = rows.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_gather(n_train, n_types), "context long, bin3 long, bin2 long, bin1 long, n long")
    cells = grid.groupBy("context", "bin3", "bin2", "bin1").agg(F.sum("n").alias("n"))
    weights = np.stack([first_weights(x) for x in range(2 * CONTEXTS)])
    for context, *got in cells.groupBy("context").applyInArrow(_learn, WEIGHTS).collect():  # one row a context
        weights[context] = got
    return rows, mine, n_train, n_types, weights


def fitted_weights(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """(2 * CONTEXTS, 4): weights of trigram, bigram, unigram and floor by context."""
    return _fitted(docs, block_bytes)[-1]


def score_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``: doc_id, text, train (boolean). Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows, mine, n_train, n_types, weights = _fitted(docs, block_bytes)
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_scorer(n_train, n_types, weights), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_documents(docs.select("doc_id", "text", (fold("doc_id", 5) != 1).alias("train")))
