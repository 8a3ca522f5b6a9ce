"""Mixing towards target weights with soft membership; DataFrame expressions only.

1. A labelled table gives some documents a domain. Logistic regression over slots of hashed words and runs of marks (each distinct one of a
   text counts once), of the text's length and of its share of distinct words gives every document a posterior over the domains. It uses the
   ``MOST`` slots of the largest likelihood-ratio statistic, of those with ``CERTAINTY`` at least, and of a short list the penalty with the best
   likelihood on labelled rows that were held out. Spark counts slots and applies the weights; the driver fits them on the bounded sample.
2. Nonnegative rates r are fitted so that the expected tokens of each domain, sum of r * tokens * posterior, match the targets:
   least squares, by projected gradient from r = 1. The residuals are whitened by the (domains x domains) normal matrix of the
   documents whose rate is not at a bound, so that few steps are needed. A document's rate follows from its posterior and the short
   list of steps taken so far; an iteration is one aggregation to numbers by domain, and nothing by document is written or sent.

Targets are ``weights`` times a budget; the default budget is the largest that asks of no domain more than there is.
The classifier learns from at most about ``max_train`` labelled rows (chosen by a hash of the id), four fifths of them; everything
else covers all rows. Nulls, ties and repeats: null text is empty (0 tokens, posterior of the priors); documents without a label only get
a posterior; labels without a row are not used; of several labels the smallest domain counts; repeated ids are rows of their own;
without labels posteriors are even. Extra columns do not matter, unless ``sample_documents`` returns them. An empty table gives no rows.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, staged

#: production targets by domain
WEIGHTS = {"clean": 0.82, "low": 0.12, "toxic": 0.06}
#: slots of the hash of words
SLOTS = 1 << 16
#: then 16 slots of the share of distinct words, and those of the length by powers of two
WIDTH = SLOTS + 64
PENALTIES = (0.1, 1.0, 10.0)
PIECE = "[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]+"
#: likelihood-ratio statistic that a slot needs to count, and the most slots that do
CERTAINTY, MOST = 16.0, 512


def label_domain() -> Column:
    """The domain of a row of ``labels``; null if it has none."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")


def pieces_of(text: Column) -> Column:
    """Tokens of a text: runs of letters and digits, and runs of other characters but white space."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PIECE), F.lit(0))


def featured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __tokens and __slots."""
    rows = docs.withColumn("__pieces", pieces_of(F.col(text_col)))
    slots = F.array_distinct(F.transform("__pieces", lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int")))
    rows = rows.withColumns({"__tokens": F.size("__pieces").cast("long"), "__words": slots}).drop("__pieces")
    n = F.greatest("__tokens", F.lit(1))
    share, length = F.floor(10 * F.size("__words") / n).cast("int"), F.floor(F.log2(n)).cast("int")
    return rows.withColumn("__slots", F.concat("__words", F.array(share + SLOTS, length + SLOTS + 16))).drop("__words")


def labelled(docs: DataFrame, labels: DataFrame, domains: list[str], max_train: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """domain, text, fold (0 to 4) of about ``max_train`` labelled rows at most."""
    known = labels.where(F.col("domain").isin(domains) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    known = staged(known.select(F.col("doc_id").alias("__id"), "domain"), "labels")
    n = known.count()
    if n > max_train:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    fold = F.pmod(F.xxhash64("__id", F.lit("fold")), F.lit(5))
    # About max_train ids and labels at most: small enough for every executor, whatever the corpus.
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(known), "__id").select("domain", "__text", fold.alias("fold"))


def evidence(a: np.ndarray, b: np.ndarray, rows_a: np.ndarray, rows_b: float) -> np.ndarray:
    """Likelihood-ratio statistic of the tables of rows with and without a slot in two domains; 0 if its share is the same."""
    both = rows_a + rows_b
    share = (a + b) / np.maximum(both, 1)
    part = lambda seen, due: np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(due, 1e-9)), 0.0)
    return 2 * (part(a, rows_a * share) + part(b, rows_b * share) + part(rows_a - a, rows_a * (1 - share)) + part(rows_b - b, rows_b * (1 - share)))


class Classifier:
    """Weights of the slots and priors of every domain but the first, against the first."""

    def __init__(self, domains: list[str], prior: np.ndarray, weights: np.ndarray):
        self.domains, self.prior, self.weights = domains, prior, weights

    def evidence(self, slots: str) -> list[Column]:
        """The sum of the slots' weights for every domain but the first."""
        # One constant of WIDTH numbers each, which Spark reads once: as text, it takes one call to pass.
        table = lambda w: F.from_json(F.lit(json.dumps([round(float(x), 4) for x in w])), "array<double>")
        one = lambda w: F.aggregate(slots, F.lit(0.0), lambda acc, s: acc + F.element_at(table(w), s + 1))
        return [one(w) for w in self.weights]

    def posterior(self, evidence: list[Column]) -> list[Column]:
        score = [F.lit(0.0), *[F.lit(float(p)) + e for p, e in zip(self.prior, evidence, strict=True)]]
        top = F.greatest(*score) if len(score) > 1 else score[0]
        parts = [F.exp(s - top) for s in score]
        total = sum(parts[1:], parts[0])
        return [p / total for p in parts]

    def apply(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """Columns ``keep`` of ``rows`` (of ``featured``), tokens and p_<domain>."""
        out = rows.select(*keep, F.col("__tokens").alias("tokens"), *[e.alias(f"__e{i}") for i, e in enumerate(self.evidence("__slots"))])
        p = self.posterior([F.col(f"__e{i}") for i in range(len(self.weights))])
        return out.select(*keep, "tokens", *[x.alias(f"p_{d}") for x, d in zip(p, self.domains, strict=True)])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> np.ndarray:
    """Weights (slots and, last, the constant, which is not penalised; by domain) of rows of 0 and 1 with one-hot domains, by accelerated descent."""
    kind = x.dtype  # all in one type: no copies of the rows
    x, y = np.hstack([x, np.ones((len(x), 1), kind)]), y.astype(kind)
    lift = np.ones(x.shape[1], kind)
    for _ in range(30):  # the largest curvature, by power iteration
        lift = x.T @ (x @ lift)
        curve = float(np.linalg.norm(lift))
        lift /= curve
    pull = np.full((x.shape[1], 1), penalty, kind)
    pull[-1] = 0
    w = ahead = np.zeros((x.shape[1], y.shape[1]), kind)
    pace, t = kind.type(1 / (0.55 * curve + penalty)), 1.0
    for _ in range(steps):
        new = ahead - pace * (x.T @ (softmax(x @ ahead) - y) + pull * ahead)
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        w, ahead = new, new + kind.type((last - 1) / t) * (new - w)
    return w.astype(float)


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], max_train: int = 20000) -> Classifier:
    """``labels``: doc_id, domain."""
    d = len(domains)
    none = Classifier(domains, np.zeros(d - 1), np.zeros((d - 1, WIDTH)))
    if d == 1:
        return none
    sample = staged(labelled(docs, labels, domains, max_train), "sample")
    seen = staged(featured(sample, "__text").select("domain", "fold", "__slots"), "slots")
    learn = seen.where("fold <> 0")
    rows = {r.domain: r["count"] for r in learn.groupBy("domain").count().collect()}  # one row a domain
    if not rows:
        return none
    # WIDTH rows at most leave the executors.
    counted = learn.select("domain", F.explode("__slots").alias("slot")).groupBy("slot").agg(*[F.count_if(F.col("domain") == x).alias(f"n{i}") for i, x in enumerate(domains)]).toArrow()
    n = np.zeros((d, WIDTH))
    at = counted.column("slot").to_numpy()
    for i in range(d):
        n[i, at] = counted.column(f"n{i}").to_numpy()
    of = np.array([rows.get(x, 0) for x in domains], float)
    certain = evidence(n[1:], n[0], of[1:, None], of[0]).max(axis=0)
    used = np.sort(np.argsort(-certain, kind="stable")[:MOST])
    used = used[certain[used] >= CERTAINTY]
    # About max_train rows, of each the used ones of its slots; in an order that does not depend on tasks.
    few = F.array_sort(F.array_intersect("__slots", F.lit(used.tolist()).cast("array<int>")))
    given = sorted((r.domain, r.fold, tuple(r.s)) for r in seen.select("domain", "fold", few.alias("s")).collect())
    x, y = np.zeros((len(given), len(used)), np.float32), np.zeros((len(given), d))
    for i, (domain, _, slots) in enumerate(given):
        x[i, np.searchsorted(used, slots)] = 1
        y[i, domains.index(domain)] = 1
    held = np.array([f == 0 for _, f, _ in given])
    tried = [fit_logistic(x[~held], y[~held], p) for p in PENALTIES]
    loss = [-float((y[held] * np.log(np.maximum(softmax(x[held] @ w[:-1] + w[-1]), 1e-12))).sum()) for w in tried]
    w = tried[int(np.argmin(loss))]
    weights = np.zeros((d - 1, WIDTH))
    weights[:, used] = (w[:-1, 1:] - w[:-1, :1]).T
    return Classifier(domains, w[-1, 1:] - w[-1, 0], weights)


def held_out_accuracy(docs: DataFrame, labels: DataFrame, domains: list[str], model: Classifier, max_train: int = 20000) -> DataFrame:
    """domain, rows, right, soft (sum of the posterior of the true domain) of the labelled rows that the classifier has not seen."""
    rows = featured(labelled(docs, labels, domains, max_train).where("fold = 0"), "__text")
    p = model.apply(rows, ["domain"])
    best = F.greatest(*[F.col(f"p_{d}") for d in domains])
    own = F.coalesce(*[F.when(F.col("domain") == d, F.col(f"p_{d}")) for d in domains])
    return p.groupBy("domain").agg(F.count("*").alias("rows"), F.count_if(own == best).alias("right"), F.sum(own).alias("soft"))


def rate_after(moves: list[list[float]], p: list[Column], cap: float | None) -> Column:
    """The rate after all ``moves``: a fold over their constants, from 1."""
    if not moves:
        return F.lit(1.0)

    def one(r: Column, m: Column) -> Column:
        r = F.greatest(F.lit(0.0), r - sum((F.element_at(m, j + 1) * x for j, x in enumerate(p)), F.lit(0.0)))
        return r if cap is None else F.least(F.lit(float(cap)), r)

    return F.aggregate(F.lit([[float(x) for x in m] for m in moves]), F.lit(1.0), one)


def fit_rates(soft: DataFrame, weights: dict[str, float], budget: float | None = None, cap: float | None = None, iterations: int = 24, tolerance: float = 1e-4) -> tuple[Column, dict[str, float]]:
    """(rate as an expression over p_<domain>, target tokens by domain)."""
    names = list(weights)
    d = len(names)
    p = [F.col(f"p_{x}") for x in names]
    have = soft.agg(*[F.coalesce(F.sum(F.col("tokens") * x), F.lit(0.0)) for x in p]).first()
    share = {x: w / sum(weights.values()) for x, w in weights.items()}
    if budget is None:
        budget = min((h / share[x] for x, h in zip(names, have, strict=True) if share[x] > 0), default=0.0)
    target = {x: budget * share[x] for x in names}
    if not sum(have):
        return F.lit(1.0), target
    t = np.array([target[x] for x in names])
    scale = np.maximum(t, 1e-3 * max(budget, 1.0))
    cells = [(i, j) for i in range(d) for j in range(i + 1)]
    moves: list[list[float]] = []
    step, accepted, size = np.zeros(d), math.inf, 1.0
    for _ in range(iterations):
        rows = soft.select("tokens", *p, rate_after(moves, p, cap).alias("r"))
        free = F.lit(True) if not moves else F.col("r") > 0 if cap is None else (F.col("r") > 0) & (F.col("r") < cap)
        h_of = [F.coalesce(F.sum(F.when(free, F.col("tokens") * p[i] * p[j])), F.lit(0.0)) for i, j in cells]
        got = [float(x) for x in rows.agg(*[F.sum(F.col("tokens") * x * F.col("r")) for x in p], *h_of).first()]
        miss = (np.array(got[:d]) - t) / scale
        error = float(miss @ miss)
        if moves and error >= accepted:  # the bounds took more than the step foresaw: half of it
            size /= 2
            moves[-1] = [float(x) for x in size * step / scale]
            continue
        accepted = error
        if np.abs(miss).max() < tolerance:
            break
        h = np.zeros((d, d))
        for (i, j), x in zip(cells, got[d:], strict=True):
            h[i, j] = h[j, i] = x / (scale[i] * scale[j])
        step, size = np.linalg.solve(h + np.eye(d) * 1e-6 * max(np.trace(h), 1e-12), miss), 1.0
        moves.append([float(x) for x in step / scale])
    else:
        moves = moves[:-1]  # the last one was not tried, or was no gain
    return rate_after(moves, p, cap), target


def posteriors_of(model: Classifier, docs: DataFrame) -> DataFrame:
    """doc_id, tokens and p_<domain> of every row of ``docs``."""
    return model.apply(featured(docs.select("doc_id", "text")), ["doc_id"])


def mix_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float | None = None, cap: float | None = None) -> DataFrame:
    """doc_id, tokens, p_<domain> and rate of every row of ``docs``; ``labels``: doc_id, domain."""
    model = fit_classifier(docs, labels, list(weights))
    soft = staged(posteriors_of(model, docs), "soft")
    rate, _ = fit_rates(soft, weights, budget, cap)
    return soft.withColumn("rate", rate)


def sample_documents(docs: DataFrame, labels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Rows of ``docs`` drawn with the chance of their rate (at most 1) by a hash of the id; all columns of ``docs``."""
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("doc_id"), F.col("text"))
    model = fit_classifier(docs, labels, list(weights))
    soft = staged(model.apply(featured(packed), ["row"]), "soft")
    rate, _ = fit_rates(soft, weights, cap=1.0)
    chance = F.pmod(F.xxhash64(F.lit("mix"), "row.doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return soft.where(chance < rate).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels").select("doc_id", label_domain().alias("domain"))
    return mix_documents(read_table(spark, sf_dir, "documents"), labels, WEIGHTS)
