"""Product codes of vectors by rounds of assignment and averaging, with norm-of-sum bounds.

Every vector is cut into ``parts`` equal parts; each part position has a codebook of ``size`` entries. A round assigns each part to its
nearest entry and moves every entry to the mean of its parts, rounded down; all numbers are whole.

An assignment keeps, for each part and each group of ``GROUP`` entries, a lower bound of the distance to all entries of the group
but the assigned one, and the round in which the bound was found (its stamp). All earlier codebooks are kept. In a later
round the part's distance to its own entry is computed; a bound of stamp s falls by the largest net displacement of the group's
entries since s, the norm of the sum of their moves, which is never more than the sum of the norms. A group is scanned anew, and its bound stamped
with the round, only if what is left of the bound does not exceed the own distance.

A round is one pass of tasks over stored rows, without a shuffle, and one aggregation to (part, entry, component); the codebooks are small whatever
the corpus, and bounds travel with their rows. Each round is written to the shared folder.

Nulls, ties and repeats: vectors that are null or hold a null, NaN or infinite component take no part; whole components and errors beyond a long
are its ends; shorter vectors are filled up with zeros to the longest, and that to a multiple of ``parts``. The first entries are those of the smallest
ids, null ids last, of equal ids the smallest vector; with fewer rows there are fewer entries. Distances tie to the lower index, rows that
repeat an id are rows of their own, null labels are one label. Extra columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, staged, usable, whole_numbers

GROUP = 8
END = (1 << 63) - 1
SALTS = 16
#: entries of a codebook, by part: whole numbers, parts x entries x components
Book = np.ndarray
STATE = "vec_id long, label long, v array<long>, code binary, error long, rescans long, low binary, stamp binary"


def _parts(column: pa.Array, parts: int, width: int) -> np.ndarray:
    """Rows x parts x components, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    v = np.zeros((len(sizes), parts * width), np.int64)
    v[np.arange(parts * width) < sizes[:, None]] = column.flatten().to_numpy()
    return v.reshape(len(sizes), parts, width)


def _most(x: np.ndarray) -> int:
    """The largest magnitude, of longs that may be the least one."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _numbers(x: np.ndarray, book: Book) -> tuple[np.ndarray, Book]:
    """Both in a type in which squared distances are exact: doubles while they are small enough, else Python's own."""
    most = max(_most(x), int(np.abs(book).max(initial=0)))
    kind = np.float64 if (2 * most) ** 2 * max(1, book.shape[-1]) < 2**52 else object
    return x.astype(kind), book.astype(kind)


def _squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)
    return d if len(entries) else d.reshape(len(x), 0)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


class Bounds:
    """Assignments of one part of many rows, and the bounds of every group with their stamps."""

    def __init__(self, code: np.ndarray, low: np.ndarray, stamp: np.ndarray):
        self.code, self.low, self.stamp = code, low, stamp

    @classmethod
    def scanned(cls, x: np.ndarray, entries: np.ndarray, groups: list[slice]) -> Bounds:
        """By a scan of all entries, in round 0."""
        d = _squared(x, entries)
        code = np.argmin(d, axis=1) if len(x) else np.empty(0, np.int64)
        far = _root(d)
        far[np.arange(len(x)), code] = np.inf
        low = np.stack([far[:, g].min(axis=1) for g in groups], axis=1) if len(x) else np.empty((0, len(groups)))
        return cls(code, _down(low), np.zeros(low.shape, np.uint8))

    def advance(self, x: np.ndarray, history: list[np.ndarray], groups: list[slice]) -> np.ndarray:
        """To the last codebook of ``history``; returns how many groups of each row were scanned."""
        now, entries = len(history) - 1, history[-1]
        # Net moves since every earlier round, the largest in each group, rounded up.
        moved = np.stack([[_root(((entries[g] - old[g]) ** 2).sum(axis=1)).max(initial=0) for g in groups] for old in history]) * (1 + 1e-9)
        own = _one_each(x, entries, self.code)
        # A group that does not need a scan keeps its bound and stamp: its later loss is measured from that stamp, in one piece.
        needed = self.low - moved[self.stamp, np.arange(len(groups))] <= _root(own)[:, None] * (1 + 1e-9)
        best, new, first = own, self.code.copy(), self.code
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k, g in enumerate(groups):
            at = np.flatnonzero(needed[:, k])
            if not len(at):
                continue
            d = _squared(x[at], entries[g])
            seen[k] = at, d
            j = np.argmin(d, axis=1)
            least, index = d[np.arange(len(at)), j], j + g.start
            better = (least < best[at]) | ((least == best[at]) & (index < new[at]))
            best[at[better]], new[at[better]] = least[better], index[better]
        for k, (at, d) in seen.items():
            far = _root(d)
            inside = (new[at] >= groups[k].start) & (new[at] < groups[k].stop)
            far[np.flatnonzero(inside), new[at][inside] - groups[k].start] = np.inf
            self.low[at, k], self.stamp[at, k] = _down(far.min(axis=1)), now
        # The entry that was left belongs to its group's rest again; a group that was not scanned gets a bound of this round.
        left = np.flatnonzero(new != first)
        if len(left):
            group = first[left] // GROUP
            unseen = left[~needed[left, group]]
            g = first[unseen] // GROUP
            bound = self.low[unseen, g] - moved[self.stamp[unseen, g], g]
            self.low[unseen, g] = _down(np.minimum(bound, _root(_one_each(x[unseen], entries, first[unseen]))))
            self.stamp[unseen, g] = now
        self.code = new
        return needed.sum(axis=1)


def _down(x: np.ndarray) -> np.ndarray:
    """A little less, in four bytes: roots and four bytes are not exact."""
    return np.nextafter((x * (1 - 1e-9)).astype(np.float32), np.float32(-np.inf))


def _one_each(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Squared distance of each row to its own entry."""
    return ((x - entries[code]) ** 2).sum(axis=1)


def _assigner(history: list[Book]):
    """``STATE`` of rows (vec_id, label, v) by the first codebooks, or of rows of ``STATE`` by the last ones."""
    parts, size, width = history[-1].shape
    groups = [slice(a, min(a + GROUP, size)) for a in range(0, size, GROUP)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _parts(batch.column("v"), parts, width)
            n = len(x)
            first = len(history) == 1
            x, _ = _numbers(x, np.stack(history))
            books = [b.astype(x.dtype) for b in history]
            code, scans = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
            low, stamp = np.zeros((n, parts, len(groups)), np.float32), np.zeros((n, parts, len(groups)), np.uint8)
            if not first:
                read = lambda c, t, *shape: np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(n, *shape).copy()
                code, low, stamp = read("code", np.uint8, parts), read("low", np.float32, parts, len(groups)), read("stamp", np.uint8, parts, len(groups))
            total = np.zeros(n, object)
            for p in range(parts):
                if first:
                    b = Bounds.scanned(x[:, p], books[0][p], groups)
                else:
                    b = Bounds(code[:, p].astype(np.int64), low[:, p].copy(), stamp[:, p].copy())
                    scans += b.advance(x[:, p], [c[p] for c in books], groups)
                code[:, p], low[:, p], stamp[:, p] = b.code, b.low, b.stamp
                d = _one_each(x[:, p], books[-1][p], b.code)
                total += d if d.dtype == object else d.astype(np.int64).astype(object)
            packed = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            error = pa.array([min(int(e), END) for e in total], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "v")), packed(code), error, pa.array(scans), packed(low), packed(stamp)], names=[f.split()[0] for f in STATE.split(", ")])

    return run


def _sums(shape: tuple[int, int, int]):
    """part, entry, pos, sum, count of all rows of a task."""
    parts, size, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(shape, object), np.zeros((parts, size), np.int64)
        for batch in batches:
            x = _parts(batch.column("v"), parts, width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(x), parts)
            safe = _most(x) * max(1, len(x)) < 2**62
            for p in range(parts):
                got = np.zeros((size, width), np.int64 if safe else object)
                np.add.at(got, code[:, p], x[:, p] if safe else x[:, p].astype(object))
                sums[p] += got.astype(object)
                counts[p] += np.bincount(code[:, p], minlength=size)
        p, k = np.nonzero(counts)
        rows = [(int(a), int(b), j, str(int(sums[a, b, j])), int(counts[a, b])) for a, b in zip(p, k, strict=True) for j in range(width)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "entry", "pos", "sum", "n"])

    return run


def moved_book(state: DataFrame, book: Book) -> Book:
    """Every entry at the mean of its parts, rounded down; entries without parts stay."""
    sums = state.select("v", "code").mapInArrow(_sums(book.shape), "part int, entry int, pos int, sum string, n long")
    total = sums.groupBy("part", "entry", "pos").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    out = book.copy()
    for r in total.collect():  # one row a number of the codebooks at most
        out[r.part, r.entry, r.pos] = int(r.s) // r.n
    return out


def first_book(rows: DataFrame, parts: int, size: int) -> Book:
    """The parts of the ``size`` smallest ids as entries."""
    longest = rows.agg(F.max(F.size("v")).alias("n")).first().n or 0
    width = -(-longest // parts)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(size).select("v").collect()  # ``size`` rows
    book = np.zeros((parts, len(first), width), object)
    for i, r in enumerate(first):
        flat = np.array(r.v + [0] * (parts * width - len(r.v)), object)
        book[:, i, :] = flat.reshape(parts, width)
    return book


def book_digest(book: Book) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in book.ravel()).encode()).hexdigest()


def encode(rows: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2) -> tuple[DataFrame, Book]:
    """(vec_id, label, code in bytes, error, rescans of the last round; the codebooks) of rows (vec_id, label, v)."""
    if not 1 <= size <= 256 or not 0 <= rounds <= 255:
        raise ValueError("codes and stamps have one byte")
    rows = staged(rows, "vectors")
    history = [first_book(rows, parts, size)]
    if not history[0].shape[1]:  # no row
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("rescans")), history[0]
    state = staged(rows.mapInArrow(_assigner(history), STATE), "round")
    for _ in range(rounds):
        history.append(moved_book(state, history[-1]))
        state = staged(state.mapInArrow(_assigner(history), STATE), "round")
    return state.select("vec_id", "label", "code", "error", "rescans"), history[-1]


def compress(vectors: DataFrame, parts: int = 16, size: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, rescans (groups of entries scanned again in the last round) of every usable row."""
    rows = vectors.where(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole_numbers("embedding", scale).alias("v"))
    coded, book = encode(rows, parts, size, rounds)
    # Many labels are joined by a shuffle, of which a hot one is dealt into parts; a small table Spark broadcasts by its size.
    by_label = staged(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(END)).cast("long").alias("label_error")), "labels").withColumnRenamed("label", "__label")
    salted = by_label.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    dealt = coded.withColumn("__at", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
    out = dealt.join(salted, F.col("label").eqNullSafe(F.col("__label")) & (F.col("__at") == F.col("__salt")))
    code = F.lower(F.hex("code"))
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"), "rescans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings")).drop("rescans")


_DIST = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _nearest(book: str) -> str:
    return f"(SELECT row, p, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT row, p, k, {_DIST} AS d FROM x JOIN {book} USING (p)) GROUP BY row, p)"


def _means(book: str, assigned: str) -> str:
    each = f"SELECT p, k, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM {assigned} JOIN x USING (row, p), range(1, 1 + len(x)) t(i) GROUP BY p, k, i"
    return f"(SELECT p, k, coalesce(m, c) AS c FROM {book} LEFT JOIN (SELECT p, k, list(m ORDER BY i) AS m FROM ({each}) GROUP BY p, k) USING (p, k))"


ORACLE = f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT row, p, e[p * (len(e) // 16) + 1 : (p + 1) * (len(e) // 16)] AS x FROM v, range(16) t(p)),
c0 AS (SELECT p, row - 1 AS k, x AS c FROM x WHERE row <= 64),
a0 AS {_nearest("c0")},
c1 AS {_means("c0", "a0")},
a1 AS {_nearest("c1")},
c2 AS {_means("c1", "a1")},
a2 AS {_nearest("c2")},
r AS (SELECT row, string_agg(format('{{:02x}}', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY row),
s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN v USING (row), s
"""
