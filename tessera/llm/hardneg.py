"""Hard negatives by inner product, found in an R-tree that is packed by sort-tile-recursive.

1. Rows of equal vector and label are one class with its few smallest ids (no list can need more of them).
2. Packing. Classes are cut into tiles of about ``tile_rows``: level by level into slabs of equal size along the components of the largest
   variance, by quantiles. A task packs a tile further, by label and the tile's own widest components, into leaves, and these into nodes.
   Boxes hold the range of every component and of the labels.
3. Search. For a query, a box's ranges give an interval of its inner products, component by component. A best-first queue takes the
   box with the largest upper end (cut at the upper end of the window). Boxes without a wanted label, outside the window of scores, or strictly below
   the kth score found are pruned.
   A query is searched in the tile it lies in first; its kth score there is a floor for all others. Pairs of a tile's box and a block of
   queries that no query of the block needs are dropped before a tile's rows are fetched.
4. Positives are the best rows of the same label. Each different positive score of a class opens one window for its negatives, rows of
   other labels.

The anchors are a stated query set against all rows, in blocks; blocks and tiles are bounded, so memory does not depend on the data.

Nulls, ties and repeats: rows with a null label or id, or a vector that is null or holds a null, NaN or infinite component take no part; of rows
that repeat an id the one with the smallest label, then vector stays. Ties of score go to the smaller id. Vectors of unequal length count as filled up
with zeros. Fewer positives or negatives than asked for are all returned. Scores are right while they are longs. Extra columns do not matter.
An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged, usable, whole_numbers

TILE = "tile long, n int, dim int, kind string, ids binary, counts binary, labels binary, vectors binary, cut binary"
ROOT = "tile long, dim int, low binary, high binary, label_low long, label_high long"
BLOCK = "home long, q_n int, q_dim int, classes binary, scores binary, q_labels binary, floors binary, q_vectors binary"
FOUND = "class long, positive_score long, id long, score long"
#: a query for rows of its own label has this in place of a positive's score
NONE = -(1 << 63)
#: slabs of a tile at each level of the distributed part
FAN_OUT = 16
LEAF, NODE = 64, 8


def labelled_vectors(df: DataFrame, scale: int = 256) -> DataFrame:
    """(id, label, v) of usable rows, each id once."""
    rows = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable("embedding"))
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole_numbers("embedding", scale).alias("v"))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def classes_of(rows: DataFrame, most: int) -> DataFrame:
    """(class, label, v, ids) of each distinct vector and label: ids are its ``most`` smallest ones, class the first."""
    nth = F.row_number().over(Window.partitionBy("v", "label").orderBy("id"))
    few = rows.withColumn("nth", nth).where(F.col("nth") <= most)
    return few.groupBy("v", "label").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("class"), "label", "v", "ids")


def tiled(classes: DataFrame, tile_rows: int) -> tuple[DataFrame, int]:
    """``classes`` with tile, and how many tiles there can be: slabs of slabs of equal size."""
    n = classes.count()
    wanted = max(1, math.ceil(n / tile_rows))
    levels = max(1, math.ceil(math.log(wanted, FAN_OUT) - 1e-9))
    spread = classes.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.var_pop("x").alias("spread")).orderBy(F.desc("spread"), "pos").limit(levels)
    axes = [r.pos for r in spread.collect()] or [0]
    tie = F.pmod(F.xxhash64("class"), F.lit(1 << 20)) / F.lit(float(1 << 20))  # equal components are cut, too
    out, tiles = classes, 1
    for level in range(levels):
        slabs = math.ceil((wanted / tiles) ** (1 / (levels - level)) - 1e-9)
        if slabs < 2:
            continue
        axis = axes[level % len(axes)]
        key = F.coalesce(F.try_element_at("v", F.lit(axis + 1)), F.lit(0)).cast("double") + tie
        cuts = F.percentile_approx("key", [(i + 1) / slabs for i in range(slabs - 1)], 10000).alias("cuts")
        below = F.size(F.filter("cuts", lambda c: c < F.col("__key"))).cast("long")
        if tiles == 1:  # FAN_OUT numbers at most
            first = out.select(key.alias("key")).agg(cuts).first().cuts
            out = out.withColumns({"__key": key, "cuts": F.lit(first or []).cast("array<double>")}).withColumn("tile", below)
        else:
            by_tile = out.select("tile", key.alias("key")).groupBy("tile").agg(cuts)
            out = out.withColumn("__key", key).join(by_tile, "tile").withColumn("tile", F.col("tile") * slabs + below)
        out = out.drop("__key", "cuts")
        tiles *= slabs
        if level < levels - 1:
            out = staged(out, "slabs")
    return (out if tiles > 1 else out.withColumn("tile", F.lit(0).cast("long"))), tiles


def _order(key: np.ndarray, leaf: int, axes: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """Leaves of the rows ``at``: slabs along the first axis, each cut along the rest."""
    leaves = -(-len(at) // leaf)
    if leaves <= 1 or not axes:
        return [at[i : i + leaf] for i in range(0, len(at), leaf)]
    slabs = math.ceil(leaves ** (1 / len(axes)) - 1e-9)
    size = -(-leaves // slabs) * leaf
    at = at[np.lexsort((key[at], axes[0][at]))]
    return [x for i in range(0, len(at), size) for x in _order(key, leaf, axes[1:], at[i : i + size])]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    v = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    v[np.arange(v.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return v


def _row(schema: str, values: list) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")]
    return pa.table({n: pa.array([v], t) for (n, t), v in zip(fields, values, strict=True)})


def _pack_tile(leaf: int):
    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        v, labels = _matrix(table.column("v")), table.column("label").to_numpy()
        ids = table.column("ids").combine_chunks()
        counts, flat = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
        widest = np.argsort(-v.var(axis=0), kind="stable")[:2]
        leaves = _order(np.arange(len(v)), leaf, [labels, *(v[:, d] for d in widest)], np.arange(len(v)))
        at = np.concatenate(leaves)
        start = np.cumsum(counts) - counts
        flat = np.concatenate([flat[start[i] : start[i] + counts[i]] for i in at])
        v, cut = v[at], np.cumsum([0, *map(len, leaves)])
        kind = next(t for t in ("<i2", "<i4", "<i8") if np.can_cast(np.min_scalar_type(int(v.min(initial=0))), t) and np.can_cast(np.min_scalar_type(-int(v.max(initial=0))), t))
        row = [table.column("tile")[0].as_py(), len(v), v.shape[1], kind, flat.astype("<i8").tobytes(), counts[at].astype("<u1").tobytes(), labels[at].astype("<i8").tobytes(), v.astype(kind).tobytes(), cut.astype("<i4").tobytes()]
        return _row(TILE, row)

    return pack


def _pack_block(table: pa.Table) -> pa.Table:
    table = table.sort_by([("class", "ascending"), ("positive_score", "ascending")])
    v = _matrix(table.column("v"))
    numbers = [table.column(c).to_numpy().astype("<i8").tobytes() for c in ("class", "positive_score", "label", "floor")]
    return _row(BLOCK, [table.column("home")[0].as_py(), len(v), v.shape[1], *numbers, v.astype("<i8").tobytes()])


class Boxes:
    """Ranges of components and labels of some boxes."""

    def __init__(self, low: np.ndarray, high: np.ndarray, label_low: np.ndarray, label_high: np.ndarray):
        self.low, self.high, self.label_low, self.label_high = low, high, label_low, label_high

    def grouped(self, cut: np.ndarray) -> Boxes:
        """Boxes around those from each cut to the next."""
        least, most = np.minimum.reduceat, np.maximum.reduceat
        return Boxes(least(self.low, cut[:-1], axis=0), most(self.high, cut[:-1], axis=0), least(self.label_low, cut[:-1]), most(self.label_high, cut[:-1]))

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries x boxes: ends of the inner products of anything inside, with room for rounding."""
        d = min(q.shape[1], self.low.shape[1])
        up, down = np.maximum(q[:, :d], 0).astype(float), np.minimum(q[:, :d], 0).astype(float)
        low, high = self.low[:, :d].astype(float), self.high[:, :d].astype(float)
        slack = 1e-12 * (np.abs(q[:, :d]).astype(float) @ np.maximum(np.abs(low), np.abs(high)).T)
        return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack

    def needed(self, b: Block, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Queries x boxes: whether a box can hold a wanted row, by labels, windows and floors."""
        label = b.labels[:, None]
        own = (self.label_low <= label) & (label <= self.label_high)
        other = ~((self.label_low == label) & (self.label_high == label))
        return np.where(b.negative[:, None], other & (high >= b.least[:, None]) & (low <= b.most[:, None]), own) & (high >= b.floors[:, None])


class Block:
    """Queries for rows of their own label, or of others in a window of scores."""

    def __init__(self, r: dict):
        whole = lambda c: np.frombuffer(r[c], "<i8")
        self.classes, self.scores, self.labels, self.floors = whole("classes"), whole("scores"), whole("q_labels"), whole("floors")
        self.v = whole("q_vectors").reshape(r["q_n"], r["q_dim"])
        self.negative = self.scores != NONE
        # Ends of the window with room for rounding; rows are tested in whole numbers.
        s = np.where(self.negative, self.scores, 0).astype(float)
        room = np.abs(s) * 1e-12
        self.least, self.most = 0.5 * s - room, np.where(self.negative, 0.95 * s + room, np.inf)


def _window(positive: int) -> tuple[int, int]:
    """The least and the largest score with 50 * positive <= 100 * score <= 95 * positive."""
    return -(-50 * positive // 100), 95 * positive // 100


class Tree:
    """The R-tree of one tile: leaves of rows, nodes of leaves, one root."""

    def __init__(self, r: dict):
        self.v = np.frombuffer(r["vectors"], r["kind"]).reshape(r["n"], r["dim"])
        self.labels, self.cut = np.frombuffer(r["labels"], "<i8"), np.frombuffer(r["cut"], "<i4")
        counts, ids = np.frombuffer(r["counts"], "<u1"), np.frombuffer(r["ids"], "<i8")
        self.ids, self.first = ids.tolist(), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).tolist()
        rows = Boxes(self.v, self.v, self.labels, self.labels)
        self.leaves = rows.grouped(self.cut)
        n = len(self.cut) - 1
        self.node_cut = np.append(np.arange(0, n, NODE), n)
        self.nodes = self.leaves.grouped(self.node_cut)

    def search(self, b: Block, k_own: int, k_other: int) -> list[tuple[int, int, int, int]]:
        """(class, positive_score, id, score) of the best rows of every query of the block. The windows of a class share one pass."""
        d = min(self.v.shape[1], b.v.shape[1])
        size = lambda x: float(np.abs(x.astype(float)).max(initial=0))
        small = size(self.v) * size(b.v) * max(1, d) < 2.0**52  # doubles are exact
        rows, asked = ((x[:, :d].astype(float if small else np.int64)) for x in (self.v, b.v))
        (node_ok, node_high), (leaf_ok, leaf_high) = [(boxes.needed(b, *ends), ends[1]) for boxes in (self.nodes, self.leaves) for ends in [boxes.intervals(b.v)]]
        cut, node_cut = self.cut.tolist(), self.node_cut.tolist()
        out: list[tuple[int, int, int, int]] = []
        starts = np.flatnonzero(np.append(True, b.classes[1:] != b.classes[:-1])).tolist()
        for i, j in zip(starts, [*starts[1:], len(b.v)], strict=True):
            negative = bool(b.negative[i])
            k = k_other if negative else k_own
            windows = [_window(int(s)) if negative else (NONE, -NONE - 1) for s in b.scores[i:j]]
            floors = [max(int(f), low) for f, (low, _) in zip(b.floors[i:j], windows, strict=True)]
            best: list[list[tuple[int, int]]] = [[] for _ in windows]
            least, most = min(floors), max(high for _, high in windows)
            top = np.minimum(leaf_high[i], b.most[i:j].max())
            wanted = leaf_ok[i:j].any(axis=0)
            queue = [(-min(node_high[i, n], most), n) for n in np.flatnonzero(node_ok[i:j].any(axis=0)).tolist()]
            heapq.heapify(queue)
            while queue and -queue[0][0] >= least:
                _, n = heapq.heappop(queue)
                if n >= 0:  # a node: its leaves (as negative numbers, so that they come first of equals)
                    for leaf in range(node_cut[n], node_cut[n + 1]):
                        if wanted[leaf] and top[leaf] >= least:
                            heapq.heappush(queue, (-top[leaf], -1 - leaf))
                    continue
                a, z = cut[-1 - n], cut[-n]
                score = rows[a:z] @ asked[i]
                label = self.labels[a:z] != b.labels[i] if negative else self.labels[a:z] == b.labels[i]
                for at in np.flatnonzero((score >= least) & (score <= most) & label).tolist():
                    s = int(score[at])
                    for w, (low, high) in enumerate(windows):
                        if max(low, floors[w]) <= s <= high:
                            best[w] = sorted(best[w] + [(-s, x) for x in self.ids[self.first[a + at] : self.first[a + at + 1]]])[:k]
                            if len(best[w]) == k:
                                floors[w] = max(floors[w], -best[w][-1][0])
                least = min(floors)
            out += [(int(b.classes[i]), int(b.scores[i + w]), x, -s) for w in range(j - i) for s, x in best[w]]
        return out


def _searched(k_own: int, k_other: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                cols = list(zip(*Tree(r).search(Block(r), k_own, k_other), strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The box of every tile."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            t = Tree(r)
            root = t.nodes.grouped(np.array([0, len(t.node_cut) - 1]))
            yield from _row(ROOT, [r["tile"], r["dim"], root.low.astype("<i8").tobytes(), root.high.astype("<i8").tobytes(), int(root.label_low[0]), int(root.label_high[0])]).to_batches()


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a tile and a block of queries, one of which needs the tile."""
    for batch in batches:
        kept = []
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            low, high = (np.frombuffer(r[c], "<i8").reshape(1, -1) for c in ("low", "high"))
            box, b = Boxes(low, high, np.array([r["label_low"]]), np.array([r["label_high"]])), Block(r)
            if box.needed(b, *box.intervals(b.v)).any():
                kept.append((r["tile"], r["home"]))
        cols = list(zip(*kept, strict=True)) or [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["tile", "home"])


class Forest:
    """The packed tiles of some classes, in the shared folder."""

    def __init__(self, classes: DataFrame, tile_rows: int, leaf: int = LEAF):
        dealt, self.n = tiled(classes, tile_rows)
        self.home = staged(dealt, "tiled")
        self.tiles = staged(self.home.groupBy("tile").applyInArrow(_pack_tile(leaf), TILE), "tiles")
        self.roots = staged(self.tiles.mapInArrow(_roots, ROOT), "roots")

    def best(self, asked: DataFrame, k_own: int, k_other: int) -> DataFrame:
        """FOUND of ``asked`` (class, positive_score, label, v, home): the best k of every query, ties to the smaller id."""
        key = ["class", "positive_score"]
        search = _searched(k_own, k_other)
        k = F.when(F.col("positive_score") == NONE, k_own).otherwise(k_other)
        start = staged(asked.withColumn("floor", F.lit(NONE)).groupBy("home").applyInArrow(_pack_block, BLOCK), "blocks")
        near = staged(start.join(self.tiles, F.col("home") == F.col("tile")).mapInArrow(search, FOUND), "near")
        floors = near.groupBy(*key).agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
        raised = asked.join(floors, key, "left").withColumn("floor", F.coalesce("least", F.lit(NONE))).drop("least")
        blocks = staged(raised.groupBy("home").applyInArrow(_pack_block, BLOCK), "blocks")
        homes = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.n - 1).cast("long")))
        pairs = self.roots.withColumn("home", homes).where("home <> tile").join(blocks, "home").mapInArrow(_alive, "tile long, home long")
        far = staged(pairs, "pairs").join(blocks, "home").join(self.tiles, "tile").mapInArrow(search, FOUND)
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "id"))
        return near.unionByName(far).withColumn("rank", nth).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, tile_rows: int = 4096, leaf: int = LEAF) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the anchors among ``rows`` (id, label, v)."""
    rows = staged(rows, "rows")
    forest = Forest(classes_of(rows, max(n_positives + 1, n_negatives)), tile_rows, leaf)
    classes = forest.home.select("class", "label", "v", F.col("tile").alias("home"))
    anchors = rows.where(is_anchor)
    members = staged(anchors.join(classes, ["v", "label"]).select(F.col("id").alias("anchor_id"), "class"), "members")
    asking = staged(classes.join(members.select("class").distinct(), "class", "left_semi"), "asking")
    own = forest.best(asking.withColumn("positive_score", F.lit(NONE)), n_positives + 1, n_negatives).select("class", F.col("id").alias("positive_id"), "score")
    others = members.join(staged(own, "own"), "class").where("positive_id <> anchor_id")
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    positives = staged(others.withColumn("nth", nth).where(F.col("nth") <= n_positives).select("anchor_id", "class", "positive_id", F.col("score").alias("positive_score")), "positives")
    windows = positives.where("positive_score >= 0").select("class", "positive_score").distinct().join(asking, "class")  # below 0 a window is empty
    negatives = staged(forest.best(windows, n_positives + 1, n_negatives).select("class", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), "negatives")
    return positives.join(negatives, ["class", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_vectors(read_table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS own, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
