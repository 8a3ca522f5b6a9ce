"""Generation fold: a newer generation replaces the chosen one only if it loses nothing."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from .windows import met


def _fold(rows: pa.Table) -> pa.Table:
    own = rows.filter(pc.equal(rows["old"], rows["new"])).sort_by("new")
    size, names, files = (dict(zip(own["new"].to_pylist(), own[c].to_pylist(), strict=True)) for c in ("keys", "names", "files"))
    covers = {(o, n) for o, n, k in zip(*(rows[c].to_pylist() for c in ("old", "new", "keys")), strict=True) if k == size[o]}
    states, reasons, chosen = [], [], None
    for g in own["new"].to_pylist():
        better = chosen is None or (chosen, g) in covers and names[g] >= names[chosen]
        if not better:
            reasons.append("loses")
        elif chosen is None:
            reasons.append("first")
        else:
            reasons.append("more" if files[g] > files[chosen] else "names" if names[g] > names[chosen] else "newer")
        chosen = g if better else chosen
        states.append("promoted" if better else "alternate")
    return pa.table({"item": own["item"], "generation": own["generation"], "state": pa.array(states, pa.string()), "reason": pa.array(reasons, pa.string())})


def generation_fold(files: DataFrame, item: str, generation: str, sha: str, reachable: Column | None = None, named: Column | None = None) -> DataFrame:
    """item, generation, state (promoted or alternate), reason, in the order of generations (null last).

    A generation is promoted if it has every hash of the chosen one at least as often, among its ``reachable`` files too, and at
    least as many ``named`` files (those with a validated name); without these two columns, copies alone decide. The reason is first, more
    (copies), names (more of them), newer (as good), or loses.

    Every (item, hash) meets its counts of all generations, and says which pairs of generations it lets pass; sums over
    hashes are one row per pair of generations of one item. Only those reach the fold, which depends on order.
    """
    count = lambda c: F.lit(0) if c is None else F.count_if(F.coalesce(c, F.lit(False)))
    bags = files.groupBy(F.col(item).alias("item"), F.col(generation).alias("generation"), F.col(sha).alias("s")).agg(F.count("*").alias("n"), count(reachable).cast("long").alias("r"), count(named).cast("long").alias("v"))
    per = bags.groupBy("item", "s").agg(F.collect_list(F.struct("generation", "n", "r", "v")).alias("x"))
    pairs = per.select("item", "x", F.explode("x").alias("a")).select("item", "a", F.explode("x").alias("b")).where("b.n >= a.n AND b.r >= a.r")
    sums = pairs.groupBy("item", F.col("a.generation").alias("before"), F.col("b.generation").alias("generation")).agg(F.count("*").alias("keys"), F.sum("b.v").alias("names"), F.sum("b.n").alias("files"))
    place = lambda c: F.dense_rank().over(Window.partitionBy("item").orderBy(F.asc_nulls_last(c)))
    ranked = sums.select("item", "generation", place("before").alias("old"), place("generation").alias("new"), "keys", "names", "files")
    return ranked.groupBy("item").applyInArrow(_fold, ranked.select("item", "generation", F.lit("").alias("state"), F.lit("").alias("reason")).schema)


def generation_choice(files: DataFrame, item: str, generation: str, image: str, path: str, sha: str, size: str, named: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(item, generation, state, reason, files, bytes, reachable, names; refused items) of recovered files.

    A file is what its hash and size say; files below system folders do not count, and those below the folder of a recovery by signature, directory or
    fragment are not reachable. Generations of one item have to come from one image: else the item is refused (different_images).
    A generation without a counted file is one with no coverage. A null image is an image of its own.
    """
    images = files.groupBy(F.col(item).alias("item")).agg((F.countDistinct(image) + F.max(F.col(image).isNull().cast("int")) > 1).alias("mixed"))
    refused = images.where("mixed").select("item", F.lit("different_images").alias("reason"))
    fine = files.withColumn("__item", F.col(item)).join(refused.select(F.col("item").alias("__no")), F.col("__item").eqNullSafe(F.col("__no")), "left_anti")
    name = F.lit(False) if named is None else F.coalesce(named, F.lit(False))
    rows = fine.select(
        F.col(item).alias("item"), F.col(generation).alias("generation"), F.struct(F.col(sha).alias("s"), F.col(size).alias("n")).alias("key"), F.col(size).alias("bytes"),
        paths.counted(F.col(path)).alias("counted"), paths.reachable(F.col(path)).alias("reachable"), name.alias("named"),
    )
    # Every generation has one row more, the same in all, so that one without a counted file is there, too.
    always = rows.select("item", "generation").distinct().select("item", "generation", F.lit(None).cast(rows.schema["key"].dataType).alias("key"), F.lit(True).alias("reachable"), F.lit(False).alias("named"))
    folded = generation_fold(rows.where("counted").select(*always.columns).unionByName(always), "item", "generation", "key", F.col("reachable"), F.col("named"))
    seen = F.col("counted")
    totals = rows.groupBy("item", "generation").agg(F.count_if(seen).alias("files"), F.coalesce(F.sum(F.when(seen, F.col("bytes"))), F.lit(0)).alias("bytes"), F.count_if(seen & F.col("reachable")).alias("reachable"), F.count_if(seen & F.col("named")).alias("names"))
    return met(folded, totals, ["item", "generation"]), refused
