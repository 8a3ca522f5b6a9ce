"""Places of rows in their group, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .windows import met, numbered_name

#: rows of a group that one task ranks; larger groups are cut into ranges
HOT_ROWS = 1 << 20


def hot_groups(rows: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Keys of more than ``hot_rows`` rows; as many of them at most as ``hot_rows`` goes into all rows."""
    return rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows).drop("__n")


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with their place (from 1) among those of equal ``keys``, in ascending ``order``; null keys are equal.

    Groups of more than ``hot_rows`` rows are dealt by range over key and order and written in that order. The place is the one in the range, plus
    the counts of the group's ranges before it; no task holds such a group. Rows of equal order may be told apart by any of their columns.
    ``rows`` are counted first, so that what is costly to make should be written before.
    """
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if rows.count() <= hot_rows:
        return rows.withColumn(name, nth)
    hot = kept(hot_groups(rows, keys, hot_rows))
    if hot.isEmpty():
        return rows.withColumn(name, nth)
    marked = met(rows, F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    cold = marked.where("__hot IS NULL").drop("__hot").withColumn(name, nth)
    own = [f"__o{i}" for i in range(len(order))]
    large = marked.where("__hot").drop("__hot").withColumns(dict(zip(own, order, strict=True))).withColumn("__tie", F.xxhash64(*rows.columns))
    by = [*keys, *own, "__tie"]
    placed = kept(large.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    spans = placed.groupBy(*keys, "__part").agg(F.min("__at").alias("__from"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.withColumn("__before", before).drop("__n")
    place = (F.col("__at") - F.col("__from") + F.col("__before") + 1).cast("int")
    return cold.unionByName(met(placed, spans, [*keys, "__part"]).withColumn(name, place).select(cold.columns))


def keep_first(rows: DataFrame, key: str, order: list[Column], hot_rows: int = HOT_ROWS) -> DataFrame:
    """All rows with rank in their group of equal keys, in ascending order, and rejected (not the first)."""
    return ranked(rows, [key], order, "rank", hot_rows).withColumn("rejected", F.col("rank") > 1)


def unique_names(rows: DataFrame, name: str, order: list[Column], rounds: int = 4, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``unique_name``: the kth claimant of a name (case ignored) gets `` [recovered copy k]``; later rounds give a higher number where
    the new name is taken. ``clash`` marks rows whose name is still taken by an earlier row after all rounds.

    All claimants of a name meet in the first round only; later ones are small groups.
    """
    nth = F.row_number().over(Window.partitionBy("__folded").orderBy(*order))
    fold = lambda df: df.withColumn("__folded", F.lower("unique_name"))
    out = fold(rows.withColumns({"unique_name": F.col(name), "__k": F.lit(1)}))
    for n in range(rounds):
        out = out.withColumn("__nth", nth) if n else ranked(out, ["__folded"], order, "__nth", hot_rows)
        out = fold(out.withColumn("__k", F.col("__k") + F.col("__nth") - 1).withColumn("unique_name", numbered_name(F.col(name), F.col("__k"))))
    last = out.withColumn("__nth", nth) if rounds else ranked(out, ["__folded"], order, "__nth", hot_rows)
    return last.withColumn("clash", F.col("__nth") > 1).drop("__k", "__nth", "__folded")
