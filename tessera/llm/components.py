"""Connected components of a table of links, by repeated minimum labels with shortcuts; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the label is the smallest node of its component.

    A round takes each node's smallest label among itself and its neighbours, pre-aggregated before the shuffle, and
    then follows labels once more, so that chains shorten by half or better.
    """
    both = staged(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        better = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("seen", "label")).alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        hopped = better.join(far, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        step = staged(hopped, "labels")
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels
