"""The corpus pipeline: toxicity, exact and near duplicates, mixing, packing. Each stage reads what the one before kept.

In all stages: null text is empty; a null id is an id of its own; rows that repeat id and text are one document from the exact stage
on; ties go to the smallest id; extra columns of ``documents`` are dropped by the first stage; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, jaccard, mixing, packing, toxicity
from tessera.llm.common import fold, read_table, staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: near duplicates: shingles of five words, similarity of 0.8
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: target weights of the domains that the toxicity stage leaves: below the share of the low domain, so that clean documents stay
TARGETS = {"clean": 0.95, "low": 0.05}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is below the threshold stay. Learns from the labelled rows of the ``documents`` table itself."""
    labels = read_table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2)
    everything = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    examples = toxicity.labelled_sample(everything, labels, 16000)
    return toxicity.filter_documents(docs.select(*COLUMNS), examples)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    kept = exact_dedup.exact_dedup(docs).where("kept").select(F.col("doc_id").alias("keep_id"), "text_sha256")
    rows = docs.withColumn("__digest", exact_dedup.digest_of(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("__digest") == F.col("text_sha256"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__digest"]).drop("__digest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of similar texts stays."""
    kept = jaccard.similarity_classes(docs, NEAR_WORDS, NEAR_PERCENT).where("doc_id <=> component_id").select(F.col("doc_id").alias("keep_id"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("keep_id")), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row stays with a chance of its rate (at most 1), decided by a hash of its id."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", mixing.label_domain().alias("domain"))
    return mixing.sample_documents(docs, labels, TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(packing.TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]
#: SQL cannot express the classifier or the fitted rates
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, name.replace(" ", "-"))
    return docs
