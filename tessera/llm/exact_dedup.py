"""Exact deduplication with a log-structured merge index of text digests.

Batches of digests are memtables: each is collapsed to one entry per digest and flushed as a run sorted by digest, with
a filter of one bit per hash slot. An insertion reports its hits: digests that its memtable holds more than once, and digests that an
older run holds. For the latter the filters of the older runs are asked first, and a run is read only for digests whose bit is set.
When there are more than ``FAN_IN`` runs, compaction merges them into one entry per digest, with the smallest identifier, and builds the
filter of the merged run. Hits alone decide what is compared: every row of a hit digest is compared byte by byte with the row of the
digest's smallest identifier; rows that differ although their digests agree are split off and compared among themselves, so that a
collision merges nothing. Rows without a hit are single.

Nulls, ties and repeats: null text is empty text; rows that repeat both id and text are one document; rows of one id whose texts
differ, in blanks alone too, are documents of their own, of which at most one stays; a null id is an id of its own that sorts before all others;
equal rows with different ids are one group. An empty table gives no rows. Other columns
of the table do not matter, whatever their names.
Texts move through one shuffle, everything else is digests. A digest that a third of the rows share is one entry per task before the
shuffle (partial aggregation); where its rows meet texts, they are dealt into ``SALTS`` parts, and where they meet the text of their
head, into one part for every ``PART_ROWS`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_dir, staged

#: fixed value: the characters removed before texts are compared
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
_NO_ID = -(1 << 63)
#: bits in a filter: this many times the entries it is built for, at least one bitmap of 32768
BITS_PER_ENTRY = 16
#: rows of a memtable; a table is dealt into two of them at least
MEMTABLE_ROWS = 100_000_000
FAN_IN = 8
SALTS = 16
PART_ROWS = 64


def normalised(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), BLANKS, text)


def digest_of(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


class DigestIndex:
    """Sorted runs of (digest, first_id, n_rows) with filters, in the shared folder."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.runs: list[tuple[DataFrame, DataFrame, int]] = []

    @staticmethod
    def _slot(bits: int) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(bits))

    def _add(self, entries: DataFrame, name: str) -> DataFrame:
        """Write entries as a sorted run and build its filter."""
        run = staged(entries.repartitionByRange("digest").sortWithinPartitions("digest"), name)
        bits = max(32768, BITS_PER_ENTRY * run.count())
        slots = run.select(self._slot(bits).alias("slot"))
        filt = staged(slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")), "filter")
        self.runs.append((run, filt, bits))
        return run

    def _known(self, run: DataFrame) -> list[DataFrame]:
        """Digests of ``run`` that each older run holds: filters first, then the runs for what they let through."""
        found = []
        for older, filt, bits in self.runs[:-1]:
            slot = F.struct(F.bitmap_bucket_number("slot").alias("bucket"), F.bitmap_bit_position("slot").alias("bit"))
            asked = run.select("digest", self._slot(bits).alias("slot")).withColumn("at", slot).select("digest", "at.bucket", "at.bit")
            byte = F.conv(F.hex(F.substring("bits", F.expr("int(bit div 8) + 1"), F.lit(1))), 16, 10).cast("int")
            maybe = asked.join(filt, "bucket").where((F.call_function("shiftright", byte, (F.col("bit") % 8).cast("int")) % 2) == 1)
            found.append(maybe.select("digest").join(older.select("digest"), "digest", "left_semi"))
        return found

    def insert(self, memtable: DataFrame) -> DataFrame:
        """Flush (digest, id) as a run; returns the digests that are there more than once now."""
        run = self._add(memtable.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n_rows")), "run")
        hits = staged(reduce(DataFrame.union, self._known(run), run.where("n_rows > 1").select("digest")).distinct(), "hits")
        if len(self.runs) > self.fan_in:
            self.compact()
        return hits

    def compact(self) -> DataFrame:
        """Merge all runs into one, with a filter of its own; the smallest identifier of a digest stays."""
        if len(self.runs) == 1:
            return self.runs[0][0]
        merged = reduce(DataFrame.unionByName, [r for r, _, _ in self.runs]).groupBy("digest").agg(F.min("first_id").alias("first_id"), F.sum("n_rows").alias("n_rows"))
        self.runs = []
        return self._add(merged, "compacted")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable_rows: int = MEMTABLE_ROWS, digest: Column | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: id, n_chars, digest, whole (a hash of the original text), variant (0 but for collisions), n_rows (rows of the
    digest); equal texts share digest and variant. ``digest``: another digest expression, for tests with collisions."""
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"),
        (digest_of(F.col(text_col)) if digest is None else digest).alias("digest"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("whole"),
        F.col(text_col).alias("body"),
    )
    batches = max(2, -(-docs.count() // memtable_rows))
    path = f"{shared_dir(spark)}/digests"
    dealt = rows.select("id", "n_chars", "digest", "whole", F.pmod(F.xxhash64("id", "n_chars"), F.lit(batches)).alias("batch"))
    dealt.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    thin = spark.read.schema(dealt.schema).parquet(path)
    index = DigestIndex(spark, fan_in)
    hits = [index.insert(thin.where(F.col("batch") == b).select("digest", "id")) for b in range(batches)]
    # A hit of an early batch can be found again later; a hit of a late one is in the compacted run like all others.
    many = staged(reduce(DataFrame.union, hits).distinct().join(index.compact(), "digest"), "many")
    salted = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("long"))
    # By a shuffle at every size: hits grow with the corpus.
    met = rows.withColumn("salt", F.pmod(F.xxhash64("id", "n_chars"), F.lit(SALTS))).join(salted.hint("merge"), ["digest", "salt"])
    members = staged(met.select("digest", "id", "first_id", "n_rows", "n_chars", "whole", normalised(F.col("body")).alias("body")), "members")
    parts = F.floor((F.col("n_rows") - 1) / F.lit(PART_ROWS)) + 1
    variants, variant = [], 0
    while True:
        heads = members.where("id = first_id").groupBy("digest", "n_rows").agg(F.min("body").alias("head"))
        heads = heads.select("digest", "head", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
        # The rows behind the heads' aggregation and the members are two shuffles, so that Spark can split what is still large.
        checked = members.withColumn("part", F.pmod(F.xxhash64("id", "n_chars"), parts)).join(heads, ["digest", "part"])
        same = F.col("body") == F.col("head")
        verdict = staged(checked.select("digest", "id", "n_rows", "n_chars", "whole", same.alias("same"), F.when(~same, F.col("body")).alias("body")), "verified")
        variants.append(verdict.where("same").select("digest", "id", "n_rows", "n_chars", "whole", F.lit(variant).alias("variant")))
        rest = verdict.where("not same")
        if rest.isEmpty():
            break
        first = rest.groupBy("digest").agg(F.min("id").alias("first_id"))
        members, variant = staged(rest.join(first, "digest").select("digest", "id", "first_id", "n_rows", "n_chars", "whole", "body"), "collisions"), variant + 1
    single = thin.join(many.select("digest"), "digest", "left_anti").select("digest", "id", F.lit(1).cast("long").alias("n_rows"), "n_chars", "whole", F.lit(0).alias("variant"))
    groups = reduce(DataFrame.unionByName, variants).dropDuplicates(["digest", "variant", "id", "whole"])
    return single.unionByName(groups)


def exact_dedup(docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS, digest: Column | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: of equal texts the longest original stays, then the smallest id."""
    rows = staged(exact_groups(docs, memtable_rows=memtable_rows, digest=digest, fan_in=fan_in), "groups")
    parts = F.floor((F.col("n_rows") - 1) / F.lit(64 * PART_ROWS)) + 1
    several = rows.where("n_rows > 1")
    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), "id", "whole"))
    groups = staged(several.groupBy("digest", "variant", "n_rows").agg(best["id"].alias("keep"), best["whole"].alias("keep_whole"), F.count("*").alias("group_size")), "best")
    groups = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("n_rows")
    joined = several.withColumn("part", F.pmod(F.xxhash64("id", "n_chars"), parts)).join(groups, ["digest", "variant", "part"])
    kept = (F.col("id") == F.col("keep")) & (F.col("whole") == F.col("keep_whole"))
    alone = rows.where("n_rows = 1").select("digest", "id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    out = joined.select("digest", "id", "keep", "group_size", kept.alias("kept")).unionByName(alone)
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return out.select(real("id").alias("doc_id"), real("keep").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256
      FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
