"""Secret scanning with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its bytes. The ledger is a Parquet table of (blob,
rule_version, findings); a scan reads only the blobs that have no row for the present rule version, one copy of each, and
appends what it finds. Findings are joined back to all paths and versions that hold the blob, so a text that a third of
the paths share is scanned once and only its address is copied.

Nulls, ties and repeats: null content is empty and has no findings; repeated rows each get a row; null paths are kept; of
findings that start at the same place, the kind listed first comes first; an empty table gives no rows. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_dir, staged

#: Kinds in the order of a tie; the first three are the base. (kind, literals of which a text holds one, pattern, group to measure, least length)
RULES = (
    ("assign", (b"password", b"passwd", b"secret", b"token", b"api"), rb"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", (b"akia",), rb"AKIA[A-Z0-9]+", 0, 16),
    ("hex", (), rb"[0-9a-f]{32,}", 0, 32),
    ("private_key", (b"private key-----",), rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    ("forge_token", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), rb"gh[opsur]_[A-Za-z0-9]+", 0, 40),
    ("chat_token", (b"xox",), rb"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("jwt", (b"eyj",), rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
)
BASE = 3
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()[:16]
_HEX_MAP = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_COMPILED = [(k, lits, re.compile(p), g, n) for k, lits, p, g, n in RULES]
#: parts that the rows of one blob are dealt into while the ledger is asked
PARTS = 16
LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, rule number, end) in code points, sorted."""
    low = raw.lower()
    found = []
    for i, (kind, lits, pattern, group, least) in enumerate(_COMPILED):
        if kind == "hex":
            if b"x" * 32 not in raw.translate(_HEX_MAP):
                continue
        elif not any(x in low for x in lits):
            continue
        found += [(m.start(), i, m.end()) for m in pattern.finditer(raw) if m.end(group) - m.start(group) >= least]
    if found and not raw.isascii():
        chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        at = lambda b: int(chars[b - 1]) if b else 0
        found = [(at(s), i, at(e)) for s, i, e in found]
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for blob, body in zip(batch.column("blob").to_pylist(), batch.column("body"), strict=True):
            spans = find_spans(body.as_py() or b"")
            text = lambda x: ",".join(f"{RULES[i][0]}:{s}:{e}" for s, i, e in x)
            base = [x for x in spans if x[1] < BASE]
            rows.append((blob, RULE_VERSION, *(sum(x[1] == i for x in base) for i in range(BASE)), hashlib.sha256(text(base).encode()).hexdigest(), text(spans)))
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_versions(versions: DataFrame, content: str, ledger: str) -> DataFrame:
    """``versions`` plus blob and the findings; ``ledger`` (a Parquet path) grows by the blobs that it had not seen.

    The ledger is asked with digests; only texts of unseen blobs are shuffled. Two scans at once may both append a blob: a row
    of the ledger counts once. A version whose blob has no row in the ledger fails the job. Columns of ``versions`` that have the name
    of a result are replaced.
    """
    spark = versions.sparkSession
    body = F.coalesce(F.col(content), F.lit("")).cast("binary")
    addressed = versions.withColumn("__blob", F.sha2(body, 256))
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger)
    known = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == RULE_VERSION)
    blobs = addressed.select(F.col("__blob").alias("blob"), body.alias("body"))
    if not known.isEmpty():
        unseen = staged(blobs.select("blob").distinct().join(known.select("blob"), "blob", "left_anti"), "unseen")
        # Rows of a blob that many versions share are dealt into parts; the other side has digests alone.
        parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<long>"))
        dealt = blobs.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
        blobs = dealt.join(unseen.withColumn("part", parts), ["blob", "part"], "left_semi")
    # One copy of a blob per task leaves the scan; copies within and across tasks are merged by the aggregation.
    once = blobs.groupBy("blob").agg(F.first("body").alias("body"))
    once.mapInArrow(_scan, LEDGER).write.mode("append").parquet(ledger)
    return with_findings(versions, addressed, spark.read.schema(LEDGER).parquet(ledger).where(F.col("rule_version") == RULE_VERSION))


def with_findings(versions: DataFrame, addressed: DataFrame, findings: DataFrame) -> DataFrame:
    """Every version with the findings of its blob (``__blob`` of ``addressed``)."""
    found = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    one = staged(findings.select(F.col("blob").alias("__blob"), *[F.col(c).alias(f"__{c}") for c in found]).dropDuplicates(["__blob"]), "findings")
    kept = [c for c in versions.columns if c not in {"blob", *found}]
    thin = addressed.select(*[F.col(f"`{c}`") for c in kept], "__blob").join(one, "__blob", "left")
    gap = F.raise_error(F.concat(F.lit("no findings in the ledger for blob "), F.col("__blob"))).cast("long")
    return thin.select(*[F.col(f"`{c}`") for c in kept], F.col("__blob").alias("blob"), F.coalesce("__n_assign", gap).alias("n_assign"), *[F.col(f"__{c}").alias(c) for c in found[1:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = f"{shared_dir(spark)}/ledger"
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_versions(docs, "text", ledger).drop("text")
