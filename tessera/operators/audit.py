"""Audit of items: what each item's image, recovered files and conversions prove, and what stands against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: statuses of the three parts and of the evidence as a whole
VERIFIED, PARTIAL, DERIVED = "IMAGE_FILES_CONVERSIONS_VERIFIED", "PARTIAL_IMAGE_READ", "DERIVED_RECOVERY"
CUSTODY, CONFLICTS, CONVERSION, CHECK = "OPERATOR_CUSTODY_ONLY", "CONFIRMED_CROSS_READER_CONFLICTS", "CHECK_CONVERSION", "CHECK"


def audit_items(attempts: DataFrame, images: DataFrame, extractions: DataFrame, conversions: DataFrame | None) -> DataFrame:
    """One row per row of ``attempts``: image_hash_verified, extraction_status, extracted_files, extracted_bytes, conversion_status, conversion_jobs,
    outputs_verified, evidence_status, issues (short names, in the order in which they are found).

    ``attempts`` (the chosen one of each item): item, status, bad, unread, sha, legacy, attention, custody, log_sha (null: no claim), expected_bytes.
    ``images``: item, sha (null: cannot be read), bytes. ``extractions``: item, kind (automatic, manual, invalid), verified, files, bytes, attention.
    ``conversions``: item, jobs, verified, issues; None: never audited. An image that is missing, unreadable or another one ends the audit of its item.
    Items are unique in each table; null flags are false, null counts 0.
    """
    side = lambda df, p, cols: df.select(F.col("item").alias(f"__{p}"), *[F.col(c).alias(f"{p}_{c}") for c in cols])
    j = attempts.join(side(images, "i", ["sha", "bytes"]), F.col("item") == F.col("__i"), "left").join(side(extractions, "e", ["kind", "verified", "files", "bytes", "attention"]), F.col("item") == F.col("__e"), "left")
    audited = conversions is not None
    if conversions is not None:
        j = j.join(side(conversions, "c", ["jobs", "verified", "issues"]), F.col("item") == F.col("__c"), "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    same = lambda a, b: F.lower(a) == F.lower(b)
    recorded = F.coalesce(F.col("sha"), F.lit("")) != ""
    stop = F.when(F.col("__i").isNull(), "image_missing").when(F.col("i_sha").isNull(), "image_unreadable").when(recorded & ~same(F.col("sha"), F.col("i_sha")), "image_hash_differs")
    j = j.withColumn("__stop", stop)
    on = F.col("__stop").isNull()
    automatic = F.col("e_kind") == "automatic"
    native = F.coalesce(automatic, F.lit(False)) & yes("e_attention")
    files_ok = on & F.coalesce(automatic & F.col("e_verified"), F.lit(False))
    extraction = F.when(~on | F.col("e_kind").isNull(), "MISSING").when(F.col("e_kind") == "manual", "MANUAL_UNVERIFIED").when(files_ok, F.when(native, "PARTIAL_VERIFIED_FILES").otherwise("VERIFIED")).otherwise("INVALID")
    j = j.withColumns({"__native": on & native, "__files_ok": files_ok, "extraction_status": extraction, "image_hash_verified": on & recorded})
    known = F.col("extraction_status").isin("VERIFIED", "PARTIAL_VERIFIED_FILES", "MANUAL_UNVERIFIED")
    has_row = F.col("__c").isNotNull() if audited else F.lit(False)
    clean = (none("c_issues") == 0) if audited else F.lit(False)
    conversion = F.when(~on | F.lit(not audited), "NOT_RUN").when(~has_row, "NO_CANDIDATES").when(clean, "VERIFIED").otherwise("CHECK")
    j = j.withColumns({
        "extracted_files": F.when(known, none("e_files")).otherwise(0).cast("long"), "extracted_bytes": F.when(known, none("e_bytes")).otherwise(0).cast("long"), "conversion_status": conversion,
        "conversion_jobs": F.when(on, none("c_jobs")).otherwise(0).cast("long") if audited else F.lit(0).cast("long"), "outputs_verified": F.when(on, none("c_verified")).otherwise(0).cast("long") if audited else F.lit(0).cast("long"),
    })
    issue = lambda condition, name: F.when(on & condition, name)
    found = F.array_compact(F.array(
        F.col("__stop"), issue(yes("legacy") & ~F.col("expected_bytes").eqNullSafe(F.col("i_bytes")), "extent_differs"), issue(yes("legacy") & F.col("log_sha").isNotNull() & ~same(F.col("log_sha"), F.col("i_sha")), "log_hash_differs"),
        issue(none("unread") > 0, "unread_positions"), issue(F.col("extraction_status") == "INVALID", "extraction_invalid"), issue(F.col("extraction_status") == "MANUAL_UNVERIFIED", "manual_recovery"),
        issue(F.col("extraction_status") == "MISSING", "no_extraction"), issue(F.col("conversion_status") == "CHECK", "conversion_issues"),
    ))
    j = j.withColumn("__found", found)
    silent, attention, converted = F.size("__found") == 0, yes("attention") | F.col("__native"), F.col("conversion_status").isin("VERIFIED", "NO_CANDIDATES")
    proven = F.col("image_hash_verified") & silent & ~attention & F.col("__files_ok") & (F.col("extracted_files") > 0) & converted
    empty, unhashed = (F.col("extracted_files") == 0) & silent, ~F.col("image_hash_verified") & silent
    base = F.when(~on, CHECK).when(proven, VERIFIED).when(attention, F.when(F.col("status") == "DERIVED", DERIVED).otherwise(PARTIAL)).when(empty | unhashed, CHECK).when(~converted, CONVERSION).otherwise(CHECK)
    added = F.when(~on | proven | ~silent, None).when(attention, "unresolved_positions").when(empty, "no_recovered_files").when(unhashed, "no_recorded_hash").when(~converted, "conversion_not_audited")
    custody = on & ~yes("legacy") & yes("attention") & yes("custody")
    crossed = on & ~yes("legacy") & yes("attention") & (F.col("status") == "OK") & (none("bad") == 0)
    last = F.when(custody, "custody_only").when(crossed, "reader_conflicts")
    evidence = F.when(custody, CUSTODY).when(crossed, CONFLICTS).otherwise(base)
    issues = F.concat("__found", F.array_compact(F.array(added, last)))
    return j.select("item", "image_hash_verified", "extraction_status", "extracted_files", "extracted_bytes", "conversion_status", "conversion_jobs", "outputs_verified", evidence.alias("evidence_status"), issues.alias("issues"))


def audit_totals(audited: DataFrame) -> DataFrame:
    """One row: items, those that are verified, and those that need attention."""
    good: Column = F.col("evidence_status") == VERIFIED
    return audited.agg(F.count("*").alias("items"), F.count_if(good).alias("verified"), F.count_if(~good).alias("attention"))
