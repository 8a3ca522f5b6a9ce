from tessera.operators import audit

ATTEMPT = "item string, status string, bad int, unread int, sha string, legacy boolean, attention boolean, custody boolean, log_sha string, expected_bytes long"
EXTRACTION = "item string, kind string, verified boolean, files long, bytes long, attention boolean"


def run(spark, cases, audited=True):
    """cases: name -> (attempt changes, image, extraction, conversion)."""
    base = dict(status="OK", bad=0, unread=None, sha="AB", legacy=False, attention=False, custody=None, log_sha=None, expected_bytes=9)
    attempts = [(n, *(base | c[0]).values()) for n, c in cases.items()]
    images = [(n, *c[1]) for n, c in cases.items() if c[1]]
    found = [(n, *c[2]) for n, c in cases.items() if c[2]]
    done = [(n, *c[3]) for n, c in cases.items() if c[3]]
    conversions = spark.createDataFrame(done, "item string, jobs long, verified long, issues int") if audited else None
    got = audit.audit_items(spark.createDataFrame(attempts, ATTEMPT), spark.createDataFrame(images, "item string, sha string, bytes long"), spark.createDataFrame(found, EXTRACTION), conversions)
    return {r.item: r for r in got.collect()}, got


def test_evidence_precedence(spark):
    image, files, jobs = ("ab", 9), ("automatic", True, 3, 30, None), (2, 2, 0)
    cases = {
        "good": ({}, image, files, jobs), "no_jobs": ({}, image, files, None), "gone": ({"attention": True}, None, files, jobs), "torn": ({}, (None, 9), files, jobs), "swapped": ({}, ("cd", 9), files, jobs),
        "unhashed": ({"sha": None}, image, files, jobs), "partial": ({"attention": True, "bad": 4, "status": "PARTIAL"}, image, files, jobs), "derived": ({"attention": True, "status": "DERIVED", "bad": 1}, image, files, jobs),
        "native": ({}, image, ("automatic", True, 3, 30, True), jobs), "empty": ({}, image, ("automatic", True, 0, 0, None), jobs), "broken": ({}, image, ("automatic", False, 3, 30, None), jobs), "invalid": ({}, image, ("invalid", None, 3, 30, None), jobs),
        "manual": ({}, image, ("manual", None, 3, 30, None), jobs), "none": ({}, image, None, jobs), "jobs": ({}, image, files, (2, 1, 1)), "unread": ({"unread": 5}, image, files, jobs), "short": ({"legacy": True}, ("ab", 8), files, jobs),
        "log": ({"legacy": True, "log_sha": "ff"}, image, files, jobs), "custody": ({"attention": True, "custody": True}, image, files, jobs), "crossed": ({"attention": True}, image, files, jobs), "legacy": ({"attention": True, "legacy": True, "log_sha": "AB"}, image, files, jobs),
    }
    got, df = run(spark, cases)
    want = {
        "good": (audit.VERIFIED, []), "no_jobs": (audit.VERIFIED, []), "gone": (audit.CHECK, ["image_missing"]), "torn": (audit.CHECK, ["image_unreadable"]), "swapped": (audit.CHECK, ["image_hash_differs"]), "unhashed": (audit.CHECK, ["no_recorded_hash"]),
        "partial": (audit.PARTIAL, ["unresolved_positions"]), "derived": (audit.DERIVED, ["unresolved_positions"]), "native": (audit.PARTIAL, ["unresolved_positions"]), "empty": (audit.CHECK, ["no_recovered_files"]), "broken": (audit.CHECK, ["extraction_invalid"]),
        "invalid": (audit.CHECK, ["extraction_invalid"]), "manual": (audit.CHECK, ["manual_recovery"]), "none": (audit.CHECK, ["no_extraction"]), "jobs": (audit.CONVERSION, ["conversion_issues"]), "unread": (audit.CHECK, ["unread_positions"]),
        "short": (audit.CHECK, ["extent_differs"]), "log": (audit.CHECK, ["log_hash_differs"]), "custody": (audit.CUSTODY, ["unresolved_positions", "custody_only"]), "crossed": (audit.CONFLICTS, ["unresolved_positions", "reader_conflicts"]), "legacy": (audit.PARTIAL, ["unresolved_positions"]),
    }
    assert {n: (r.evidence_status, r.issues) for n, r in got.items()} == want
    assert (got["native"].extraction_status, got["no_jobs"].conversion_status, got["manual"].extracted_files, got["broken"].extracted_files, got["gone"].conversion_status) == ("PARTIAL_VERIFIED_FILES", "NO_CANDIDATES", 3, 0, "NOT_RUN")
    assert [tuple(r) for r in audit.audit_totals(df).collect()] == [(21, 2, 19)]
    never, _ = run(spark, {n: cases[n] for n in ("good", "partial")}, audited=False)
    assert {n: (r.evidence_status, r.issues, r.conversion_status) for n, r in never.items()} == {"good": (audit.CONVERSION, ["conversion_not_audited"], "NOT_RUN"), "partial": (audit.PARTIAL, ["unresolved_positions"], "NOT_RUN")}
    assert audit.audit_items(*[x.limit(0) for x in (spark.createDataFrame([], ATTEMPT), spark.createDataFrame([], "item string, sha string, bytes long"), spark.createDataFrame([], EXTRACTION))], None).count() == 0
