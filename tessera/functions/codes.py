"""Column functions over codes, statuses and positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: first bytes of formats
SIGNATURES = (
    ("png", b"\x89PNG\r\n\x1a\n"),
    ("jpeg", b"\xff\xd8\xff"),
    ("bmp", b"BM"),
    ("gif", b"GIF87a"),
    ("gif", b"GIF89a"),
    ("zip", b"PK\x03\x04"),
    ("rtf", b"{\\rtf1"),
    ("compound_document", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"),
)
#: fixed values: words of a status
STATUS_WORDS = {"ok": ("OK", "SUCCESS", "COMPLETE"), "partial": ("PARTIAL",), "derived": ("DERIVED",), "failed": ("FAILED", "FAIL", "ERROR"), "in_progress": ("IN PROGRESS", "IN_PROGRESS", "RUNNING")}


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def signature(content: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, magic in reversed(SIGNATURES):
        out = F.when(F.substring(content, 1, len(magic)) == F.lit(magic), name).otherwise(out)
    return out


def address(pos: Column, heads: int, per_track: int) -> Column:
    """struct(cylinder, head, sector) of a position; sectors count from 1."""
    whole = lambda x, n: F.floor(x / F.lit(n)).cast("long")
    return F.struct(whole(pos, heads * per_track).alias("cylinder"), (whole(pos, per_track) % heads).alias("head"), (pos % per_track + 1).alias("sector"))


def region(pos: Column, reserved: Column, root: Column, data: Column, clusters: Column, per_cluster: Column, per_copy: Column) -> Column:
    """struct(region, copy, sector_in_copy, cluster) of a position: the copy of the table and the place in it, or the data cluster (from 2)."""
    whole = lambda x, n: F.floor(x / n).cast("long")
    name = F.when(reserved.isNull(), "unknown_layout").when(pos == 0, "boot").when(pos < reserved, "reserved").when(pos < root, "fat").when(pos < data, "root_directory").when(pos < data + clusters * per_cluster, "data").otherwise("trailing_volume_sectors")
    fat, held = name == "fat", name == "data"
    return F.struct(name.alias("region"), F.when(fat, whole(pos - reserved, per_copy)).alias("copy"), F.when(fat, ((pos - reserved) % per_copy).cast("long")).alias("sector_in_copy"), F.when(held, whole(pos - data, per_cluster) + 2).alias("cluster"))


def severity(missing: Column, total: Column) -> Column:
    return F.when(missing <= 2, "few").when(missing <= 18, "localized").when(missing <= F.floor(total / F.lit(10)), "moderate").otherwise("severe")


def severity_base(missing: Column, total: Column) -> Column:
    s = severity(missing, total)
    return F.when(s == "few", 500).when(s == "localized", 400).when(s == "moderate", 250).otherwise(100)


def parsed_status(text: Column) -> Column:
    word = F.upper(F.trim(text))
    out = F.lit("unknown")
    for name, words in STATUS_WORDS.items():
        out = F.when(word.isin(*words), name).otherwise(out)
    return out


def normal_hash(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.rlike("^[0-9a-f]{64}$"), low)


def disposition(presence: Column, log_state: Column, attention: Column, log_file: Column, damaged: Column, status: Column) -> Column:
    """struct(action, reason) of an attempt: manual work first, then invalid output, open logs, missing logs, attention. ``presence``:
    manual, invalid, attention (a recovery that asks for a look) or other; ``log_state`` null: no log could be read. Actions and their order are fixed values."""
    action = (
        F.when(presence == "manual", "manual_recovered")
        .when(presence == "invalid", "recovery")
        .when(log_state == "in_progress", "in_progress")
        .when(log_state.isNull(), "recovery")
        .when(attention | (presence == "attention"), "recovery")
        .otherwise("extract")
    )
    reason = (
        F.when(action != "recovery", None)
        .when(presence == "attention", "recovered, completeness is not verified")
        .when(presence == "invalid", "invalid extraction")
        .when(log_state.isNull(), F.when(F.coalesce(log_file, F.lit("")) == "", "missing log").otherwise("unrecognized log"))
        .otherwise(F.concat(F.lit("not clean: "), F.coalesce(damaged.cast("string"), F.lit("unknown")), F.lit(" damaged ("), F.coalesce(status, F.lit("")), F.lit(")")))
    )
    return F.struct(action.alias("action"), reason.alias("reason"))


def conversion_status(modern_ok: Column, pdf_ok: Column) -> Column:
    """OK if both outputs succeeded, PARTIAL with one, else FAILED; an unknown output has not succeeded."""
    good = F.coalesce(modern_ok, F.lit(False)).cast("int") + F.coalesce(pdf_ok, F.lit(False)).cast("int")
    return F.when(good == 2, "OK").when(good == 1, "PARTIAL").otherwise("FAILED")


def dos_time(date: Column, time: Column) -> Column:
    """The timestamp of a DOS date (year from 1980, month, day in 7, 4 and 5 bits) and time (hour, minute, two seconds in 5, 6 and 5); null
    if that is no date."""
    bits = lambda c, low, width: F.shiftright(c, low).bitwiseAND((1 << width) - 1)
    parts = [bits(date, 9, 7) + 1980, bits(date, 5, 4), bits(date, 0, 5), bits(time, 11, 5), bits(time, 5, 6), bits(time, 0, 5) * 2]
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(parts[0].cast("string"), F.lit("-"), two(parts[1]), F.lit("-"), two(parts[2]), F.lit(" "), two(parts[3]), F.lit(":"), two(parts[4]), F.lit(":"), two(parts[5]))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def final_status(invalid: Column, failed: Column, sources: Column, filesystem: Column, partial: Column, imaging: Column, damaged: Column, evidence: Column, issues: Column) -> Column:
    """One status per item in the final report; its order differs from ``item_status``: failed conversions go first, and evidence last. The labels
    and the evidence that they ask for are fixed values.

    ``filesystem`` tells why there are no files, ``damaged`` is null where no map is known, ``issues`` counts open ones.
    """
    return (
        F.when((invalid > 0) | (failed > 0), "CHECK: CONVERSION FAILED")
        .when(sources == 0, F.when(filesystem.startswith("UNSUPPORTED/UNKNOWN"), "CHECK: UNSUPPORTED FILESYSTEM").when(filesystem.startswith("NO REACHABLE LIVE"), "CHECK: NO REACHABLE LIVE FILES").otherwise("CHECK: NO RECOVERED FILES"))
        .when(partial > 0, "PARTIAL: CONVERSION")
        .when(~imaging.eqNullSafe(F.lit("OK")) | F.coalesce(damaged > 0, F.lit(False)), "PARTIAL: IMAGE READ")
        .when(evidence == "DERIVED_RECOVERY", "CHECK: DERIVED RECOVERY")
        .when(evidence == "PARTIAL_IMAGE_READ", "CHECK: FILESYSTEM COMPLETENESS")
        .when(~evidence.eqNullSafe(F.lit("IMAGE_FILES_CONVERSIONS_VERIFIED")) | (issues > 0), "CHECK: EVIDENCE")
        .otherwise("OK")
    )


def item_status(image: Column, sources: Column, invalid: Column, failed: Column, partial: Column, imaging: Column) -> Column:
    """One status per item, by fixed precedence. The labels are fixed values."""
    return (
        F.when(~image, "CHECK: IMAGE MISSING")
        .when(sources == 0, "CHECK: NO RECOVERED FILES")
        .when(invalid > 0, "CHECK: INVALID GENERATED FILE")
        .when(failed > 0, "CHECK: CONVERSION FAILED")
        .when(partial > 0, "PARTIAL: CONVERSION")
        .when(F.upper(imaging) != "OK", "PARTIAL: IMAGE READ")
        .otherwise("OK")
    )


def plan_action(verified: Column, attention: Column, damaged: Column, running: Column, has_log: Column, composite: Column, mirrored: Column) -> Column:
    """What to do next for an item, with its reason: struct(action, reason). A null count is unknown and asks for a check."""
    rules = [
        (~verified, "check", "evidence differs from its record"),
        (~attention & (damaged == 0), "complete", "nothing is missing"),
        (running, "wait", "an attempt is still running"),
        (~has_log, "check", "no log tells what is missing"),
        (damaged.isNull() | (damaged == 0), "check", "attention without known damage"),
        (composite > 0, "composite", "other attempts hold missing positions"),
        (mirrored > 0, "mirror", "a mirrored copy holds missing positions"),
    ]
    out = F.struct(F.lit("reread").alias("action"), F.lit("no other copy is known").alias("reason"))
    for when, action, reason in reversed(rules):
        out = F.when(when, F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))).otherwise(out)
    return out
