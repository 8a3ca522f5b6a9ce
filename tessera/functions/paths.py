"""Column functions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: folders of operating systems, names of listings, markers of recovered files
SYSTEM_FOLDERS = ("system volume information", "$recycle.bin", "recycled", "recycler")
REPORT_NAMES = ("filelist.htm", "filelist.html", "filelist.txt")
SIGNATURE_FOLDERS = ("$raw", "[$raw files by signatures]", "signaturerecovery")
DIRECTORY_FOLDER, FRAGMENT_FOLDER = "directoryrecovery", "fragmentrecovery"
FORMATS = {"docx": ("doc", "rtf", "wps", "wri", "wpd", "sdw"), "xlsx": ("xls", "xlw", "xlt", "wk1", "wk3", "wk4", "wks", "123", "wb1", "wb2", "wq1", "wq2", "sdc"), "pptx": ("ppt", "pps", "pot", "sdd")}


def parts(path: Column) -> Column:
    return F.split(F.translate(path, "\\", "/"), "/")


def file_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def category(path: Column, size: Column, internal_prefix: str = "__") -> Column:
    """First rule that fits: os_metadata, internal, tool_report, empty, temporary, payload."""
    low = F.lower(path)
    name = file_name(low)
    return (
        F.when(F.arrays_overlap(parts(low), F.array(*map(F.lit, SYSTEM_FOLDERS))), "os_metadata")
        .when(name.startswith(internal_prefix), "internal")
        .when(~low.contains("/") & name.isin(*REPORT_NAMES), "tool_report")
        .when(size == 0, "empty")
        .when(name.startswith("~") | name.endswith(".tmp"), "temporary")
        .otherwise("payload")
    )


def origin(path: Column) -> Column:
    """What made a file, by its parent folders only."""
    p = parts(F.lower(path))
    parents = F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0)))
    return (
        F.when(F.arrays_overlap(parents, F.array(*map(F.lit, SIGNATURE_FOLDERS[:2]))), "signature")
        .when(F.exists(parents, lambda x: x.startswith("$noname") | (x == "$root")), "tool_filesystem")
        .otherwise("filesystem")
    )


def normalized_path(path: Column) -> Column:
    """Lower case with forward slashes; null where the path is empty, too long, absolute, climbing or has reserved characters."""
    p = F.translate(path, "\\", "/")
    bad = (p == "") | (F.octet_length(p) > 4096) | p.rlike(r'[\x00-\x1f\x7f:*?"<>|]') | F.exists(F.split(p, "/"), lambda x: x.isin("", ".", ".."))
    return F.when(~bad, F.lower(p))


def delivery(path: Column) -> Column:
    """struct(path, method): marker folders are dropped; the strongest one gives the first folder."""
    p = F.filter(parts(path), lambda x: x != "")
    low = F.transform(p, F.lower)
    has = lambda *names: F.arrays_overlap(low, F.array(*map(F.lit, names)))
    tool = lambda x: F.lower(x).rlike(r"^\$(root|noname( \d+)?)$")
    clean = F.filter(p, lambda x: ~F.lower(x).isin(*SIGNATURE_FOLDERS, DIRECTORY_FOLDER, FRAGMENT_FOLDER) & ~tool(x))
    first = F.when(has(*SIGNATURE_FOLDERS), "Signature-Recovered").when(has(DIRECTORY_FOLDER), "Directory-Recovered").when(has(FRAGMENT_FOLDER), "Fragment-Hypotheses")
    whole = F.concat(F.when(first.isNotNull(), F.array(first)).otherwise(F.array().cast("array<string>")), clean)
    whole = F.when(F.size(whole) > 0, whole).otherwise(F.array(F.lit("Unsorted-Recovery"), F.element_at(p, -1)))
    method = F.when(has(*SIGNATURE_FOLDERS), "signature").when(has(DIRECTORY_FOLDER), "directory").when(has(FRAGMENT_FOLDER), "fragment").when(F.exists(p, tool), "tool_filesystem").otherwise("filesystem")
    return F.struct(F.array_join(whole, "/").alias("path"), method.alias("method"))


def counted(path: Column) -> Column:
    """Whether a file counts as coverage: it is not below a system folder."""
    return ~F.arrays_overlap(parts(F.lower(path)), F.array(*map(F.lit, SYSTEM_FOLDERS[:2])))


def reachable(path: Column) -> Column:
    """Whether a file was found through the file system: no part of its path is a folder of recoveries."""
    return ~F.arrays_overlap(parts(F.lower(path)), F.array(*map(F.lit, (*SIGNATURE_FOLDERS[1:], DIRECTORY_FOLDER, FRAGMENT_FOLDER))))


def eligible(path: Column, internal_prefix: str = "__") -> Column:
    return ~file_name(path).startswith(internal_prefix) & ~F.arrays_overlap(parts(F.lower(path)), F.array(*map(F.lit, SYSTEM_FOLDERS[:2])))


def target_format(path: Column, detected: Column | None = None) -> Column:
    """Output family by extension; a detected family (word, excel, other) goes before it. Null: nothing to convert."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    by_ext = F.lit(None).cast("string")
    for family, names in FORMATS.items():
        by_ext = F.when(ext.isin(*names), family).otherwise(by_ext)
    if detected is None:
        return by_ext
    return F.when(detected == "word", "docx").when(detected == "excel", "xlsx").when(detected.isNotNull(), F.lit(None)).otherwise(by_ext)
