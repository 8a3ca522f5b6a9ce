"""Embedded objects: found by their first bytes in readable regions, as long as their format says, once per content.

A region is one row and is scanned in its own task; what leaves the scan are positions and hashes, not contents.
Null contents hold nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import SIGNATURES
from ..sources.scratch import kept
from .ranks import keep_first

#: starts that one region may try, and bytes that its searches for ends may visit
MAX_PROBES, MAX_WORK = 1024, 128 << 20


class Rejected(ValueError):
    """Why a start has no object, and how far its search went."""

    def __init__(self, reason: str, at: int):
        super().__init__(reason)
        self.at = at


#: (content, first byte, what searches in this content have found out) -> end; or ``Rejected``
End = Callable[[bytes, int, dict], int]
FOUND = "format string, at long, bytes long, sha string, reason string"
_CHUNK = struct.Struct(">I4s")
_JPEG_MARK = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]")
_RTF_TOKEN = re.compile(rb"[{}]|\\bin(\d+) ?|\\.", re.DOTALL)


def _png(b: bytes, at: int, seen: dict) -> int:
    at, kind = at + 8, b""
    while kind != b"IEND":
        if at + 12 > len(b):
            raise Rejected("png: cut off", min(at, len(b)))
        size, kind = _CHUNK.unpack_from(b, at)
        body, at = at + 4, at + size + 12
        if at > len(b):
            raise Rejected("png: cut off", min(at, len(b)))
        if zlib.crc32(b[body : at - 4]) != int.from_bytes(b[at - 4 : at], "big"):
            raise Rejected("png: checksum", at)
    return at


def _jpeg(b: bytes, at: int, seen: dict) -> int:
    at += 2
    while m := _JPEG_MARK.search(b, at):
        if b[m.end() - 1] == 0xD9:
            return m.end()
        if b[m.end() - 1] == 0xD8:
            raise Rejected("jpeg: a second start", m.end())
        at = m.end() + int.from_bytes(b[m.end() : m.end() + 2], "big")  # a marker's segment is skipped whole
    raise Rejected("jpeg: no end marker", len(b))


def _gif(b: bytes, at: int, seen: dict) -> int:
    colours = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    try:
        at += 13 + colours(b[at + 10])
        images = 0
        while b[at] != 0x3B:
            if b[at] == 0x2C:
                at, images = at + 11 + colours(b[at + 9]), images + 1
            elif b[at] == 0x21:
                at += 2
            else:
                raise Rejected("gif: unknown block", at)
            while b[at]:
                at += b[at] + 1
            at += 1
    except IndexError:
        raise Rejected("gif: cut off", len(b)) from None
    if not images:
        raise Rejected("gif: no image", at)
    return at + 1


def _rtf(b: bytes, at: int, seen: dict) -> int:
    """One pass tells the ends of all groups that it opens; a start within an open group is looked up."""
    ends = seen.setdefault("rtf", {})
    if at not in ends:
        open_: list[int] = []
        to = at
        while m := _RTF_TOKEN.search(b, to):
            to = m.end() + int(m[1] or 0)
            if m[0] == b"{":
                open_.append(m.start())
            elif m[0] == b"}":
                ends[open_.pop()] = to if to <= len(b) else None
                if not open_:
                    return to
        ends.update(dict.fromkeys(open_))
        if ends[at] is None:
            raise Rejected("rtf: open group", len(b))
    if ends[at] is None:
        raise Rejected("rtf: open group", at)
    return ends[at]


def between(start: bytes, end: bytes) -> tuple[tuple[bytes, ...], End]:
    """A format that begins and ends with fixed bytes."""

    def find(b: bytes, at: int, seen: dict) -> int:
        if at >= seen.get(end, len(b)):  # there was none behind an earlier start
            raise Rejected("no end marker", at)
        stop = b.find(end, at + len(start))
        if stop < 0:
            seen[end] = at
            raise Rejected("no end marker", len(b))
        return stop + len(end)

    return (start,), find


_ENDS: dict[str, End] = {"png": _png, "jpeg": _jpeg, "gif": _gif, "rtf": _rtf}
FORMATS = {name: (tuple(magic for n, magic in SIGNATURES if n == name), end) for name, end in _ENDS.items()}


def _scan(formats: dict[str, tuple[tuple[bytes, ...], End]], keys: list[str], max_probes: int | None, max_work: int | None):
    starts = re.compile(b"|".join(b"(?P<%s>%s)" % (name.encode(), b"|".join(map(re.escape, magics))) for name, (magics, _) in formats.items()))

    def objects(b: bytes) -> Iterator[tuple]:
        at = probes = work = 0
        seen: dict = {}
        while m := starts.search(b, at):
            if probes == max_probes or (max_work is not None and work > max_work):
                yield m.lastgroup, m.start(), None, None, "work limit"
                return
            probes += 1
            try:
                at = formats[m.lastgroup][1](b, m.start(), seen)
                work += at - m.start()
                yield m.lastgroup, m.start(), at - m.start(), hashlib.sha256(b[m.start() : at]).hexdigest(), None
            except Rejected as e:
                work += e.at - m.start()
                at = m.start() + 1
                yield m.lastgroup, m.start(), None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows, owner = [], []
            for i, content in enumerate(batch.column("__content")):
                got = list(objects(content.as_py() or b""))
                rows += got
                owner += [i] * len(got)
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)]
            kept = batch.select(keys).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *cols], names=[*keys, *(x.split()[0] for x in FOUND.split(", "))])

    return run


def readable_regions(blobs: DataFrame, fragments: DataFrame, item: str, content: str) -> DataFrame:
    """(item, offset, content) of every fragment (item, offset, bytes), as ``surviving_fragments`` gives them."""
    cut = F.substring(F.col(content), F.col("offset").cast("int") + 1, F.col("bytes").cast("int"))
    return blobs.select(item, content).join(fragments.select(item, "offset", "bytes"), item).select(item, "offset", cut.alias(content))


def carve(regions: DataFrame, item: str, offset: str, content: str, formats: dict[str, tuple[tuple[bytes, ...], End]] = FORMATS, max_probes: int | None = MAX_PROBES, max_work: int | None = MAX_WORK, known: DataFrame | None = None) -> DataFrame:
    """Objects in the regions: item, offset (in the source), format, bytes, sha, state, reason.

    The scan goes on behind an object, and one byte behind a start that is none. state: kept (the first of its content by item and
    offset), duplicate (of such, or of a ``sha`` in ``known``), rejected, or limit, where a region had more than ``max_probes`` starts or its searches for
    ends went over more than ``max_work`` bytes (None: no limit); what lies behind is not looked at.
    """
    fields = {f.name: f.dataType.simpleString() for f in regions.select(item, offset).schema}
    schema = ", ".join([*(f"`{k}` {v}" for k, v in fields.items()), FOUND])
    found = regions.select(item, offset, F.col(content).alias("__content")).mapInArrow(_scan(formats, list(fields), max_probes, max_work), schema)
    # Regions are scanned once; what is kept of them is written, and then counted and ranked.
    found = kept(found.withColumn(offset, F.col(offset) + F.col("at")).drop("at"))
    # What has no content has a key of its own, so that one scan serves all states.
    own = F.concat_ws(":", F.col(item).cast("string"), F.col(offset).cast("string"))
    found = keep_first(found.withColumn("__key", F.coalesce("sha", own)), "__key", [F.col(item), F.col(offset)])
    seen: Column = F.col("rejected")
    if known is not None:
        found = found.join(known.where("sha IS NOT NULL").select("sha", F.lit(True).alias("__known")).distinct(), "sha", "left")
        seen = seen | F.col("__known").isNotNull()
    state = F.when(F.col("reason") == "work limit", "limit").when(F.col("sha").isNull(), "rejected").when(seen, "duplicate").otherwise("kept")
    return found.select(item, offset, "format", "bytes", "sha", state.alias("state"), "reason")
