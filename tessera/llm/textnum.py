"""Words of many texts as NumPy arrays: positions, owners and 64-bit hashes, computed for whole chunks at once.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; all bytes of a multi-byte UTF-8 character are above
0x7F, so byte runs and character runs are the same. Hashes are polynomial over random byte codes modulo 2**64 and then
mixed; two different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODES[_SPACE] = 0  # white space after a word adds nothing to its sum
_FOLDED = _CODES.copy()
_FOLDED[65:91] = _CODES[97:123]  # A-Z as a-z
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64)


_OTHER = np.array([not (65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])
_LETTERS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS[65:91] = _LETTERS[97:123]
_LETTERS[_OTHER] = 0


class Words(NamedTuple):
    start: np.ndarray  # byte position in the chunk
    size: np.ndarray  # bytes
    doc: np.ndarray  # index of the text in the chunk
    hash: np.ndarray  # uint64
    first: np.ndarray  # n+1: first word of each text


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        p = np.full(size, _P, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def words(data: np.ndarray, offs: np.ndarray, lower: bool = True, letters: bool = False) -> Words:
    """``letters``: a word is a run of ASCII letters and bytes above 0x7F instead."""
    space, codes = (_OTHER, _LETTERS) if letters else (_SPACE, _FOLDED if lower else _CODES)
    n, docs = len(data), len(offs) - 1
    solid = ~space[data]
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    begins = offs[:-1][offs[:-1] < n]
    before[begins] = False
    start = np.flatnonzero(solid & ~before)
    if not len(start):
        e = np.empty(0, np.int64)
        return Words(e, e, e, np.empty(0, np.uint64), np.zeros(docs + 1, np.int64))
    after = np.zeros(n, bool)
    after[:-1] = solid[1:]
    after[begins[begins > 0] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    size = end - start
    s0 = int(start[0])
    span = np.diff(np.append(start, n))
    at = np.arange(s0, n) - np.repeat(start, span)
    longest = int(size.max())
    pw = _powers_to(longest)
    np.minimum(at, longest - 1, out=at)  # white space behind a word has the code 0
    sums = np.add.reduceat(codes[data[s0:]] * pw[at], start - s0)
    first = np.searchsorted(start, offs)
    doc = np.repeat(np.arange(docs), np.diff(first))
    return Words(start, size, doc, mix(sums + size.astype(np.uint64) * _Q), first)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``k`` words; of a text with 1 to k-1 words, the whole sequence as one."""
    n = len(w.hash)
    counts = np.diff(w.first)
    total = np.zeros(0, np.uint64)
    owner = np.zeros(0, np.int64)
    if n >= k:
        acc = w.hash[: n - k + 1].copy()
        for j in range(1, k):
            acc *= _Q
            acc += w.hash[j : n - k + 1 + j]
        ok = w.doc[: n - k + 1] == w.doc[k - 1 :]
        total, owner = mix(acc[ok]), w.doc[: n - k + 1][ok]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for i, d in enumerate(short):
                acc = np.uint64(counts[d])
                for h in w.hash[w.first[d] : w.first[d + 1]]:
                    acc = acc * _Q + h
                extra[i] = acc
        total, owner = np.concatenate([total, mix(mix(extra))]), np.concatenate([owner, short])
    return owner, total


def pack_counts(x: np.ndarray) -> bytes:
    """Nonnegative counts in one byte each; those of 255 and more follow in eight."""
    big = x >= 255
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[big].astype("<u8").tobytes()


def unpack_counts(b: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(b, np.uint8, n).astype(np.int64)
    big = out == 255
    if len(b) > n:
        out[big] = np.frombuffer(b, "<u8", offset=n).astype(np.int64)
    return out


def pack_keys(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each key."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(b: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8")


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted keys: the first one, then steps in as few bytes as the longest needs, all first bytes before all second ones. Hashes
    are spread evenly, so steps are shorter than keys, and their high bytes compress."""
    steps = np.diff(x)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + x[:1].astype("<u8").tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_sorted(b: bytes, n: int) -> np.ndarray:
    width = b[0]
    out = np.zeros((n, 8), np.uint8)
    if n > 1:
        planes = pa.decompress(b[9:], decompressed_size=(n - 1) * width, codec="zstd", asbytes=True)
        out[1:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n - 1).T
    keys = out.reshape(-1).view("<u8")
    keys[:1] = np.frombuffer(b, "<u8", 1, 1)
    return np.cumsum(keys, dtype=np.uint64)
