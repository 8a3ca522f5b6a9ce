"""Lexical retrieval packing of texts into sequences of a fixed number of tokens.

1. Tokens. A word's ids do not depend on its neighbours (the tokenizer drops white space before it splits), and those of plain words are
   those of its pieces: runs of letters, digits, runs of marks. Chunks are cut into pieces at once, and a worker keeps the ids of the pieces
   it has met in a table of fixed size. Document frequencies of all ids are counted over the whole corpus; the vocabulary bounds their number.
2. Shards. Rows are placed by the smallest hash of a text's id pairs, hashed again, so that texts with shared phrases lie close
   together and a place says nothing about the length. Tokens are counted by slot of the places, and slots are cut into shards of about
   ``shard_tokens`` tokens; a slot that holds more (copies of one text) is dealt into several shards. Each shard has one BM25 inverted index,
   in which frequent ids have a row of weights over all texts of the shard in place of postings.
3. Packing. The next unused text is the seed of a window. While the window has room, the index returns unused texts by BM25 score
   for all of the seed's ids, and they are placed one after another. The last one is cut where the window ends; its rest
   opens the next window and is its seed. What a shard leaves over is cut into sequences whose lengths are powers of
   two, so no padding is needed anywhere.

Nulls, ties and repeats: a null text is empty and has only the end id; ids of documents are carried along, null or repeated;
ties of score go to the earlier row. An empty table gives no rows. A very long text fills as many windows as it needs.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, staged, text_chunks
from .textnum import mix

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
CHUNK = 1 << 20
#: slots of the table of pieces that a worker remembers, and ids it keeps for them
TABLE_BITS = 21
POOL_IDS = 1 << 23
#: bytes from which a piece is hashed alone
LONG = 64
#: kinds of bytes: white space; ASCII letters (and the Latin-1 letters, two bytes each); digits; visible ASCII but the apostrophe; all else
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[0x21:0x7F] = _MARK
_KINDS[0x27] = _OTHER
_KINDS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KINDS[0x30:0x3A] = _DIGIT
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
#: second bytes of Latin-1 letters (behind 0xC3): all but those of the signs of multiplication and division
_LATIN = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])
#: masks of the first 0 to 8 bytes; what sets pieces of different sizes apart
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SIZES = mix(np.arange(1, LONG + 2, dtype=np.uint64))
#: an id that one in so many texts of a shard has is frequent; cells of such ids that are added up at once
DENSE = 8
CELLS = 1 << 15
#: ranges of the places whose tokens are counted
SLOT_BITS = 14
TOKENS = "doc_id long, n long, place long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, whether it is a whole word) of the pieces: runs of letters, single digits and runs of marks of words made of these
    alone; other words, and those with ``<|`` (special tokens), are left whole."""
    n = len(data)
    kind = _KINDS[data]
    begin = np.zeros(n + 1, bool)
    begin[offs] = True
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_LATIN[data[lead + 1]] & ~begin[lead + 1]]
    kind[lead] = kind[lead + 1] = _LETTER
    cut = (kind == _DIGIT) | begin[:n]
    cut[1:] |= kind[1:] != kind[:-1]
    at = np.flatnonzero(cut)
    what = kind[at]
    whole = np.zeros(len(at), bool)
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    odd = np.concatenate([np.flatnonzero(what == _OTHER), np.searchsorted(at, special, "right") - 1])
    if len(odd):
        opens = (what != _SPACE) & (begin[at] | np.concatenate([[True], what[:-1] == _SPACE]))
        word = np.cumsum(opens)
        whole = np.zeros(int(word[-1]) + 1, bool)
        whole[word[odd]] = True
        whole = whole[word] & (what != _SPACE)
        keep = ~whole | opens
        at, what, whole = at[keep], what[keep], whole[keep]
    solid = what != _SPACE
    return at[solid], np.diff(np.append(at, n))[solid], whole[solid]


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of pieces, eight bytes at a time."""
    raw = np.concatenate([data, np.zeros(16 - len(data) % 8, np.uint8)]).view("<u8")

    def eight(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        word, shift = at >> 3, (at.astype(np.uint64) & np.uint64(7)) << np.uint64(3)
        return (raw[word] >> shift | raw[word + 1] << np.uint64(1) << (np.uint64(63) - shift)) & _LOW[np.minimum(left, 8)]

    out = mix(eight(start, size) ^ _SIZES[np.minimum(size, LONG)])
    at, more = 8, np.flatnonzero((size > 8) & (size < LONG))
    while len(more):
        out[more] = mix(out[more] ^ eight(start[more] + at, size[more] - at))
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size >= LONG).tolist():
        out[i] = int.from_bytes(blake2b(data[start[i] : start[i] + size[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class WordTokenizer:
    """Ids of whole texts from the ids of their pieces. A table keeps the piece seen last in each slot of the hashes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.stop = self.tok.get_vocab_size(with_added_tokens=True) - 1
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xC0, 0x100)]
        codes = {chr(b): m for x in letters for b, m in zip(x.encode(), level.pre_tokenize_str(x)[0][0], strict=True)}
        self.codes = [(b, m) for b, m in codes.items() if b != m]  # bytes of letters that the model has under another character
        self.width = "<u2" if self.stop < 65536 else "<u4"
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(1 << TABLE_BITS, np.uint64)
        self.start = np.zeros(1 << TABLE_BITS, np.int32)
        self.size = np.zeros(1 << TABLE_BITS, np.int32)
        self.pool, self.held = np.empty(POOL_IDS, self.width), 0

    def _plain_ids(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of letters, digits or marks, by the BPE model alone."""
        if not pieces:
            return []
        text = b" ".join(pieces).decode().lower()
        if not text.isascii():
            text = text.encode().decode("latin-1")
            for byte, code in self.codes:
                text = text.replace(byte, code)
        return [[t.id for t in tokens] for tokens in map(self.model.tokenize, text.split(" "))]

    def _learn(self, data: np.ndarray, hashes: np.ndarray, start: np.ndarray, size: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of new pieces, in the order of their hashes."""
        raw, order = data.tobytes(), np.argsort(whole, kind="stable")
        pieces = [raw[s : s + n] for s, n in zip(start[order].tolist(), size[order].tolist(), strict=True)]
        plain = len(pieces) - int(whole.sum())
        ids = self._plain_ids(pieces[:plain]) + [self.tok.encode(x.decode("utf-8", "replace"), add_special_tokens=False).ids for x in pieces[plain:]]
        count, begin = np.empty((2, len(ids)), np.int64)
        count[order] = sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        begin[order] = self.held + np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        if self.held + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(total, len(self.pool)), self.width)])
        self.pool[self.held : self.held + total] = np.fromiter(chain.from_iterable(ids), self.width, total)
        self.held += total
        slot = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        last = np.flatnonzero(np.append(slot[1:] != slot[:-1], True))
        slot = slot[last]
        self.known[slot], self.start[slot], self.size[slot] = hashes[last], begin[last], count[last]
        return begin, count

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's END_ID included, and the n+1 bounds of the texts."""
        at, length, whole = _pieces(data, offs)
        hashes = _hashes(data, at, length)
        slot = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        start, size = self.start[slot].astype(np.int64), self.size[slot].astype(np.int64)
        new = np.flatnonzero(self.known[slot] != hashes)
        if len(new):
            kinds, one, inv = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[one]
            begin, count = self._learn(data, kinds, at[one], length[one], whole[one])
            start[new], size[new] = begin[inv], count[inv]
        ends = np.concatenate([[0], np.cumsum(size)])
        bounds = ends[np.searchsorted(at, offs)] + np.arange(len(offs))
        out = np.full(int(bounds[-1]), END_ID, self.width)
        body = np.ones(len(out), bool)
        body[bounds[1:] - 1] = False
        out[body] = self.pool[np.repeat(start - ends[:-1], size) + np.arange(ends[-1])]
        if self.held > POOL_IDS:
            self._clear()
        return out, bounds


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _place(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The smallest hash of each text's pairs of neighbouring ids, hashed again: the smallest one alone would be smaller for longer texts."""
    x = ids.astype(np.uint32)
    h = x.copy()
    h[:-1] = (h[:-1] << np.uint32(16)) ^ x[1:]
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h[bounds[1:] - 1] = np.uint32(0xFFFFFFFF)  # no pair reaches over the end
    return (mix(np.minimum.reduceat(h, bounds[:-1]).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def _tokenize(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        for batch in batches:
            for rows, data, offs in text_chunks(batch, "text", CHUNK):
                ids, bounds = tok(data, offs)
                step = ids.dtype.itemsize
                packed = pa.Array.from_buffers(pa.binary(), rows.num_rows, [None, pa.py_buffer((bounds * step).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(_place(ids, bounds)), packed], names=["doc_id", "n", "place", "ids"])

    return run


def _flat(column: pa.Array, width: str) -> tuple[np.ndarray, np.ndarray]:
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    step = np.dtype(width).itemsize
    return np.frombuffer(data, width, (o[-1] - o[0]) // step, o[0]), (o - o[0]) // step


def _distinct(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, id, times), sorted by both."""
    key = np.sort((np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds)) << np.uint64(32)) | ids)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    k = key[first]
    return (k >> np.uint64(32)).astype(np.int64), (k & np.uint64(0xFFFFFFFF)).astype(np.int64), np.diff(np.append(first, len(key)))


def _frequencies(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, np.int64)
        for batch in batches:
            ids, bounds = _flat(batch.column("ids"), width)
            _, tok, _ = _distinct(ids, bounds)
            got = np.bincount(tok, minlength=len(df))
            got[: len(df)] += df
            df = got
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(df[used], pa.int64())], names=["id", "df"])

    return run


class Index:
    """BM25 inverted index of a shard. ``query`` returns unused texts for a seed, best first; ties go to the first text in the shard.

    ``terms`` None: a seed asks with all its ids, and the answer is exact; else with that many of its rarest ones. ``common``: ids that are left out.
    Ids of at least one in ``DENSE`` texts have a row of weights over all texts (DENSE cells a posting at most), others a list of postings.
    """

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, idf: np.ndarray, common: np.ndarray, terms: int | None, k1: float = 1.2, b: float = 0.75):
        n = len(bounds) - 1
        doc, tok, tf = _distinct(ids, bounds)
        use = ~common[tok]
        doc, tok, tf = doc[use], tok[use], tf[use]
        length = np.diff(bounds)
        norm = k1 * (1 - b + b * length / max(1.0, float(length.mean())))
        weight = (idf[tok] * tf * (k1 + 1) / (tf + norm[doc])).astype(np.float32)
        frequent = np.flatnonzero(np.bincount(tok, minlength=len(idf)) * DENSE >= max(n, DENSE))
        self.row = np.full(len(idf), -1)
        self.row[frequent] = np.arange(len(frequent))
        self.rows = np.zeros((len(frequent), n))
        row = self.row[tok]
        dense, rest = row >= 0, np.flatnonzero(row < 0)
        self.rows[row[dense], doc[dense]] = weight[dense]
        by_id = rest[np.argsort(tok[rest].astype(np.uint32), kind="stable")]
        self.doc, self.weight = doc[by_id].astype(np.int32), weight[by_id]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(tok[rest], minlength=len(idf)))])
        if terms is not None:
            order = np.lexsort((-idf[tok], doc))
            start = np.searchsorted(doc, np.arange(n + 1))
            pick = order[np.arange(len(doc)) - np.repeat(start[:-1], np.diff(start)) < terms]
            doc, tok = doc[pick], tok[pick]
        self.asked, self.first = tok, np.searchsorted(doc, np.arange(n + 1))
        self.unused = np.ones(n, bool)

    def query(self, seed: int, k: int) -> list[int]:
        asked = self.asked[self.first[seed] : self.first[seed + 1]]
        if not len(asked):
            return []
        row, n = self.row[asked], len(self.unused)
        asked, row = asked[row < 0], row[row >= 0]
        spans = [slice(a, b) for a, b in zip(self.begin[asked].tolist(), self.begin[asked + 1].tolist(), strict=True)]
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), n) if spans else np.zeros(n)
        step = max(1, CELLS // n)
        for i in range(0, len(row), step):
            score += np.add.reduce(self.rows[row[i : i + step]], axis=0)
        score *= self.unused
        if len(score) > k:
            kth = np.partition(score, -k)[-k]
            best = np.flatnonzero(score > kth)
            best = np.concatenate([best, np.flatnonzero(score == kth)[: k - len(best)]])
        else:
            best = np.arange(len(score))
        best = best[score[best] > 0]
        return best[np.lexsort((best, -score[best]))].tolist()


class Packer:
    """Fills windows with texts."""

    def __init__(self, window: int, base: int):
        self.window, self.base = window, base
        self.seq, self.used = 0, 0
        self.open: list[tuple] = []
        self.rows: list[tuple] = []

    def _close(self) -> None:
        at = 0
        for doc, start, ids, total in self.open:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.base + self.seq, at))
            at += len(ids)
        self.seq, self.used, self.open = self.seq + 1, 0, []

    def place(self, doc, ids: np.ndarray) -> bool:
        """Place a whole text; True if a window was filled on the way."""
        at, total, closed = 0, len(ids), False
        while at < total:
            n = min(self.window - self.used, total - at)
            self.open.append((doc, at, ids[at : at + n], total))
            self.used, at = self.used + n, at + n
            if self.used == self.window:
                self._close()
                closed = True
        return closed

    def finish(self) -> None:
        """Cut the open window into sequences whose lengths are powers of two."""
        rest, left = self.open, self.used
        self.open, self.used = [], 0
        while left:
            size = room = 1 << (left.bit_length() - 1)
            while room:
                doc, start, ids, total = rest[0]
                n = min(room, len(ids))
                self.open.append((doc, start, ids[:n], total))
                rest = [(doc, start + n, ids[n:], total), *rest[1:]] if n < len(ids) else rest[1:]
                room -= n
            self._close()
            left -= size


def _pack(width: str, window: int, idf: np.ndarray, common: np.ndarray, terms: int | None, neighbours: int):
    def fill(packer: Packer, docs: list, ids: np.ndarray, bounds: np.ndarray) -> None:
        index = Index(ids, bounds, idf, common, terms)
        wide, cut = ids.astype("<u4"), bounds.tolist()
        unused, n, ahead = index.unused, len(docs), 0
        mean = max(1, len(ids) // n)
        queue: Iterator[int] = iter(())
        while True:
            d = next((x for x in queue if unused[x]), None)
            new_seed = d is None
            if new_seed:
                while ahead < n and not unused[ahead]:
                    ahead += 1
                if ahead == n:
                    return
                d = ahead
            unused[d] = False
            crossed = packer.place(docs[d], wide[cut[d] : cut[d + 1]])
            if packer.used == 0:
                queue = iter(())
            elif new_seed or crossed:
                queue = iter(index.query(d, neighbours + (packer.window - packer.used) // mean))

    def pack(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("place", "ascending"), ("doc_id", "ascending"), ("n", "ascending"), ("ids", "ascending")])
        packer = Packer(window, shard.column("shard")[0].as_py() << 32)
        flat = [_flat(chunk, width) for chunk in shard.column("ids").chunks if len(chunk)]
        bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(o) for _, o in flat]))])
        fill(packer, shard.column("doc_id").to_pylist(), np.concatenate([x for x, _ in flat]), bounds)
        packer.finish()
        cols = list(zip(*packer.rows, strict=True)) or [[]] * 7
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in PIECES.split(", ")])

    return pack


def shard_of(tokens: DataFrame, shard_tokens: int) -> tuple[Column, int]:
    """(shard of a row of ``tokens``, number of shards): SLOTS ranges of the places, cut by their cumulated tokens."""
    slot = F.shiftright("place", 63 - SLOT_BITS).cast("int")
    seen = tokens.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n")).collect()  # 1 << SLOT_BITS rows at most
    size = np.zeros(1 << SLOT_BITS, np.int64)
    for r in seen:
        size[r.slot] = r.n
    first, parts, shard, room = np.zeros(len(size), np.int64), np.ones(len(size), np.int64), -1, 0
    for i in range(len(size)):
        if size[i] > shard_tokens:  # shards of its own
            parts[i] = -(-size[i] // shard_tokens)
            first[i], shard, room = shard + 1, shard + int(parts[i]), 0
        else:
            if size[i] > room:
                shard, room = shard + 1, shard_tokens
            first[i] = max(shard, 0)
            room -= size[i]
    table = lambda x: F.from_json(F.lit(str(x.tolist())), "array<bigint>")
    at = slot + 1
    salt = F.pmod(F.xxhash64("doc_id", "place", "n"), F.element_at(table(parts), at))
    return F.element_at(table(first), at) + salt, max(shard + 1, 1)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n, place, ids (packed little-endian, END_ID last) of every row of ``docs`` (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize(path), TOKENS)


def pack_documents(docs: DataFrame, path: str, window: int = 2048, shard_tokens: int = 2_000_000, terms: int | None = None, neighbours: int = 8, common_share: float = 1.0) -> DataFrame:
    """Pieces (PIECES) of all rows of ``docs`` in sequences of ``window`` tokens.

    ``terms``: ids a seed asks with (None: all, which is exact in a shard); ids in more than ``common_share`` of all texts are left out of the
    index (1: none). A seed asks for ``neighbours`` texts more than those of mean length that its window has room for, and asks anew in
    its own shard as a new seed when they are used up. A text is never cut into shards: one with more than ``shard_tokens``
    tokens makes its shard longer. ``path``: the tokenizer's file, at the same place on every executor.
    """
    tokens = staged(tokenized(docs, path), "tokens")
    width = _tokenizer(path).width
    rows = tokens.count()
    counted = tokens.select("ids").mapInArrow(_frequencies(width), "id long, df long").groupBy("id").agg(F.sum("df").alias("df")).collect()  # the vocabulary at most
    df = np.zeros(_tokenizer(path).stop + 1, np.int64)
    for r in counted:
        df[r.id] = r.df
    idf = np.log1p((rows - df + 0.5) / (df + 0.5)).astype(np.float32)
    common = df > max(1.0, common_share * rows)
    common[END_ID] = True  # no id of the text
    shard, shards = shard_of(tokens, shard_tokens)
    dealt = tokens.withColumn("shard", shard).repartition(shards, "shard")
    return dealt.groupBy("shard").applyInArrow(_pack(width, window, idf, common, terms, neighbours), PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
