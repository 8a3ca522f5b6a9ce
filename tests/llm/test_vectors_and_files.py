import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import codebooks, hardneg, orc_tokens
from tessera.llm.common import shared_dir

VECTORS = "vec_id long, embedding array<float>, label int, home long, v string"
BAD = [(900, None, 1, 0, "x"), (901, [1.0, None], 1, 0, "x"), (902, [float("nan")] * 8, 1, 0, "x"), (903, [float("inf")] * 8, 1, 0, "x")]


def whole(x, scale=256):
    return [int(np.floor(scale * float(np.float32(c)))) for c in x]


def nearest(x, book):
    d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
    return d.index(min(d)), min(d)


def plain_codes(rows, parts, size, rounds):
    """(code, error) by row, and the codebooks, by full scans."""
    width = -(-max(len(x) for _, _, x in rows) // parts)
    cut = [[(x + [0] * (parts * width - len(x)))[p * width : (p + 1) * width] for p in range(parts)] for _, _, x in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][2]))[:size]
    books = [[cut[i][p] for i in order] for p in range(parts)]
    for _ in range(rounds):
        codes = [[nearest(c[p], books[p])[0] for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                got = [c[p] for c, code in zip(cut, codes, strict=True) if code[p] == k]
                if got:
                    books[p][k] = [sum(col) // len(got) for col in zip(*got, strict=True)]
    final = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    return [("".join(f"{k:02x}" for k, _ in f), sum(d for _, d in f)) for f in final], books


def coded(spark, data, **how):
    got = codebooks.compress(spark.createDataFrame(data, VECTORS).repartition(3), **how)
    return Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()), got


def wanted(data, parts, size, rounds):
    rows = [(i, lab, whole(x)) for i, x, lab, *_ in data if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    codes, books = plain_codes(rows, parts, size, rounds)
    by_label = defaultdict(int)
    for (_, lab, _), (_, e) in zip(rows, codes, strict=True):
        by_label[lab] += e
    digest = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return Counter((i, c, e, by_label[lab], digest) for (i, lab, _), (c, e) in zip(rows, codes, strict=True))


def test_codebooks_equal_full_scans_and_bounds_save_work(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 5
    data = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=8) * 0.2], [None, 1, 2][i % 3], 0, "x") for i in range(400)]
    for rounds in (0, 1, 2, 5):
        got, rows = coded(spark, data + BAD, parts=4, size=20, rounds=rounds)
        assert got == wanted(data, 4, 20, rounds)
    most = 400 * 4 * 3  # rows, parts, groups of entries
    assert rows.agg(F.sum("rescans")).first()[0] < most / 2


def test_codebooks_ties_repeats_lengths_and_empty(spark):
    # A grid of few values ties everywhere; ids repeat, are null; lengths differ; a component is huge.
    rng = random.Random(1)
    data = [(rng.randrange(40), [float(rng.randrange(3)) for _ in range(rng.choice((5, 6, 8)))], rng.choice((None, 1)), 0, "x") for _ in range(120)]
    data += [(None, [1.0] * 8, 1, 0, "x")] * 2 + [data[0]] * 30
    assert coded(spark, data, parts=4, size=16, rounds=3)[0] == wanted(data, 4, 16, 3)
    huge = [(i, [1e15 * (i % 7), float(i)], 1, 0, "x") for i in range(30)]
    got = coded(spark, huge, parts=2, size=5, rounds=2)[0]
    plain = wanted(huge, 2, 5, 2)
    assert {x[:2] for x in got} == {x[:2] for x in plain} and {x[4] for x in got} == {x[4] for x in plain}
    assert coded(spark, data[:3], parts=4, size=16, rounds=2)[0] == wanted(data[:3], 4, 16, 2)  # fewer rows than entries
    assert not coded(spark, BAD, parts=4)[0]


def test_net_moves_are_tighter_than_their_sum():
    # An entry that goes away and comes back has not moved: no scan, however far it went in between.
    x = np.array([[0.0], [10.0]])
    books = [np.array([[0.0], [10.0]]), np.array([[0.0], [500.0]]), np.array([[0.0], [10.0]])]
    groups = [slice(0, 1), slice(1, 2)]
    b = codebooks.Bounds.scanned(x, books[0], groups)
    assert codebooks.Bounds(b.code[:1], b.low[:1].copy(), b.stamp[:1].copy()).advance(x[:1], books, groups).tolist() == [0]
    drifted = codebooks.Bounds(b.code[:1], b.low[:1].copy(), b.stamp[:1].copy())
    assert drifted.advance(x[:1], books[:2], groups).tolist() == [1]  # the far move alone asks for a scan


DOCS = "doc_id long, text string, range int, before long, n long"


def stored(spark, data, path):
    tokenizer = public_tokenizers.path(orc_tokens.TOKENIZER)
    orc_tokens.write_tokens(spark.createDataFrame([(i, t, 1, 2, 3) for i, t in data], DOCS).repartition(5), tokenizer, path)
    return [r for r in orc_tokens.checksums(orc_tokens.read_tokens(spark, path)).collect()]


def test_orc_tokens_round_trip(spark):
    rng = random.Random(4)
    words = ["the", "Été", "naïve", "tok3n", "日本", "  ", "\n", "it's", "a" * 50]
    data = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(40)))) for i in rng.sample(range(-500, 5000), 600)]
    data += [(6000, None), (6001, ""), (6002, "long " * 200000), (None, "no id"), (None, "no id"), (None, None), (7, "seven"), (7, "seven"), (7, "seven again")]
    tok = Tokenizer.from_file(public_tokenizers.path(orc_tokens.TOKENIZER))
    ids = {t: [*tok.encode(t, add_special_tokens=False).ids, 1] for t in {t or "" for _, t in data}}
    crc = {t: zlib.crc32(struct.pack(f"<{len(x)}I", *x)) for t, x in ids.items()}
    rows = stored(spark, data, f"{shared_dir(spark)}/tokens")
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(ids[t or ""]), crc[t or ""]) for i, t in data)
    at = 0
    for r in sorted(rows, key=lambda r: r.start):  # gapless, in the order of the ids, nulls first
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert not stored(spark, [], f"{shared_dir(spark)}/tokens")


def test_orc_lookup_prunes_by_metadata(spark):
    import glob

    from pyarrow import orc

    path = f"{shared_dir(spark)}/tokens"
    data = [(2 * i, f"text number {i} " * 3) for i in range(20000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    stored(spark, data, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = orc_tokens.read_tokens(spark, path, [30000, 30001]).select("doc_id", "n_tokens").collect()
    assert [r.doc_id for r in got] == [30000]
    files = sorted(glob.glob(path.removeprefix("file://") + "/*.orc"))
    ranges = []
    for f in files:  # they hold disjoint ranges of ids
        t = orc.ORCFile(f).read(["doc_id", "range"])
        ranges.append((min(t["doc_id"].to_pylist()), max(t["doc_id"].to_pylist())))
    ranges.sort()
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and len(files) > 1
    read = lambda ids: scanned(spark, spark.read.schema(orc_tokens.STORED).orc(path).where(F.col("doc_id").isin(ids)).select("n_tokens"))
    assert read([30000]) <= orc_tokens.STRIDE  # one row group: its minima and maxima drop the others
    assert read([100001]) == 0  # beyond every range
    assert read([30001]) == 0  # within a range of even ids: only the Bloom filter can tell


def scanned(spark, df):
    """Rows that the scan of ``df`` puts out."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        todo = [plan]
        while todo:
            node = todo.pop()
            if "Scan orc" in node.nodeName():
                return node.metrics().apply("numOutputRows").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def plain_negatives(rows, is_anchor, n_pos=5, n_neg=3):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, la, va in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-dot(va, v), i, lab) for i, lab, v in rows if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:n_pos]:
            fits = [(i, -t) for t, i, lab in scored if lab != la and 50 * -s <= 100 * -t <= 95 * -s][:n_neg]
            out += [(a, p, k + 1, i, -s, t) for k, (i, t) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "id long, label long, v array<long>").repartition(3)
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(tuple(r[c] for c in cols) for r in hardneg.hard_negatives(df, F.col("id") % 5 == 0, **how).collect())


@pytest.mark.parametrize("tile_rows, leaf", [(1000, 64), (40, 4), (7, 2)])
def test_hard_negatives_equal_all_pairs(spark, tile_rows, leaf):
    rng = random.Random(2)
    # Few values: many ties; a vector that a third of the rows share; labels of one row; vectors of zeros.
    rows = [(i, rng.randrange(4), [rng.randrange(-4, 5) for _ in range(5)]) for i in range(200)]
    rows += [(i, i % 2, [3, 1, 0, 2, 2]) for i in range(200, 300)] + [(300, 77, [1, 1, 1, 1, 1]), (305, 78, [0] * 5), (310, 1, [0] * 5)]
    assert mined(spark, rows, tile_rows=tile_rows, leaf=leaf) == plain_negatives(rows, lambda i: i % 5 == 0)


def test_hard_negatives_prune_and_take_far_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, [int(x) for x in rng.normal(size=6) * 1000]) for i in range(300)]
    assert mined(spark, rows, tile_rows=50, leaf=8) == plain_negatives(rows, lambda i: i % 5 == 0)
    big = [(i, i % 2, [int(x) for x in rng.normal(size=3) * 10**8]) for i in range(60)]
    assert mined(spark, big, tile_rows=20, leaf=4) == plain_negatives(big, lambda i: i % 5 == 0)


def test_hard_negatives_of_unusable_rows_and_empty(spark):
    data = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.5, 1.0], 2), (3, [0.9, 1.7], 2), (3, [0.9, 1.7], 5), (4, [2.0], 2), (None, [1.0, 1.0], 2), (6, [1.0, 1.0], None), (7, [1.0, None], 2), (8, None, 1)]
    df = spark.createDataFrame([(*x, 0, "x") for x in data], VECTORS)
    rows = sorted((r.id, r.label, tuple(r.v)) for r in hardneg.labelled_vectors(df).collect())
    assert [r[:2] for r in rows] == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 2)]
    assert mined(spark, rows) == plain_negatives([(i, lab, (*v, 0)[:2]) for i, lab, v in rows], lambda i: i % 5 == 0)
    assert mined(spark, []) == [] and mined(spark, rows[:1]) == []
