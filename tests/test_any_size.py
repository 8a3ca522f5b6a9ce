"""Items and groups of any size: small cells and ranges must give the rows of one task per item."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.operators import joins, ranks, windows
from tessera.sources import scratch


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def plain_runs(xs):
    out = []
    for x in sorted(set(xs)):
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return out


def positions(spark, rng):
    """Half of all positions are of one item."""
    data = [("big", rng.choice((rng.randrange(-60, 60), rng.randrange(200, 230)))) for _ in range(150)] + [(f"i{rng.randrange(6)}", rng.randrange(40)) for _ in range(150)] + [(None, 3), (None, 4)]
    return data, spark.createDataFrame(data, "item string, pos long").repartition(3)


def test_islands_and_gaps_are_stitched_at_borders(spark):
    for seed, width in ((1, 1), (2, 7), (3, 1000)):
        data, df = positions(spark, random.Random(seed))
        by = defaultdict(list)
        for i, p in data:
            by[i].append(p)
        runs = {i: plain_runs(xs) for i, xs in by.items()}
        want = Counter((i, a, z, z - a + 1) for i, r in runs.items() for a, z in r)
        assert Counter(map(tuple, windows.islands(df, ["item"], "pos", width).select("item", "first", "last", "length").collect())) == want
        holes = Counter((i, a[1] + 1, b[0] - 1, b[0] - a[1] - 1) for i, r in runs.items() for a, b in zip(r, r[1:], strict=False))
        assert Counter(map(tuple, windows.gaps(df, ["item"], "pos", width).select("item", "first", "last", "length").collect())) == holes
    assert windows.islands(df.limit(0), ["item"], "pos").count() == windows.gaps(df.limit(0), ["item"], "pos").count() == 0


def test_extents_and_fragments_over_many_cells(spark):
    rng = random.Random(4)
    pos, extents = 0, []
    for seq in range(120):
        pos = pos + 1 if rng.random() < 0.7 else rng.randrange(1000)
        extents.append(("f", seq, pos))
    want, last = [], None
    for _, q, p in extents:
        if last and last[0] == q - 1 and last[1] == p - 1:
            want[-1][2] += 1
        else:
            want.append([q, p, 1])
        last = (q, p)
    df = spark.createDataFrame(extents + extents[:5], "file string, seq long, pos long")
    assert rows(windows.coalesce_extents(df, ["file"], "seq", "pos", 8), "first_seq", "first_pos", "length") == sorted(map(tuple, want))
    units = [("f", i, rng.randrange(5), rng.random() < 0.8) for i in range(200)]
    offset, run, found = 0, 0, defaultdict(lambda: [None, 0, 0])
    for _, _, size, ok in units:
        run += not ok
        length = max(0, min(size, 300 - offset))
        if ok and length:
            f = found[run]
            f[0] = offset if f[0] is None else f[0]
            f[1], f[2] = f[1] + length, f[2] + 1
        offset += size
    u = spark.createDataFrame(units, "file string, seq long, size long, ok boolean").withColumn("cap", F.lit(300))
    for width in (1, 16, 1000):
        assert rows(windows.surviving_fragments(u, "file", "seq", "size", "ok", "cap", width), "offset", "bytes", "units") == sorted(tuple(x) for x in found.values())


def plain_composite(cells):
    """(merged, refused) of (item, attempt, pos, good, payload)."""
    merged, refused = [], []
    for item in {c[0] for c in cells}:
        mine = [c for c in cells if c[0] == item]
        attempts = {a: (sum(not c[3] for c in mine if c[1] == a), sum(c[1] == a for c in mine)) for a in {c[1] for c in mine}}
        order = sorted(attempts, key=lambda a: (attempts[a][0], -a))
        good = defaultdict(dict)
        for _, a, p, ok, x in mine:
            good[p] |= {a: x} if ok else {}
        clash = sum(len(set(g.values())) > 1 for g in good.values())
        if len({n for _, n in attempts.values()}) > 1:
            refused.append((item, "mixed_totals", clash))
        elif clash:
            refused.append((item, "conflict", clash))
        else:
            for p, g in good.items():
                source = next((a for a in order if a in g), None)
                merged.append((item, p, source, source is not None and source != order[0]))
    return Counter(merged), Counter(refused)


def test_composite_of_one_large_item(spark):
    rng = random.Random(7)
    cells = [(i, a, p, rng.random() < 0.6, None if rng.random() < 0.01 * (i > 1) else str(p + (rng.random() < 0.004 * (i > 2)))) for i, n in ((0, 150), (1, 20), (2, 30), (3, 40), (4, 10)) for a in range(3) for p in range(n) if i < 4 or a < 2 or p < 9]
    df = spark.createDataFrame(cells, "item int, attempt int, pos long, good boolean, payload string").repartition(3)
    want = plain_composite(cells)
    for width in (4, 1000):
        merged, refused = windows.composite(df, "item", "attempt", "pos", "good", "payload", width)
        assert (Counter(map(tuple, merged.select("item", "pos", "source", "filled").collect())), Counter(map(tuple, refused.select("item", "reason", "conflicts").collect()))) == want
    assert len(want[0]) and len(want[1]) > 1


def test_consensus_controls_in_blocks_of_any_cell(spark):
    rng = random.Random(9)
    cells = [(i, s, p, rng.random() < (0.95 if s == 0 else 0.7), f"{p}{'x' if i == 2 and s else ''}") for i in range(4) for s in range(3) for p in range(80)] + [(9, 0, 0, True, "a"), (9, 1, 0, True, None), (8, 0, 0, True, None), (8, 1, 0, True, None)]
    df = spark.createDataFrame(cells, "item int, source int, pos long, good boolean, payload string").repartition(3)
    run = lambda cell: [Counter(tuple(map(str, r)) for r in x.collect()) for x in windows.consensus_of_one_item(df, "item", "pos", "source", "good", "payload", 16, 2, 16, cell)]
    want = run(1 << 16)
    assert run(8) == want and run(1) == want
    assert {r[:2] for r in want[1]} >= {("2", "identity")} and any(r[0] == "0" for r in want[0])
    # Two good reads, one of them a null, are two values; two nulls are one.
    state = {r.item: r.state for r in windows.consensus(df, "item", "pos", "source", "good", "payload").where("item > 7").collect()}
    assert state == {9: "conflict", 8: "corroborated"}


def test_sixteen_matches_in_two_controls(spark):
    # The rule itself: two full blocks of 16, and a second source that holds 15 or 16 of their positions.
    for held, want in ((16, []), (15, [("identity",)])):
        cells = [(0, 0, p, True, str(p)) for p in range(40)] + [(0, 1, p, p < held, str(p)) for p in range(40)]
        df = spark.createDataFrame(cells, "item int, source int, pos long, good boolean, payload string")
        merged, refused = windows.consensus_of_one_item(df, "item", "pos", "source", "good", "payload", 16)
        assert rows(refused, "reason") == want and merged.count() == (0 if want else 40)


def test_ranks_of_a_hot_group(spark):
    rng = random.Random(3)
    data = [(rng.choice(("hot", "hot", "a", "b", None)), rng.randrange(50), i) for i in range(600)]
    df = spark.createDataFrame(data, "k string, o int, i int").repartition(4)
    want = Counter()
    for k in {d[0] for d in data}:
        want.update((k, i, n + 1) for n, (_, i) in enumerate(sorted((o, i) for kk, o, i in data if kk == k)))
    for hot in (1, 40, 1000):
        got = ranks.ranked(df, ["k"], [F.col("o"), F.col("i")], hot_rows=hot)
        assert Counter(map(tuple, got.select("k", "i", "rank").collect())) == want
        first = ranks.keep_first(df, "k", [F.col("i")], hot)
        assert rows(first.where("not rejected and k is not null"), "k", "i") == sorted((k, min(i for kk, _, i in data if kk == k)) for k in ("a", "b", "hot"))


def test_names_that_a_third_of_the_rows_share(spark):
    rng = random.Random(5)
    names = [rng.choice(("same.doc", "Same.doc", "SAME.DOC", "same [recovered copy 3].doc", f"n{rng.randrange(90)}.txt", f"n{rng.randrange(90)}.txt")) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string").repartition(4)
    cols = ("i", "unique_name", "clash")
    want = rows(ranks.unique_names(df, "n", [F.col("i")]), *cols)
    assert rows(ranks.unique_names(df, "n", [F.col("i")], hot_rows=25), *cols) == want
    assert len({n.lower() for _, n, clash in want if not clash}) == sum(not c for *_, c in want)


def test_bag_match_with_hot_and_missing_keys(spark):
    rng = random.Random(6)
    side = lambda n: [(i, "it", rng.choice(("e.txt", "E.txt", f"p{rng.randrange(40)}", None)), rng.choice(("empty", "empty", f"s{rng.randrange(30)}", None)), rng.choice((0, 0, 1, None)), rng.random() < 0.6) for i in range(n)]
    ref = spark.createDataFrame(side(160), "ref_id long, item string, path string, sha string, bytes long, scope boolean")
    cur = spark.createDataFrame(side(140), "cur_id long, item string, path string, sha string, bytes long, scope boolean")
    match = lambda hot: Counter(map(tuple, joins.bag_match(ref, cur, ["item"], scope="scope", hot_rows=hot).collect()))
    want = match(1 << 20)
    assert match(10) == want and len(want) >= 160


def test_runs_and_gaps_take_one_sort_of_a_bounded_share(spark, capsys, monkeypatch):
    df = spark.range(1000).selectExpr("id % 3 AS item", "id * 2 AS pos", "id AS seq")
    monkeypatch.setattr(scratch.tasks_for, "__defaults__", (50,))
    made = {"islands": windows.islands(df, ["item"], "pos"), "gaps": windows.gaps(df, ["item"], "pos"), "extents": windows.coalesce_extents(df, ["item"], "seq", "pos")}
    for name, got in made.items():
        capsys.readouterr()
        got.explain()
        plan = capsys.readouterr().out
        # Tasks grow with the rows (20 here, not the 4 of the session), and no row of a position goes through a hash table.
        assert "__cell" in plan and ", 20), REPARTITION_BY_NUM" in plan, name
        assert not any("HashAggregate" in x and "pos#" in x.split("functions=")[0] for x in plan.splitlines()), name
    assert made["gaps"].count() == 997 and made["islands"].count() == 1000 == made["extents"].count()


def test_composite_of_incomplete_attempts_needs_no_filler_rows(spark, capsys):
    rng = random.Random(11)
    units = [(i, a, p, rng.random() < 0.7, str(p + (rng.random() < 0.02 * (i % 3 == 0)))) for i in range(12) for a in range(4) for p in range(15) if rng.random() < 0.5] + [(None, 1, 2, True, "x"), (None, 2, 3, True, "y")]
    df = spark.createDataFrame(units, "item int, attempt int, pos long, good boolean, payload string").repartition(3)
    full = windows.complete_units(df.where("item IS NOT NULL"), "item", "attempt", "pos", "good", "payload")
    got = lambda parts: [Counter(map(tuple, x.where("item IS NOT NULL").collect())) for x in parts]
    want = got(windows.composite(full, "item", "attempt", "pos", "good", "payload"))
    parts = windows.composite(df, "item", "attempt", "pos", "good", "payload", 4, complete=True)
    assert got(parts) == want and all(want)
    assert sorted((r.pos, r.source) for r in parts[0].where("item IS NULL").collect()) == [(2, 1), (3, 2)]
    capsys.readouterr()
    parts[1].explain()
    assert "Join" not in capsys.readouterr().out
