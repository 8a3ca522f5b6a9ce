import random

from pyspark.sql import functions as F

from tessera.functions import codes, paths
from tessera.operators import aggregates, generations, joins, ranks, windows
from tessera.sources import logs, readers, sinks


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_islands_and_gaps(spark):
    df = spark.createDataFrame([("d", p) for p in (1, 2, 4, 7, 8, 9)], "item string, pos long")
    assert rows(windows.islands(df, ["item"], "pos"), "first", "last", "length") == [(1, 2, 2), (4, 4, 1), (7, 9, 3)]
    assert rows(windows.gaps(df, ["item"], "pos"), "first", "last") == [(3, 3), (5, 6)]


def units(spark, cells):
    return spark.createDataFrame([("d", a, p, g, s) for a, p, g, s in cells], "item string, attempt int, pos int, good boolean, payload string")


def test_composite_fills_refuses_and_leaves_unresolved(spark):
    fill = units(spark, [(1, 0, True, "x"), (1, 1, False, None), (2, 0, True, "x"), (2, 1, True, "y"), (2, 2, False, None), (2, 3, False, None), (1, 2, True, "z"), (1, 3, True, "w")])
    merged, refused = windows.composite(fill, "item", "attempt", "pos", "good", "payload")
    assert rows(merged, "pos", "source", "filled") == [(0, 1, False), (1, 2, True), (2, 1, False), (3, 1, False)]
    assert refused.count() == 0
    bad = units(spark, [(1, 0, True, "x"), (2, 0, True, "y")])
    merged, refused = windows.composite(bad, "item", "attempt", "pos", "good", "payload")
    assert merged.count() == 0 and rows(refused, "item", "reason", "conflicts") == [("d", "conflict", 1)]
    none = units(spark, [(1, 0, False, None), (2, 0, False, None)])
    assert rows(windows.composite(none, "item", "attempt", "pos", "good", "payload")[0], "source", "filled") == [(None, False)]


def test_composite_refuses_attempts_of_other_sizes(spark):
    short = units(spark, [(1, 0, True, "x"), (2, 0, False, None), (2, 1, True, "y"), (2, 2, True, "z")])
    merged, refused = windows.composite(short, "item", "attempt", "pos", "good", "payload")
    assert merged.count() == 0 and rows(refused, "reason", "conflicts") == [("mixed_totals", 0)]
    full = windows.complete_units(short, "item", "attempt", "pos", "good", "payload")
    assert rows(windows.composite(full, "item", "attempt", "pos", "good", "payload")[0], "pos", "source", "filled") == [(0, 1, True), (1, 2, False), (2, 2, False)]


def test_consensus_needs_the_same_item(spark):
    cells = [(s, p, True, f"v{p}") for s in (1, 2) for p in range(4)]
    got = lambda c, least=2: windows.consensus_of_one_item(units(spark, c), "item", "pos", "attempt", "good", "payload", 2, 1, least)
    ok, refused = got(cells)
    assert refused.count() == 0 and rows(ok, "pos", "state") == [(p, "corroborated") for p in range(4)]
    assert rows(got(cells, 3)[1], "reason") == [("identity",)]  # the control block has two positions
    other = [c if c[:2] != (2, 3) else (2, 3, True, "x") for c in cells]
    assert rows(got(other)[0], "pos", "state")[3] == (3, "conflict")
    assert rows(got([c if c[:2] != (2, 1) else (2, 1, True, "x") for c in cells], 1)[1], "reason") == [("control_conflict",)]
    assert got([c for c in cells if c[0] == 1], 99)[1].count() == 0  # one source needs no match


INVENTORY = "item string, {} long, path string, sha string, bytes long, scope boolean"


def greedy(ref, cur):
    """The match as a loop: payload rows finish all modes first, every row takes the first candidate that is left."""
    out, left = [], sorted(cur, key=lambda c: (c[2], c[1]))
    open_ = sorted(ref, key=lambda r: (not r[5], r[2], r[1]))
    for scope in (True, False):
        for name, same in ((joins.SAME, lambda r, c: (r[2].lower(), r[3]) == (c[2].lower(), c[3])), (joins.MOVED, lambda r, c: r[3:5] == c[3:5]), (joins.CHANGED, lambda r, c: r[2].lower() == c[2].lower())):
            for r in [r for r in open_ if r[5] == scope]:
                hit = next((c for c in left if c[0] == r[0] and same(r, c)), None)
                if hit:
                    out.append((r[0], r[1], hit[1], name))
                    open_.remove(r)
                    left.remove(hit)
    return out + [(r[0], r[1], None, joins.MISSING) for r in open_] + [(c[0], None, c[1], joins.CURRENT_ONLY) for c in left]


def test_bag_match_equals_greedy_passes(spark):
    key = lambda x: tuple(str(v) for v in x)
    frame = lambda data, name: spark.createDataFrame(data, INVENTORY.format(name))
    ref = [("d", 1, "r/a", "same", 1, True), ("d", 2, "r/b", "same", 1, True), ("d", 3, "r/c", "old", 1, True), ("d", 4, "lost", "l", 1, True)]
    cur = [("d", 1, "r/b", "same", 1, None), ("d", 2, "renamed", "same", 1, None), ("d", 3, "r/c", "new", 1, None), ("d", 4, "extra", "e", 1, None)]
    got = joins.bag_match(frame(ref, "ref_id"), frame(cur, "cur_id"), ["item"], scope="scope")
    assert {r.status for r in got.collect()} == {joins.SAME, joins.MOVED, joins.CHANGED, joins.MISSING, joins.CURRENT_ONLY}
    # A payload row that moved goes before a temporary row that stayed.
    ref, cur = [("d", 1, "p/old", "S", 1, True), ("d", 2, "t/x", "S", 1, False)], [("d", 1, "t/x", "S", 1, None)]
    got = joins.bag_match(frame(ref, "ref_id"), frame(cur, "cur_id"), ["item"], scope="scope")
    assert rows(got, "ref_id", "status") == [(1, joins.MOVED), (2, joins.MISSING)]
    rng = random.Random(3)
    make = lambda: [(rng.choice("de"), i, rng.choice("pP") + str(rng.randrange(9)), f"s{rng.randrange(5)}", 1, rng.random() < 0.6) for i in range(60)]
    ref, cur = make(), make()
    got = [(r.item, r.ref_id, r.cur_id, r.status) for r in joins.bag_match(frame(ref, "ref_id"), frame(cur, "cur_id"), ["item"], scope="scope").collect()]
    assert sorted(got, key=key) == sorted(greedy(ref, cur), key=key)


def test_range_join_with_long_ranges(spark):
    rng = random.Random(4)
    ranges = [("i", k, s := rng.randrange(5000), s + rng.choice([0, 3, 70, 1500, 100000, -1])) for k in range(60)] + [("i", 99, 0, 10_000_000)]
    points = [("i", rng.randrange(7000)) for _ in range(80)]
    got = joins.range_join(spark.createDataFrame(points, "item string, pos long"), spark.createDataFrame(ranges, "item string, k int, lo long, hi long"), ["item"], "pos", "lo", "hi")
    assert rows(got, "pos", "k") == sorted((p, k) for _, p in points for _, k, lo, hi in ranges if lo <= p <= hi)
    damage = spark.createDataFrame([("i", 5), ("i", 50)], "item string, pos long")
    extents = spark.createDataFrame([("i", "f", 4, 9, 1024)], "item string, path string, lo long, hi long, at long")
    assert rows(joins.damaged_files(damage, extents, ["item"], "pos", "lo", "hi", "at", 512), "pos", "path", "file_byte", "known_dependency") == [(5, "f", 1536, True), (50, None, None, False)]


def test_containment_equals_search(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    needles = [(i, text(rng.choice([20, 40, 64, 90]))) for i in range(12)] + [(50, "ab" * 20)]
    hays = [(i, text(rng.randrange(300)) + "".join(rng.choice(needles)[1] + text(rng.randrange(60)) for _ in range(3))) for i in range(40)] + [(90, "ab" * 60), (91, None), (92, "")]
    got = joins.containment(spark.createDataFrame(needles, "n int, needle string"), spark.createDataFrame(hays, "h int, hay string"), "n", "needle", "h", "hay", 40, 16, 5)
    want = []
    for n, x in needles:
        for h, y in hays:
            at = [i for i in range(len(y or "") - len(x) + 1) if y[i : i + len(x)] == x] if len(x) >= 40 else []
            if at:
                want.append((n, h, at[0], at[:5], len(at) >= 5))
    assert rows(got, "n", "h", "offset", "offsets", "further_unknown") == sorted(want)


def test_differences_components_and_cells(spark):
    df = spark.createDataFrame([(1, "abcdef", "abXdYY"), (2, "abc", "abcdef"), (3, "", ""), (4, "x", None), (5, "a-" * 40, "b-" * 40)], "k int, a string, b string")
    got = {r.k: (r.different, [tuple(x) for x in r.runs][:2], len(r.runs), r.more) for r in joins.diff_runs(df, ["k"], "a", "b").collect()}
    assert got == {1: (3, [(2, 1), (4, 2)], 2, False), 2: (3, [(3, 3)], 1, False), 3: (0, [], 0, False), 4: (1, [(0, 1)], 1, False), 5: (40, [(0, 1), (2, 1)], 32, True)}
    a = spark.createDataFrame([("c", "/text", "t"), ("c", "/info", "i"), ("d", "/text", "t")], "c string, s string, v string")
    b = spark.createDataFrame([("c", "/text", "t"), ("c", "/info", "j"), ("d", "/text", "u")], "c string, s string, v string")
    assert rows(joins.compare_components(a, b, "c", "s", "v", ["/info"]), "c", "equal_parts", "all_equal", "only_summary_differs") == [("c", 1, False, True), ("d", 0, False, False)]
    x = spark.createDataFrame([("i", 0, "abc"), ("i", 1, "abc"), ("i", 2, None)], "item string, pos int, cell string")
    y = spark.createDataFrame([("i", 0, "abc"), ("i", 1, "aXcd"), ("i", 3, "zz")], "item string, pos int, cell string")
    assert rows(joins.compare_cells(x, y, "item"), "agree", "differ", "unavailable") == [(5, 2, 2)]


def test_agreement_gate_and_mirror(spark):
    cell = lambda x: spark.createDataFrame(x, "i string, p long, v string")
    a = cell([("i", p, "x") for p in range(200)] + [("z", 1, "q")])
    b = cell([("i", p, "y" if p == 7 else "x") for p in range(200)] + [("g", 1, "q")])
    sizes = spark.createDataFrame([("i", 9, 9), ("z", 9, 9), ("g", 9, 8)], "i string, a_size int, b_size int")
    got = joins.conflict_gate(joins.agreement(a, b, "i", "p", "v", sizes))
    assert rows(got, "i", "agree", "conflict", "verdict", "gate") == [("g", 0, 0, "geometry", "custody_only"), ("i", 199, 1, "disagree", "pass"), ("z", 0, 0, "no_overlap", "refuse")]
    u = spark.createDataFrame([("d", p, p not in (1, 12, 15, 30)) for p in range(31) if p != 5], "i string, p long, g boolean")
    assert rows(joins.mirror_fill(u, "i", "p", "g", 10, 5, 2), "p", "donor") == [(1, None), (12, 17), (15, 10), (30, None)]


def test_occupancy_is_union_and_intersection(spark):
    rng = random.Random(1)
    data = [("i", rng.choice("ab"), s := rng.randrange(50), s + rng.randrange(12)) for _ in range(20)]
    df = spark.createDataFrame(data, "item string, lane string, s long, e long")
    busy = sum(any(s <= t < e for _, _, s, e in data) for t in range(80))
    both = sum(all(any(x == lane and s <= t < e for _, x, s, e in data) for lane in "ab") for t in range(80))
    assert rows(windows.occupancy(df, "item", "lane", "s", "e"), "busy", "both") == [(busy, both)]


def test_forecast_needs_three_samples(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 1.0), ("b", 2.0), ("b", -1.0)], "k string, v double")
    assert rows(aggregates.forecast(df, ["k"], "v", 2), "k", "samples", "low", "high", "median", "reason") == [("a", 2, None, None, None, "fewer_than_three"), ("b", 3, 2.0, 6.0, 2.0, None)]


def test_ranks_of_any_values(spark):
    rng = random.Random(2)
    data = [("a", rng.choice([0.0, -1.5, 3.25, 1e-9, 1e12, rng.random(), -rng.random() * 1000])) for _ in range(501)]
    got = aggregates.timing_stats(spark.createDataFrame(data, "k string, v double"), ["k"], "v").first()
    v = sorted(x for _, x in data)
    assert (got.n, got.median, got.p95) == (501, v[250], v[(501 * 95 + 99) // 100 - 1])
    none = aggregates.forecast(spark.createDataFrame([("a", 1.0)], "k string, v double"), ["k"], "v", 0).first()
    assert (none.low, none.high, none.reason) == (0.0, 0.0, None)


def test_timing(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 30.0)], "k string, v double")
    assert rows(aggregates.timing_stats(df, ["k"], "v"), "n", "mean", "median", "p95") == [(2, 20.0, 20.0, 30.0)]


def test_urgency_order(spark):
    df = spark.createDataFrame([(1, 400, False, 0, True), (2, 1, False, 0, True), (3, 9, False, 0, True), (4, 99, False, 0, True), (5, 1, True, 99, False)], "item int, missing int, first boolean, age int, ready boolean").withColumn("total", F.lit(1440))
    got = aggregates.urgency(df, "missing", "total", "first", "age", "ready", "item").collect()
    assert [r.item for r in got] == [2, 3, 4, 1, 5] and got[-1].score == 1190


def test_generation_fold(spark):
    df = spark.createDataFrame([("d", 1, "a"), ("d", 2, "a"), ("d", 2, "b"), ("d", 3, "b"), ("d", 4, "a"), ("d", 4, "b")], "item string, generation int, sha string")
    assert rows(generations.generation_fold(df, "item", "generation", "sha"), "generation", "state") == [(1, "promoted"), (2, "promoted"), (3, "alternate"), (4, "promoted")]


def test_generation_fold_brute_force(spark):
    rng = random.Random(11)
    data = [(rng.choice(["d", "e", "f", None]), rng.choice([1, 2, 3, 4, None]), rng.choice(["a", "b", None]), rng.random() < 0.8, rng.random() < 0.5) for _ in range(400)]
    data += [("g", g, "a", r, n) for g, r, n in ((1, True, False), (2, False, True), (3, True, True), (4, True, False), (5, True, True))]
    df = spark.createDataFrame(data, "item string, generation int, sha string, ok boolean, named boolean")
    want = {}
    for full in (False, True):
        for i in {x[0] for x in data}:
            chosen = None
            for g in sorted({x[1] for x in data if x[0] == i}, key=lambda g: (g is None, g or 0)):
                mine = [x for x in data if x[:2] == (i, g)]
                bag = {("all", k): sum(x[2] == k for x in mine) for k in ("a", "b", None)}
                if full:
                    bag |= {("ok", k): sum(x[2] == k and x[3] for x in mine) for k in ("a", "b", None)} | {"names": sum(x[4] for x in mine)}
                better = chosen is None or all(bag[k] >= chosen[k] for k in bag)
                chosen = bag if better else chosen
                want[full, i, g] = "promoted" if better else "alternate"
    got = {(full, r.item, r.generation): r.state for full, x in ((False, {}), (True, {"reachable": F.col("ok"), "named": F.col("named")})) for r in generations.generation_fold(df, "item", "generation", "sha", **x).collect()}
    assert got == want


def test_generation_choice_reasons_and_binding(spark):
    f = lambda g, path, sha, named=False, image="i", item="d": (item, g, image, path, sha, 1, named)
    data = [f(1, "a", "x"), f(2, "a", "x"), f(2, "b", "y"), f(3, "a", "x"), f(4, "a", "x"), f(4, "b", "y", True), f(5, "a", "x", True), f(5, "b", "y"), f(6, "FragmentRecovery\\a", "x", True), f(6, "b", "y", True)]
    data += [f(1, "$Recycle.Bin/a", "x", item="e"), f(2, "a", "x", item="e"), f(1, "a", "x", item="r"), f(2, "a", "x", image="j", item="r"), f(1, "a", "x", image=None, item="n"), f(1, "b", "x", image="i", item="n")]
    df = spark.createDataFrame(data, "item string, g int, image string, path string, sha string, bytes long, named boolean")
    got, refused = generations.generation_choice(df, "item", "g", "image", "path", "sha", "bytes", F.col("named"))
    assert rows(got.where("item = 'd'"), "generation", "state", "reason") == [(1, "promoted", "first"), (2, "promoted", "more"), (3, "alternate", "loses"), (4, "promoted", "names"), (5, "promoted", "newer"), (6, "alternate", "loses")]
    assert rows(got.where("item = 'e'"), "generation", "reason", "files", "bytes", "reachable") == [(1, "first", 0, 0, 0), (2, "more", 1, 1, 1)]
    assert rows(refused, "item", "reason") == [("n", "different_images"), ("r", "different_images")] and got.where("item IN ('n', 'r')").count() == 0


def test_generation_fold_query_reads_whole_texts(spark, tmp_path):
    from tessera.plans import catalog

    rows_ = [("s", "de", "the same start, a"), ("s", "de", "the same start, b"), ("s", "en", "the same start, a"), ("s", "en", "the same start, c")]
    spark.createDataFrame(rows_, "source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert rows(catalog.QUERIES["w15_generation_fold"](spark, str(tmp_path)), "generation", "state") == [("de", "promoted"), ("en", "alternate")]


def test_pass_attribution(spark):
    def run(log, bad):
        rows_ = [("d", n, *x) for n, x in enumerate(log)]
        log_ = spark.createDataFrame(rows_, "item string, line int, pos int, kind string, number int, direction string")
        where = spark.createDataFrame([("d", p, p in bad) for p in range(3)], "item string, pos int, bad boolean")
        return windows.pass_attribution(log_, where, "item", "pos", "line", "kind", "number", "direction", "bad")

    good = [(1, "read_failed", None, None), (2, "read_failed", None, None), (1, "retry_failed", 1, "backward"), (2, "retry_failed", 1, "backward"), (1, "recovered", 2, "forward"), (2, "retry_failed", 2, "forward")]
    out, refused = run(good, {2})
    assert refused.count() == 0 and rows(out, "pos", "successful_pass", "last_pass", "direction") == [(0, 0, 0, "forward"), (1, 2, 2, "forward"), (2, None, 2, "forward")]
    assert rows(out, "evidence") == [("explicit_failure",), ("explicit_recovery",), ("implicit_initial_success",)]
    for log, bad in ((good[:4] + [(1, "recovered", 2, "backward"), good[5]], {2}), (good, {1, 2}), (good, {0, 2}), (good[1:], {2}), (good + [(1, "retry_failed", 3, "backward")], {2})):
        assert run(log, bad)[1].count() == 1


def test_sequences_names_and_logs(spark):
    e = spark.createDataFrame([("s", 0, 5, "start"), ("s", 1, 4, "x"), ("s", 3, 6, "start"), ("s", 4, 7, "end"), ("s", 5, 8, "x"), ("t", 0, 1, "x")], "s string, seq long, ms long, kind string")
    got = windows.sequence_faults(e, "s", "seq", "ms", "kind", "start", "end")
    assert rows(got, "s", "events", "gaps", "backward", "bad_start", "extra_starts", "after_finish") == [("s", 5, 3, 1, 0, 1, 1), ("t", 1, 0, 0, 1, 0, 0)]
    n = spark.createDataFrame([(1, "A.doc"), (2, "a.DOC"), (3, "a [recovered copy 2].doc"), (4, "d/x"), (5, "a.doc"), (6, "D/x")], "k int, n string")
    got = ranks.unique_names(n, "n", [F.col("k")])
    assert [r.unique_name for r in got.orderBy("k").collect()] == ["A.doc", "a [recovered copy 2].DOC", "a [recovered copy 2] [recovered copy 2].doc", "d/x", "a [recovered copy 3].doc", "D/x [recovered copy 2]"] and not any(r.clash for r in got.collect())
    assert [r.clash for r in ranks.unique_names(n, "n", [F.col("k")], 0).orderBy("k").collect()] == [False, True, False, False, True, True]
    logs = spark.createDataFrame([(7, "x/007.txt"), (7, "x/007_attempt_1.log"), (8, "008_retry.log"), (8, "008b.log"), (9, "note.log")], "i int, p string")
    assert rows(windows.primary_log(logs, "i", "p"), "i", "p", "score") == [(7, "x/007.txt", 100), (8, "008b.log", 70)]
    u = spark.createDataFrame([("i", 1, 5), ("i", 2, 5), ("i", 2, 6)], "i string, a int, p int")
    sizes = spark.createDataFrame([("i", 1, 10), ("i", 2, 12)], "i string, a int, total int")
    assert rows(windows.attempt_changes(u, "i", "a", "p"), "recovered", "newly_bad", "still_bad") == [(0, 1, 1)]
    assert rows(windows.attempt_changes(u, "i", "a", "p", sizes), "recovered", "newly_bad", "still_bad") == [(None, None, None)]


def test_claims_and_observations(spark):
    o = spark.createDataFrame([(1, True, "x"), (2, True, "y"), (3, True, "x"), (3, True, "y"), (4, False, "x")], "p int, ok boolean, s string")
    got = aggregates.observation_consensus(o, ["p"], "ok", "s", F.lit("x"))
    assert rows(got, "p", "state") == [(1, "validated"), (2, "conflicting"), (3, "conflicting"), (4, "unconfirmed")]
    claims = spark.createDataFrame([("i", 1, "x", False, [1, 2]), ("i", 2, "x", False, [1]), ("i", 3, "x", False, [1]), ("i", 4, None, True, [])], "i string, p int, s string, unresolved boolean, attempts array<int>")
    read = spark.createDataFrame([("i", 1, 1, "x"), ("i", 1, 3, "x"), ("i", 2, 2, "x"), ("i", 3, 1, "x"), ("i", 3, 2, "z")], "i string, p int, a int, s string")
    checked = aggregates.claim_check(claims, read, "i", "p", "a", "s")
    assert rows(checked, "p", "state", "supporting") == [(1, "validated", [1]), (2, "unconfirmed", None), (3, "conflicting", None), (4, "unresolved", None)]
    sizes = spark.createDataFrame([("i", 5)], "i string, size int")
    assert rows(aggregates.claim_totals(checked, sizes, "i", "size"), "validated", "unresolved", "complete") == [(1, 1, False)]


def test_stalls(spark):
    left = spark.createDataFrame([("d", i, v) for i, v in enumerate((9, 7, 7, 7, 3))], "item string, n int, v int")
    assert rows(windows.stalls(left, "item", [F.col("n")], "v", 2), "longest_stall", "stop_at") == [(2, 4)]


def test_paths_and_codes(spark):
    df = spark.createDataFrame([("$Root/$Noname 01/a.doc",), ("x/[$Raw Files by Signatures]/b.png",), ("RECYCLER/c",), ("../d",), ("~e",)], "p string")
    got = df.select("p", paths.category(F.col("p"), F.lit(1)).alias("c"), paths.origin(F.col("p")).alias("o"), paths.normalized_path(F.col("p")).alias("n"), paths.delivery(F.col("p")).alias("d"), paths.target_format(F.col("p")).alias("t")).collect()
    assert [r.c for r in got] == ["payload", "payload", "os_metadata", "payload", "temporary"]
    assert [r.o for r in got] == ["tool_filesystem", "signature", "filesystem", "filesystem", "filesystem"]
    assert got[3].n is None and got[0].d.path == "a.doc" and got[1].d.path == "Signature-Recovered/x/b.png" and got[0].t == "docx"
    s = spark.createDataFrame([(b"\x89PNG\r\n\x1a\n..",), (b"{\\rtf1 x",), (b"zz",)], "b binary")
    assert [r[0] for r in s.select(codes.signature(F.col("b"))).collect()] == ["png", "rtf", None]


def test_event_log_and_listing(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"session":"s","seq":0,"kind":"a"}\nnot json\n{"session":"s","seq":1')
    events, faults = readers.read_event_log(spark, str(tmp_path / "log.jsonl"))
    assert rows(events, "session", "seq") == [("s", 0)] and rows(faults, "line", "fault") == [(1, "malformed"), (2, "torn_tail")]
    (tmp_path / "kv.log").write_text("[1] BEGIN | x=1\n[2] BAD_SECTOR | lba=7\n[3] END | status=OK\n")
    assert rows(logs.read_kv_log(spark, str(tmp_path / "kv.log"))[0], "status", "bad_positions") == [("OK", 1)]
    (tmp_path / "map.log").write_text("START\nC 1 > > 0 : 3\nE 2 > > 1 : 1\nSTOP\n")
    (tmp_path / "map.log").write_text("START\nC 1 > > 0 : 3\nSTOP\nSTART\nE 2 > > 1 : 1\nSTOP\n")
    assert rows(readers.read_range_map(spark, str(tmp_path / "map.log")), "pos", "state", "pass") == [(0, "C", 1), (1, "E", 2), (2, "C", 1)]


def test_catalog_claims_listing_archives_and_samples(spark, tmp_path):
    import io
    import zipfile

    d = tmp_path / "cat"
    d.mkdir()
    for name, n in (("002_attempt_001", 2), ("001_attempt_002", 1), ("001_attempt_002_copy", 1)):
        (d / f"{name}.json").write_text('{\n "disk_number": %d, "attempt_number": 1, "status": "%s"}' % (n, name))
    assert [tuple(r) for r in readers.read_attempt_catalog(spark, str(d), "disk_number int, attempt_number int, status string").collect()] == [(1, 1, "001_attempt_002", "001_attempt_002"), (2, 1, "002_attempt_001", "002_attempt_001")]
    (tmp_path / "c.csv").write_text('\ufeffFloppy,Note\n1,"two\nlines ""q"""\n', encoding="utf-8")
    got = readers.read_claims_csv(spark, str(tmp_path / "c.csv"))
    assert got.columns == ["Floppy", "Note"] and rows(got, "Note") == [('two\nlines "q"',)]
    (tmp_path / "l.txt").write_text("name size\na b 10 c d . Dir/My File.doc\na b 12 c d xf dir/my file.doc\na b 7 c d +.jpg x.jpg\na b 0 c d ? y\n", encoding="utf-16")
    assert rows(readers.read_listing(spark, str(tmp_path / "l.txt"))[0], "path", "bytes", "state") == [("dir/my file.doc", 0, "ambiguous"), ("x.jpg", 7, "signature_carved"), ("y", 0, "unknown")]
    z = tmp_path / "z"
    z.mkdir()
    with zipfile.ZipFile(z / "ok.zip", "w") as f:
        f.writestr("A.txt", "1")
        f.writestr("a.TXT", "2")
        f.writestr("../up", "3")
    (z / "bad.zip").write_bytes(b"no archive")
    got = readers.archive_inventory(spark, str(z))
    assert [(r.name, r.unsafe, r.collides, r.error is None) for r in got.orderBy("name").collect()] == [(None, None, False, False), ("../up", True, False, True), ("A.txt", False, True, True), ("a.TXT", False, True, True)]
    (tmp_path / "s.json").write_text('{"kind":"k","units":2,"elapsed_ms":4,"workers":1}\n{"kind":"k","units":0,"elapsed_ms":4,"workers":1}\n{"kind":"k","units":1')
    assert readers.read_samples(spark, str(tmp_path / "s.json")).count() == 1
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "x").write_bytes(b"abc")
    assert rows(readers.hash_inventory(spark, str(tmp_path / "h")), "bytes") == [(3,)]
    df = spark.createDataFrame([("=1", 'a"b'), ("x", None)], "p string, q string").coalesce(1)
    sinks.write_safe_csv(df, str(tmp_path / "csv"))
    text = b"".join(f.read_bytes() for f in (tmp_path / "csv").glob("part-*"))
    assert text == b'"p","q"\r\n"\'=1","a""b"\r\n"x",""\r\n'
    sinks.write_manifest(spark.createDataFrame([("i", "b", 2, 5, "s"), ("i", "a", 1, 9, "t")], "i string, p string, n long, m long, s string"), str(tmp_path / "m"), item="i", path="p", size="n", modified="m", sha="s")
    assert rows(spark.read.parquet(str(tmp_path / "m" / "totals")), "files", "bytes", "modified") == [(2, 3, 9)]
    assert io


def test_pairs_pace_and_latest_state_on_streams(spark, tmp_path):
    from tessera.streaming import events

    def stream(name, data, schema):
        path = str(tmp_path / name)
        spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_seconds("n")).coalesce(1).write.parquet(path)
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    def run(q, name, mode="append"):
        q = q.writeStream.format("memory").outputMode(mode).queryName(name).option("checkpointLocation", str(tmp_path / ("c" + name))).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name)

    starts = stream("starts", [("a", 100), ("b", 110), ("z", 90000)], "k string, n int")
    results = stream("results", [("a", 160), ("z", 90000)], "k string, n int")
    pairs = run(events.pair_stream(starts, results, ["k"], "ts", "ts", "1 HOUR"), "pairs")
    assert {(r.k, r.finished is not None) for r in pairs.collect()} == {("a", True), ("b", False), ("z", True)}
    paced = run(events.live_pace(stream("pace", [("a", 1), ("a", 2), ("b", 3), ("c", 9)], "k string, n int"), "ts", "k"), "paced")
    assert rows(paced, "item") == [("a",), ("b",), ("c",)]
    saved = spark.createDataFrame([("s", i, True) for i in (1, 2, 3, 3)] + [("p", 1, True)], "session string, item int, fresh boolean")
    state = spark.createDataFrame([("s", 0, 3600000, 6, False), ("p", 0, 3600000, 6, False), ("n", 0, 1, None, False)], "session string, started_ms long, now_ms long, remaining long, paused boolean")
    assert rows(events.pace_of(saved, state), "session", "saved", "per_hour", "eta_minutes", "reason") == [("n", 0, None, None, "no_endpoint"), ("p", 1, 1.0, None, "fewer_than_three"), ("s", 3, 3.0, 120.0, None)]
    batch = lambda x: spark.createDataFrame(x, "k string, v string, n int")
    merge = events.merge_latest(str(tmp_path / "state"), ["k"], "n", 4)
    for epoch, x in ((0, [("a", "queued", 1), ("b", "queued", 1)]), (3, [("a", "done", 2)]), (3, [("a", "done", 2)]), (4, [("c", "failed", 3), ("b", "old", 0)])):
        merge(batch(x), epoch)
    now = events.latest_state(spark, str(tmp_path / "state"), batch([]).schema)
    assert rows(now, "k", "v") == [("a", "done"), ("b", "queued"), ("c", "failed")] and rows(events.pending(now, "v"), "k") == [("b",), ("c",)]
    truth = batch([("a", "done", 2), ("b", "queued", 1), ("c", "lost", 3)])
    assert rows(events.reconcile(now, truth, ["k"]), "k", "only_in") == [("c", "batch"), ("c", "stream")]


def test_latest_state_keeps_two_versions_and_survives_restarts(spark, tmp_path):
    from tessera.streaming import events

    path = tmp_path / "state"
    batch = lambda x: spark.createDataFrame(x, "k string, n int, v string")
    assert events.latest_state(spark, str(path), batch([]).schema) is None
    merge = events.merge_latest(str(path), ["k"], "n", 4)
    for epoch in range(12):
        merge(batch([(f"k{i}", epoch, f"v{epoch}") for i in range(40)]), epoch)
    merge(batch([]), 12)
    state = lambda: dict(rows(events.latest_state(spark, str(path), batch([]).schema), "k", "v"))
    assert state() == {f"k{i}": "v11" for i in range(40)}
    assert len(list((path / "rows").glob("version=*/slot=*"))) == 8 and len(list((path / "live").glob("[0-9]*"))) == 2
    # A query with a new checkpoint starts at epoch 0 again, and a batch that is repeated or old changes nothing.
    again = events.merge_latest(str(path), ["k"], "n", 4)
    again(batch([("k1", 20, "new"), ("k2", 3, "old")]), 0)
    again(batch([("k1", 20, "new"), ("k2", 3, "old")]), 0)
    assert state() == {f"k{i}": "v11" for i in range(40)} | {"k1": "new"}
    # Rows without a pointer, and a pointer that was cut short, are not read.
    batch([("k1", 99, "lost")]).write.parquet(str(path / "rows" / "version=99" / "slot=0"))
    (path / "live" / "000000000098").write_text('{"0":')
    assert state()["k1"] == "new"
    merge(batch([("k3", 30, "last")]), 1)
    assert state()["k3"] == "last" and state()["k1"] == "new"


def test_late_rows_go_to_quarantine(spark, tmp_path):
    from tessera.streaming import events

    source, schema = str(tmp_path / "in"), "k int, at long"
    stamped = lambda data: spark.createDataFrame(data, schema).withColumn("ts", F.timestamp_seconds("at"))
    parts = [[(1, 1000), (2, 5000)], [(3, 4401), (4, 4399), (5, None), (6, 9000)], [(7, 8400), (8, 8399)], [(9, 1), (10, 9001)]]
    kept = str(tmp_path / "kept")

    def run(n):
        for i in n:
            stamped(parts[i]).coalesce(1).write.mode("append").parquet(source)
            split = events.quarantine_late(str(tmp_path / "q"), "ts", lambda df, epoch: df.write.mode("overwrite").parquet(f"{kept}/epoch={epoch}"))
            q = spark.readStream.schema(stamped([]).schema).parquet(source).writeStream.foreachBatch(split).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            q.awaitTermination(60)
            assert q.exception() is None

    run([0, 1])
    run([2, 3])  # a restarted query goes on with the watermark that was written down
    late = rows(spark.read.parquet(str(tmp_path / "q" / "late")), "k", "reason")
    assert late == [(4, "late"), (5, "no_time"), (8, "late"), (9, "late")]
    assert sorted(r.k for r in spark.read.parquet(kept).collect()) == [1, 2, 3, 6, 7, 10]
    # A batch that is repeated is split as before.
    again = []
    events.quarantine_late(str(tmp_path / "q"), "ts", lambda df, epoch: again.extend(r.k for r in df.collect()))(stamped(parts[3]), 3)
    assert again == [10] and rows(spark.read.parquet(str(tmp_path / "q" / "late")), "k", "reason") == late


def test_snapshot_is_idempotent_and_refuses_changes(spark, tmp_path):
    import pytest

    path, schema = str(tmp_path / "s"), "k int, v string"
    df = spark.createDataFrame([(1, "a"), (2, None), (1, "a")], schema)
    published = lambda: rows(sinks.read_snapshot(spark, path, df.schema), "k", "v")
    assert published() == [] and sinks.write_snapshot(df.limit(0), path, "k") == 0
    assert sinks.write_snapshot(df, path, "k") == 2  # a row that is repeated is published once
    assert sinks.write_snapshot(df, path, "k") == 0  # so is a job
    for bad in ([(1, "z")], [(3, "x"), (3, "y")], [(4, None), (4, "")], [(None, "x")]):
        with pytest.raises(ValueError):
            sinks.write_snapshot(spark.createDataFrame(bad, schema), path, "k")
    assert published() == [(1, "a"), (2, None)]
    assert sinks.write_snapshot(spark.createDataFrame([(1, "a"), (3, "c")], schema), path, "k") == 1


def test_snapshot_readers_go_by_commit_records(spark, tmp_path, monkeypatch):
    path, schema = tmp_path / "s", "k int, v string"
    one, two = (spark.createDataFrame([r], schema) for r in ((1, "a"), (2, "b")))
    sinks.write_snapshot(one, str(path), "k")
    # What a lost job left, and a record that was cut short, are not read.
    two.withColumn("content_sha", F.lit("x")).write.parquet(str(path / "rows" / "lost"))
    (path / "commits" / "000000000001").write_text("half")
    assert rows(sinks.read_snapshot(spark, str(path), one.schema), "k") == [(1,)]
    # Another writer takes the number between the look and the record: the loser looks again, and finds its row published.
    look, calls = sinks._commits, []

    def late(s, p):
        got = look(s, p)
        if not calls and calls.append(1) is None:
            monkeypatch.setattr(sinks, "_commits", look)
            assert sinks.write_snapshot(two, p, "k") == 1
        return got

    monkeypatch.setattr(sinks, "_commits", late)
    assert sinks.write_snapshot(two, str(path), "k") == 0
    assert rows(sinks.read_snapshot(spark, str(path), one.schema), "k", "v") == [(1, "a"), (2, "b")]


def test_safe_csv_of_an_empty_table_has_a_header(spark, tmp_path):
    sinks.write_safe_csv(spark.createDataFrame([], 'a string, `b"c` int'), str(tmp_path / "c"))
    assert [p.read_bytes() for p in (tmp_path / "c").glob("part-*")] == [b'"a","b""c"\r\n']


def test_digest_tree_tells_changed_leaves(spark):
    rng = random.Random(2)
    data = [(i, rng.choice(("x", None, "y"))) for i in range(500)]
    schema = "k int, v string"
    a, b = spark.createDataFrame(data, schema).repartition(4), spark.createDataFrame(data[::-1], schema).repartition(2)
    for digits in (2, 4):
        assert joins.digest_tree(a, "k", ["v"], digits)[-1].collect() == joins.digest_tree(b, "k", ["v"], digits)[-1].collect()
        assert joins.changed_leaves(a, b, "k", ["v"], digits).count() == 0
        other = spark.createDataFrame([(i, "new" if i in (7, 70) else v) for i, v in data if i != 9] + [(900, None)], schema)
        assert rows(joins.changes_in_leaves(a, other, "k", ["v"], digits), "k", "change") == [(7, "changed"), (9, "removed"), (70, "changed"), (900, "added")]
        assert 1 <= joins.changed_leaves(a, other, "k", ["v"], digits).count() <= 4
    # A null and a value, and repeated rows, are told apart.
    less = spark.createDataFrame([*data, data[0]], schema)
    assert [r.changed_during_run for r in joins.changed_during_run(a, less, "k", ["v"]).collect()] == [True]
    assert [tuple(r) for r in joins.changed_during_run(a.limit(0), a.limit(0), "k", ["v"]).collect()] == [(0, 0, False)]
    assert (joins.leaf_digits(10), joins.leaf_digits(4096 << 8), joins.leaf_digits((4096 << 8) + 1)) == (2, 2, 4)


def test_binary_cells_of_a_large_file(spark, tmp_path):
    import hashlib

    import pytest

    body = random.Random(1).randbytes(512 * 5000)
    (tmp_path / "image").write_bytes(body)
    got = rows(readers.binary_cells(spark, str(tmp_path / "image"), 512), "pos", "sha")
    assert got == [(i, hashlib.sha256(body[i * 512 : i * 512 + 512]).hexdigest()) for i in range(5000)]
    (tmp_path / "torn").write_bytes(body[:-1])
    (tmp_path / "empty").write_bytes(b"")
    assert readers.binary_cells(spark, str(tmp_path / "empty"), 512).count() == 0
    for size, name in ((512, "torn"), (64, "image")):
        with pytest.raises(ValueError):
            readers.binary_cells(spark, str(tmp_path / name), size)


def test_stream_equals_batch(spark, tmp_path):
    from tessera.streaming import events

    src = tmp_path / "in"
    spark.createDataFrame([("s", 0, "start", 1), ("s", 0, "start", 1), ("s", 1, "x", 2), ("t", 0, "start", 1)], "session string, seq long, kind string, n int").withColumn("ts", F.timestamp_seconds("n")).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    q = events.tail_events(stream, "session", "seq", "ts").writeStream.format("memory").queryName("tail").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("tail").count() == 3
    once = stream.select("session", "seq", "kind").dropDuplicates()
    q = events.session_states(once).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("states"), "session", "events", "faults") == [("s", 2, 0), ("t", 1, 0)]


def test_mapped_hits_tell_unknown_from_clear(spark):
    hits = spark.createDataFrame([(1, "a", 0, 9), (2, "a", 10, 19), (3, "b", 0, 9)], "hit int, hay string, lo long, hi long")
    damage = spark.createDataFrame([("a", 3), ("a", 3), ("a", 5)], "hay string, pos long")
    maps = spark.createDataFrame([("a",), ("a",)], "hay string")
    got = joins.mapped_hits(hits, maps, damage, ["hit", "hay", "lo", "hi"], "hay", "lo", "hi")
    assert rows(got, "hit", "damaged", "state") == [(1, 2, "damaged"), (2, 0, "clear"), (3, None, "map unavailable")]


def test_carving_by_format(spark):
    import struct
    import zlib

    from tessera.operators import carving

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"IEND") + chunk(b"IEND", b"")
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x01\x00\x00" + b"\x2c" + bytes(8) + b"\x00" + b"\x02\x02;;\x00" + b";"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04\xff\xd9" + b"\xff\xda\x00\x02ab\xff\x00c\xff\xd0d" + b"\xff\xd9"
    rtf = b"{\\rtf1 a\\}{b\\bin3 }}}c}}"
    good = [png, gif, jpeg, rtf]
    data = [(1, 10, b"..".join(good) + b".."), (2, 0, b"x" + png + gif[:-1]), (3, 0, png[:-1]), (4, 0, rtf[:-1] + png.replace(b"IDAT", b"IDAX")), (5, 0, None), (6, 0, b"")]
    regions = spark.createDataFrame(data, "i int, o long, c binary")
    got = rows(carving.carve(regions, "i", "o", "c"), "i", "o", "format", "bytes", "state", "reason")
    at = [10 + sum(len(x) + 2 for x in good[:k]) for k in range(4)]
    want = [(1, at[k], name, len(good[k]), "kept", None) for k, name in enumerate(("png", "gif", "jpeg", "rtf"))]
    want += [(2, 1, "png", len(png), "duplicate", None), (2, 1 + len(png), "gif", None, "rejected", "gif: cut off"), (3, 0, "png", None, "rejected", "png: cut off")]
    want += [(4, 0, "rtf", None, "rejected", "rtf: open group"), (4, len(rtf) - 1, "png", None, "rejected", "png: checksum")]
    assert sorted(got, key=lambda r: r[:2]) == want
    assert rows(carving.carve(regions, "i", "o", "c", max_probes=1).where("i < 3"), "i", "state") == [(1, "kept"), (1, "limit"), (2, "duplicate"), (2, "limit")]
    known = carving.carve(regions, "i", "o", "c").where("format = 'png' AND state = 'kept'")
    assert carving.carve(regions, "i", "o", "c", known=known).where("format = 'png' AND state = 'kept'").count() == 0
    cut = spark.createDataFrame([(1, 0, at[1] - 10), (1, at[2] - 10, 4)], "i int, offset long, bytes long")
    part = carving.readable_regions(regions, cut, "i", "c")
    assert rows(carving.carve(part, "i", "offset", "c"), "i", "offset", "state") == [(1, 0, "kept"), (1, at[2] - 10, "rejected")]
    assert carving.carve(regions.limit(0), "i", "o", "c").count() == 0


def test_carving_ends_in_linear_time(spark):
    import time

    from tessera.operators import carving

    open_groups = b"{\\rtf1 a" * 120_000  # a megabyte of groups that never end
    closed = b"{\\rtf1 a" * 60_000 + b"}" * 59_999
    markers = carving.between(b"<h>", b"</h>")
    regions = spark.createDataFrame([(1, 0, open_groups), (2, 0, closed), (3, 0, b"<h>" * 300_000)], "i int, o long, c binary")
    start = time.time()
    got = carving.carve(regions, "i", "o", "c")
    assert rows(got.where("i < 3").groupBy("i", "state").count(), "i", "state", "count") == [(1, "limit", 1), (1, "rejected", 1024), (2, "kept", 1), (2, "rejected", 1)]
    whole = carving.carve(regions.where("i <> 2"), "i", "o", "c", {**carving.FORMATS, "h": markers}, None, None)
    assert rows(whole.groupBy("i", "state").count(), "i", "state", "count") == [(1, "rejected", 120_000), (3, "rejected", 300_000)]
    assert time.time() - start < 60
    work = carving.carve(regions.where("i = 1"), "i", "o", "c", max_work=1000)
    assert rows(work, "state") == [("limit",), ("rejected",)]


def test_rollup_of_attempts(spark):
    data = [("a", 1, True, 5, 9, None), ("a", 2, False, 7, 9, None), ("a", 3, False, 7, 9, None), ("a", 4, True, 1, 9, None), ("b", 1, True, 3, 9, True), ("b", 2, False, 0, 9, False), ("c", 1, None, 2, 9, None)]
    df = spark.createDataFrame(data, "item string, n int, attention boolean, bad long, total long, preferred boolean")
    s = aggregates.item_summaries(df, "item", "n", "attention", "bad", "total", "preferred")
    assert rows(s, "item", "attempts", "latest_attempt", "latest_bad", "best_attempt", "best_bad", "attention") == [("a", 4, 4, 1, 3, 7, False), ("b", 2, 2, 0, 1, 3, True), ("c", 1, 1, 2, 1, 2, True)]
    assert [tuple(r) for r in aggregates.project_rollup(s).collect()] == [(3, 7, 1, 2, 3, 12)]
    assert [tuple(r) for r in aggregates.project_rollup(s.limit(0)).collect()] == [(0, 0, 0, 0, 0, 0)]


def test_claims_of_one_line_number_go_by_size(spark):
    inventory = spark.createDataFrame([("a", 5)], "key string, size long")
    for sizes, want in (((9, 5), [(5, "ok"), (9, "duplicate")]), ((5, 9), [(5, "ok"), (9, "duplicate")]), ((7, None), [(None, "size"), (7, "duplicate")])):
        claims = spark.createDataFrame([(1, 1, "a", n) for n in sizes], "o int, line int, key string, size long").coalesce(1)
        got = joins.claims_against_inventory(claims, inventory, ["o", "key"], ["line"], "key", "size")
        assert sorted(((r.size, r.state) for r in got.collect()), key=str) == sorted(want, key=str)
