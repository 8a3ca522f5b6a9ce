from tessera.plans import recovered
from tessera.sources import logs, readers, scratch

HASH = "0f" * 32
POLICY = "USB_HANDOFF_POLICY | retries=1"
RANGE = "UNREAD_RANGE | first=5 | end_exclusive=9 | reason=usb_fast_handoff"
SIZE, PARTIAL = "GEOMETRY | total_sectors=9", "END | status=PARTIAL"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def fold(spark, *files):
    lines = [(i, n, x) for i, text in enumerate(files) for n, x in enumerate(text)]
    got = logs.fold_log(logs.log_records(spark.createDataFrame(lines, "file int, line int, text string"), "file", "line", "text"))
    return [sorted(df.collect(), key=str) for df in got]


def test_log_record_in_both_spellings(spark):
    piped = [
        "[2026-09-21 21:48:30.155] BEGIN | disk=001 | attempt=002 | source=\\\\.\\A:", "[x] GEOMETRY | cylinders=80 | heads=2 | total_sectors=2880 | total_bytes=1474560",
        "[x] SECTOR_READ_FAILED | LBA=16 | attempt=1/3", "[x] BAD_SECTOR | LBA=16 | zero_filled=true", f"[x] END | status=PARTIAL | retry_recovered=0 | bytes=1474560 | sha256={HASH.upper()}",
    ]
    spaced = [
        "2026-09-19 11:44:22.843  BEGIN floppy=007", "2026-09-19 11:45:04.150  READ_RETRY sector=316 attempt=1", "2026-09-19 11:45:05.150  BAD_SECTOR sector=316 win32=1785",
        "BAD_SECTOR: 12 unreadable", "RECOVERED x", "RECOVERED y", f"2026-09-19 11:45:27.262  SHA256 {HASH}", "END status=complete bytes=1 bytes=2", None, "",
    ]
    open_ = ["BEGIN | disk=7 | disk=x", "BAD_SECTOR | LBA=99", "END status=OK", "END"]
    (a, b, c), positions, refused = fold(spark, piped, spaced, open_)
    assert (a.status, a.disk, a.attempt, a.source, a.cylinders, a.heads, a.total_sectors, a.total_bytes, a.retry_failures, a.retry_recovered, a.bytes_written, a.sha256) == ("PARTIAL", 1, 2, "\\\\.\\A:", 80, 2, 2880, 1474560, 1, 0, 1474560, HASH)
    assert (b.status, b.disk, b.retry_failures, b.retry_recovered, b.bytes_written, b.sha256, b.bad_positions) == ("OK", 7, 1, 2, 2, HASH, 2)
    assert (c.status, c.disk, c.end_seen, c.begin_seen) == ("UNKNOWN", None, True, True)  # the last END has no status; the last value of a key counts
    assert [(r.file, r.pos, r.state) for r in positions] == [(0, 16, "bad"), (1, 12, "bad"), (1, 316, "bad"), (2, 99, "bad")] and not refused


def test_log_unread_range_counts_as_bad(spark):
    (a, b), positions, refused = fold(spark, [POLICY, RANGE, SIZE, "BAD_SECTOR lba=2", PARTIAL], ["BEGIN disk=1", "BAD_SECTOR | lba=3"])
    assert (a.bad_positions, a.unread_positions, a.policy_retries) == (5, 4, 1) and b.status == "IN PROGRESS"
    assert [(r.pos, r.state) for r in positions if not r.file] == [(2, "bad"), (5, "unread"), (6, "unread"), (7, "unread"), (8, "unread")] and not refused


def test_log_refusals(spark):
    bad = [
        (["hello"], None, "unrecognized"), ([POLICY, POLICY, RANGE], 1, "duplicate_policy"), (["USB_HANDOFF_POLICY | retries=3"], 0, "policy_budget"), (["USB_HANDOFF_POLICY", "UNREAD_RANGE"], 0, "policy_budget"),
        ([POLICY, "UNREAD_RANGE | end_exclusive=9"], 1, "range_start"), ([POLICY, "UNREAD_RANGE | first=5"], 1, "range_end"), ([RANGE.replace("5", "9"), POLICY, POLICY], 0, "range_invalid"),
        ([RANGE.replace("=9", "=8193")], 0, "range_invalid"), ([RANGE.replace("usb", "x")], 0, "range_invalid"), ([POLICY, RANGE, RANGE, SIZE, PARTIAL], 2, "range_invalid"),
        ([RANGE, SIZE, PARTIAL], None, "unsupported_range"), ([POLICY, RANGE, SIZE], None, "unsupported_range"), ([POLICY, RANGE, SIZE, "END status=OK"], None, "unsupported_range"),
        ([POLICY, RANGE, PARTIAL], None, "unsupported_range"), ([POLICY, RANGE, SIZE, "BAD_SECTOR lba=8", PARTIAL], None, "unsupported_range"), ([POLICY, RANGE, SIZE.replace("9", "10"), PARTIAL], None, "unsupported_range"),
    ]
    kept, positions, refused = fold(spark, *[x for x, _, _ in bad])
    assert not kept and not positions
    assert sorted((r.file, r.line, r.reason) for r in refused) == [(i, line, reason) for i, (_, line, reason) in enumerate(bad)]
    assert fold(spark, []) == [[], [], []]


def test_map_log_status_passes_and_bounds(spark, tmp_path):
    files = {
        "open": "\ufeffSTART a\nC 1 > > 0 : 4\nE 2 > > 2 : 1\nSTOP a\nstart b\nlogsec=512\nlogsec=x\nC 3 < < 2 : 1\n", "ok": "C 1 > > 0 : 3\nnoise\n", "partial": "START a\nE 1 < < 1 : 2\nSTOP a\nSTART b\nSTOP b\n",
        "row": "C 1 > > 5\n", "way": "C 1 > > 0 : 1\nC 1 > < 0 : 1\n", "zero": "C 1 > > 0 : 0\n", "far": "C 1 > > 1048576 : 1\n", "huge": "C 1 > > 0 : 18446744073709551615\n", "many": "C 1 > > 0 : 1000000\n" * 3, "none": "START a\n",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.log").write_bytes(text.encode())
    kept, states, refused = logs.read_map_log(spark, str(tmp_path))
    name = lambda r: r.file.rpartition("/")[2].removesuffix(".log")
    got = {name(r): (r.status, r.sector_size, r.passes, r.forward, r.reverse, r.copied, r.bad, r.highest) for r in kept.collect()}
    assert got == {"open": ("IN PROGRESS", 512, 2, 1, 1, 4, 0, 4), "ok": ("OK", None, 1, 1, 0, 3, 0, 3), "partial": ("PARTIAL", None, 2, 0, 1, 0, 2, 3)}
    assert sorted((name(r), r.line, r.reason) for r in refused.collect()) == [("far", 0, "bound"), ("huge", 0, "number"), ("many", None, "bound"), ("none", None, "no_records"), ("row", 0, "row"), ("way", 1, "direction"), ("zero", 0, "number")]
    assert sorted((r.pos, r.state) for r in states.collect() if name(r) == "partial") == [(1, "E"), (2, "E")]
    wide = logs.read_map_log(spark, str(tmp_path / "far.log"), end=None)[0].collect()
    assert [r.highest for r in wide] == [1048577]


def test_map_log_splits_each_line_once(spark, capsys):
    lines = [("a", 0, "C 1 > > 0 : 3"), ("a", 1, "STOP"), ("a", 1, "E 1 > > 2 : 1"), ("a", 1, "C 1 < < 2 : 2"), ("a", None, "E 1 < < 0 : 1"), ("b", 0, None), ("c", 5, "C 1 > > x : 1"), ("c", None, "C 1 > < 1 : 1")]
    out, states, refused = logs.map_log(spark.createDataFrame(lines, "file string, line int, text string").repartition(3), "file", "line", "text")
    for df in (out, states, refused):
        capsys.readouterr()
        df.explain()
        plan = capsys.readouterr().out
        # The plan before any run; a line's words are made in one place, which no other branch repeats.
        assert plan.count("split(") == 1 and plan.count("Generate inline") == 1
    # Of one line the state E counts, and a line without a number is before all.
    assert rows(states) == [("a", 0, "C"), ("a", 1, "C"), ("a", 2, "E"), ("a", 3, "C")]
    assert rows(out) == [("a", "PARTIAL", None, 1, 0, 1, 3, 1, 4, 0, 0)]
    assert rows(refused) == [("b", None, "no_records"), ("c", None, "direction")]


def test_listings_in_any_encoding_and_unsafe_paths(spark, tmp_path):
    head, line = "a b size c d state path\n", "a b {} c d . {}\n"
    good = head + line.format(5, "Dir\\Mÿ file.doc") + line.format("x", "heading") + line.format(7, "")
    files = {
        "utf8": good.encode(), "marked": good.encode("utf-16"), "bare": good.encode("utf-16-le"), "odd": good.encode("utf-16-le") + b"a", "latin": good.encode("latin-1"), "lone": b"\xff\xfe" + good.encode("utf-16-le") + b"\x00\xd8",
        "climb": (good + line.format(1, "a/../b")).encode(), "drive": (good + line.format(1, "c:\\x")).encode(), "rooted": (good + line.format(1, "/x")).encode(), "control": (good + line.format(1, "a\x01b")).encode(), "empty": b"",
    }
    for name, data in files.items():
        (tmp_path / f"{name}.txt").write_bytes(data)
    states, refused = readers.read_listing(spark, str(tmp_path))
    name = lambda r: r.file.rpartition("/")[2].removesuffix(".txt")
    assert sorted((name(r), r.path, r.bytes, r.state) for r in states.collect()) == [(n, "dir/mÿ file.doc", 5, "live") for n in ("bare", "marked", "utf8")]
    assert sorted((name(r), r.reason) for r in refused.collect()) == [("climb", "unsafe_path"), ("control", "unsafe_path"), ("drive", "unsafe_path"), ("latin", "encoding"), ("lone", "encoding"), ("odd", "encoding"), ("rooted", "unsafe_path")]


def test_log_queries_match_lines_once_and_consensus_is_dealt_by_rows(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(scratch.tasks_for, "__defaults__", (50,))
    spark.range(60).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 3 AS user_id", "'click' AS event_type").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(1000).selectExpr("id % 3 AS l_suppkey", "id AS l_partkey", "'A' AS l_returnflag", "0.0D AS l_discount", "'F' AS l_linestatus").write.parquet(str(tmp_path / "lineitem.parquet"))

    def plan(name):
        df = recovered.QUERIES[name](spark, str(tmp_path))
        capsys.readouterr()
        df.explain()
        return df, capsys.readouterr().out

    for name in ("src2_log_records", "src2_log_positions"):
        df, text = plan(name)
        assert "/kept" in text and "events.parquet" not in text
        assert df.count() == {"src2_log_records": 1, "src2_log_positions": 15}[name]
    for name in ("w17_consensus", "w17_refused_items"):
        assert ", 20), REPARTITION_BY_NUM" in plan(name)[1]
