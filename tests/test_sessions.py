"""The session machine against the batch rules, on events that come out of order, twice, or not at all."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import joins, windows
from tessera.streaming import sessions as s

COLUMNS = "session string, seq long, kind string, elapsed long, ticket long, lane string, item long"
E = lambda kind, elapsed, ticket=None, lane=None, item=None: (kind, elapsed, ticket, lane, item)


class Store(dict):
    put, remove = dict.__setitem__, dict.__delitem__


def run(events):
    m = s.Machine(dict(s.COUNTERS), Store(), Store())
    faults = [(i, r) for i, e in enumerate(events) for r in m.step(i, e)]
    m.close()
    return faults, m.n


def test_each_rule():
    good = [E(s.START, 0), E(s.READ, 1, 7, "USB", 1), E(s.READ, 2, 8, "GW", 1), E(s.PAUSE, 3), E(s.PAUSE, 4), E(s.RESUME, 6), E(s.SAVED, 7, 7, "USB", 1), E(s.FAILED, 8, 8, "GW", 1), E(s.REMOVED, 9), E(s.FED, 10), E(s.FINISH, 11)]
    faults, n = run(good)
    assert not faults and (n["reads"], n["saved"], n["failed"], n["removals"], n["open"], n["paused_ms"], n["finished"], n["elapsed"]) == (2, 1, 1, 1, 0, 3, 1, 11)
    head = [E(s.START, 0), E(s.READ, 1, 7, "USB", 1)]
    for more, want in (
        ([E(s.READ, 2, 7, "GW", 1)], "ticket_reused"), ([E(s.READ, 2, 9, "USB", 2)], "lane_busy"), ([E(s.READ, 2, 9, "CD", 2)], "bad_ticket"), ([E(s.READ, 2, 0, "GW", 2)], "bad_ticket"), ([E(s.SAVED, 2, 3, "USB", 1)], "no_start"),
        ([E(s.SAVED, 2, 7, "USB", 2)], "mismatch"), ([E(s.SAVED, 2, 7, "GW", 1)], "mismatch"), ([E(s.START, 2)], "extra_start"), ([E(s.REMOVED, 0)], "backward"), ([E(s.FINISH, 2)], "incomplete"), ([E("x", 2)], "unknown_kind"),
        ([E(s.FED, 2), E(s.FED, 3)], "feed_twice"), ([E(s.FED, 2), E(s.READ, 3, 9, "GW", 1)], "after_feed"), ([E(s.FED, 2), E(s.FINISH, 3)], "incomplete"),
    ):
        assert [r for _, r in run(head + more)[0]] == [want]
    assert run(good + [E(s.REMOVED, 12)])[0] == [(11, "after_finish")] and run(good[1:])[0][0] == (0, "bad_start")
    assert run([E(s.START, 0), E(s.PAUSE, 5), E(s.REMOVED, 9)])[1]["paused_ms"] == 4  # an open pause ends with the last event


@pytest.fixture(scope="module")
def log():
    rng, out = random.Random(5), []
    for k in range(6):
        seq, now, open_ = 0, 0, {}
        rows = [E(s.START, 0)] if k != 4 else []
        for t in range(1, 30):
            now += rng.randrange(5)
            kind = rng.choice((s.READ, s.SAVED, s.FAILED, s.PAUSE, s.RESUME, s.REMOVED, s.REMOVED))
            if kind == s.READ:
                open_[t] = (rng.choice(s.LANES), rng.randrange(1, 4))
                rows.append(E(kind, now, t, *open_[t]))
            elif kind in (s.SAVED, s.FAILED):
                ticket = rng.choice([*open_, 99])
                rows.append(E(kind, now, ticket, *open_.pop(ticket, ("GW", 1))))
            else:
                rows.append(E(kind, max(0, now - (rng.random() < 0.1) * 3)))
        rows += [E(s.FED, now), E(s.FINISH, now)] if k % 2 == 0 else []
        rows += [E(s.REMOVED, now + 1)] if k == 2 else []
        for e in rows:
            out.append((f"s{k}", seq, *e))
            seq += 1
    return out


def test_stream_equals_batch_rules_and_state_is_dropped(spark, tmp_path, log):
    rng = random.Random(8)
    lost = ("s5", 4)
    arriving = [e for e in log if e[:2] != lost] + rng.choices([e for e in log if e[:2] != lost], k=20)  # some twice
    rng.shuffle(arriving)
    arriving += [("late", 0, s.START, 0, None, None, None)]  # by then the watermark is far beyond the others
    path = str(tmp_path / "in")
    for i in range(0, len(arriving), 30):
        part = spark.createDataFrame(arriving[i : i + 30], COLUMNS).withColumn("ts", F.timestamp_seconds(F.when(F.col("session") == "late", 10**6).otherwise(F.col("seq") + 1000)))
        part.coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out, rows = str(tmp_path / "out"), []
    q = s.session_machine(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/epoch={i}")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None and not q.isActive
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.schema(s.OUT).parquet(*[str(p) for p in (tmp_path / "out").glob("epoch=*")]).collect()
    closed = {r.session: r for r in rows if r.closed}
    assert sorted(closed) == [f"s{k}" for k in range(6)]  # each once: its state is gone
    assert sum(bool(r.closed) for r in rows) == 6
    found = Counter((r.session, r.rule) for r in rows if r.rule)

    df = spark.createDataFrame([e for e in log if e[0] != "s5"], COLUMNS)
    order = windows.sequence_faults(df, "session", "seq", "elapsed", "kind", s.START, s.FINISH).collect()
    for r in order:  # W10
        assert (found[r.session, "bad_start"], found[r.session, "extra_start"], found[r.session, "after_finish"]) == (r.bad_start, r.extra_starts, r.after_finish)
        assert closed[r.session].next_seq == r.events and not found[r.session, "gap"]
    running = df.withColumn("t", F.timestamp_millis(F.max("elapsed").over(windows.Window.partitionBy("session").orderBy("seq"))))
    edges = running.withColumn("k", F.concat(F.lpad(F.col("seq").cast("string"), 4, "0"), F.lit("")))
    for r in windows.pause_time(edges.where(F.col("kind").isNotNull()), "session", "t", "kind", s.PAUSE, s.RESUME).collect():  # W8, where no two edges share a time
        times = [e for e in log if e[0] == r.session and e[2] in (s.PAUSE, s.RESUME)]
        if len({e[3] for e in times}) == len(times):
            assert closed[r.session].paused_ms * 1000 == r.paused_us
    starts, results = df.where(F.col("kind") == s.READ), df.where(F.col("kind").isin(s.SAVED, s.FAILED))
    pairs = Counter((r.session, r.state) for r in joins.pair_events(starts, results, ["session", "ticket"], "seq", "seq").collect())
    for k in range(5):  # J13
        i = f"s{k}"
        assert (closed[i].saved + closed[i].failed, closed[i].open) == (pairs[i, "paired"], pairs[i, "open"])
    want, n = Counter(), {}
    for k in range(5):
        faults, n[k] = run([e[2:] for e in log if e[0] == f"s{k}"])
        want.update((f"s{k}", r) for _, r in faults)
    assert {x: c for x, c in found.items() if x[0] != "s5"} == dict(want)
    assert found["s5", "gap"] == 1 and closed["s5"].faults >= 1
