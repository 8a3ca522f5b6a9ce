"""Structured Streaming forms of the event operators.

The watermark is on the event time, ten minutes by default; later rows are dropped by the stateful operators. ``quarantine_late`` keeps them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..sources.scratch import Records

DELAY = "10 minutes"
SESSION_OUT = "session string, events long, finished boolean, faults long"
_STATE = "next_seq long, finished boolean, faults long"


def tail_events(stream: DataFrame, session: str, seq: str, ts: str, delay: str = DELAY) -> DataFrame:
    """Each (session, seq) once within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([session, seq])


def pair_stream(starts: DataFrame, results: DataFrame, keys: list[str], start_ts: str, result_ts: str, within: str, delay: str = DELAY) -> DataFrame:
    """Starts with their results; a start whose result does not come within ``within`` is emitted with nulls."""
    left = starts.withWatermark(start_ts, delay).select(*keys, F.col(start_ts).alias("started"))
    right = results.withWatermark(result_ts, delay).select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col(result_ts).alias("finished"))
    on = " AND ".join(f"{k} = r_{k}" for k in keys) + f" AND finished >= started AND finished <= started + INTERVAL {within}"
    return left.join(right, F.expr(on), "left_outer").select(*keys, "started", "finished")


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    next_seq, finished, faults = state.get if state.exists else (0, False, 0)
    rows = pd.concat(list(batches)).sort_values("seq")
    for seq, kind in zip(rows.seq, rows.kind, strict=True):
        faults += int(seq != next_seq) + int(finished)
        next_seq, finished = int(seq) + 1, finished or kind == "session_finished"
    state.update((next_seq, bool(finished), int(faults)))
    yield pd.DataFrame({"session": [key[0]], "events": [next_seq], "finished": [bool(finished)], "faults": [int(faults)]})


def session_states(stream: DataFrame) -> DataFrame:
    """Running state of each session (session, seq, kind): events, finished, faults in the order of seq. Update mode."""
    return stream.groupBy("session").applyInPandasWithState(_advance, SESSION_OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def live_pace(stream: DataFrame, ts: str, item: str, window: str = "1 hour", delay: str = DELAY) -> DataFrame:
    """start, item: each item once per window, as far as the watermark reaches. ``pace_of`` counts them exactly."""
    w = stream.withWatermark(ts, delay).select(F.window(ts, window).alias("w"), F.col(item).alias("item"))
    return w.dropDuplicates(["w", "item"]).select(F.col("w.start").alias("start"), "item")


def pace_of(saved: DataFrame, state: DataFrame) -> DataFrame:
    """Pace and estimate of each session, from items (session, item, unix_ms, fresh) and its state (session, started_ms, now_ms, remaining, paused).

    Items per hour of the distinct items (null without one); minutes for what remains, from fresh items: null, with a reason, below three of
    them, while paused, or without a known endpoint.
    """
    g = saved.groupBy("session").agg(F.countDistinct("item").alias("saved"), F.countDistinct(F.when(F.col("fresh"), F.col("item"))).alias("fresh_saved"))
    s = state.join(g, "session", "left").fillna(0, ["saved", "fresh_saved"])
    ms, left = F.col("now_ms") - F.col("started_ms"), F.col("remaining")
    paused = F.coalesce("paused", F.lit(False))
    reason = F.when(left.isNull(), "no_endpoint").when(left == 0, "complete").when(paused, "paused").when((F.col("fresh_saved") < 3) | (ms <= 0), "fewer_than_three")
    return s.select("session", "saved", F.when((ms > 0) & (F.col("saved") > 0), F.col("saved") * 3.6e6 / ms).alias("per_hour"), F.when(reason.isNull(), left * ms / F.col("fresh_saved") / 60000.0).alias("eta_minutes"), reason.alias("reason"))


def _pointers(spark: SparkSession, path: str) -> tuple[Records, list[tuple[int, dict[str, int]]]]:
    """(records, versions with the version that each slot lives in, oldest first). A pointer that a crash cut short is none."""
    records, out = Records(spark, f"{path}/live"), []
    for name in records.names():
        try:
            out.append((int(name), json.loads(records.read(name))))
        except ValueError:
            continue
    return records, out


def _slot(keys: list[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def merge_latest(path: str, keys: list[str], order: str, slots: int = 64, keep: int = 2):
    """For ``foreachBatch``: keeps the latest row per key in a Parquet table below ``path``, in ``slots`` folders by a hash of the key.

    A batch reads the live folders of those slots alone that its keys fall into, writes them anew as the next version, and then a pointer that
    names the live version of every slot; readers go by the newest pointer. Folders that none of the last ``keep`` pointers names are removed.
    A batch may be repeated, by the same query or one that starts again at epoch 0: the row with the largest ``order`` stays the same.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("slot", _slot(keys, slots)).persist()
        try:
            touched = [str(r.slot) for r in rows.select("slot").distinct().collect()]  # ``slots`` numbers at most
            if not touched:
                return
            records, known = _pointers(spark, path)
            live = known[-1][1] if known else {}
            version = max([int(n) for n in records.names() if n.isdigit()], default=-1) + 1
            old = [f"{path}/rows/version={live[s]}/slot={s}" for s in touched if s in live]
            both = rows.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("slot", _slot(keys, slots))) if old else rows
            rest = [c for c in batch.columns if c not in keys]
            latest = both.groupBy("slot", *keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select("slot", *keys, "r.*")
            latest.write.mode("overwrite").partitionBy("slot").parquet(f"{path}/rows/version={version}")
            now = live | dict.fromkeys(touched, version)
            if not records.create(f"{version:012d}", json.dumps(now)):
                raise RuntimeError("two streams write one table of states")
            _prune(spark, path, records, [*known, (version, now)], keep)
        finally:
            rows.unpersist()

    return merge


def _prune(spark: SparkSession, path: str, records: Records, known: list[tuple[int, dict[str, int]]], keep: int) -> None:
    """Remove old pointers, and folders of rows that the last ``keep`` ones do not name."""
    used = {(v, s) for _, live in known[-keep:] for s, v in live.items()}
    oldest = known[-keep:][0][0]
    for name in records.names():
        if name.isdigit() and int(name) < oldest:
            records.delete(name)
    rows = Records(spark, f"{path}/rows")
    for name in rows.names():
        version = int(name.partition("=")[2])
        if version > known[-1][0]:
            continue
        slots = Records(spark, f"{path}/rows/{name}")
        dead = [s for s in slots.names() if (version, s.partition("=")[2]) not in used]
        if len(dead) == len(slots.names()):
            rows.delete(name)
        else:
            for s in dead:
                slots.delete(s)


def latest_state(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The rows of the live version of each slot; None if nothing was written."""
    known = _pointers(spark, path)[1]
    if not known:
        return None
    return spark.read.schema(schema).parquet(*[f"{path}/rows/version={v}/slot={s}" for s, v in known[-1][1].items()])


def quarantine_late(path: str, ts: str, on_time: Callable[[DataFrame, int], None], delay: str = DELAY):
    """For ``foreachBatch``: rows behind the watermark go to a table below ``path``, all others to ``on_time``.

    The watermark of a batch is the latest event time of the batches before it less ``delay``; it is written down, so that a restarted query goes on
    with it, and a repeated batch is split as before. Rows without an event time go to quarantine too. Every row of a batch is in one of the two.
    """

    def split(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        records = Records(spark, f"{path}/watermarks")
        names = [n for n in records.names() if n.isdigit()]
        before = [n for n in names if int(n) < epoch]
        seen = json.loads(records.read(before[-1])) if before else None
        late = F.col(ts).isNull()
        if seen is not None:
            late = late | (F.col(ts) < F.timestamp_micros(F.lit(seen)) - F.expr(f"INTERVAL {delay}"))
        rows = batch.withColumn("reason", F.when(F.col(ts).isNull(), "no_time").when(late, "late")).persist()
        try:
            rows.where("reason IS NOT NULL").write.mode("overwrite").parquet(f"{path}/late/epoch={epoch}")
            on_time(rows.where("reason IS NULL").drop("reason"), epoch)
            last = rows.agg(F.max(F.unix_micros(F.col(ts).cast("timestamp")))).first()[0]
        finally:
            rows.unpersist()
        mark = max(x for x in (last, seen) if x is not None) if last is not None or seen is not None else None
        if mark is not None:
            records.create(f"{epoch:012d}", json.dumps(mark))
        for n in before[:-1]:  # the last two are enough to repeat a batch
            records.delete(n)

    return split


def pending(state: DataFrame, status: str) -> DataFrame:
    """Work that is not done: queued, processing or failed."""
    return state.where(F.col(status).isin("queued", "processing", "failed"))


def reconcile(state: DataFrame, authoritative: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in which a streamed state and the batch result differ; none after a correct run."""
    a = state.withColumn("__side", F.lit("stream"))
    b = authoritative.select(*state.columns).withColumn("__side", F.lit("batch"))
    return a.unionByName(b).groupBy(*state.columns).agg(F.collect_set("__side").alias("sides")).where("size(sides) = 1").select(*keys, F.element_at("sides", 1).alias("only_in"))
