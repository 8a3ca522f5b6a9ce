"""Sessions of two readers as a state machine over a stream: counters, violations as rows, expiry.

Needs the RocksDB provider of state stores. Each counter is a state variable; open tickets, used tickets and events that wait for an
earlier one are maps, so that an event reads and writes a few values, however long the session is.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .events import DELAY

#: fixed values: kinds of events
START, FINISH, FED = "session_started", "dual_session_finished", "dual_feeding_finished"
READ, SAVED, FAILED = "dual_read_started", "dual_receipt_saved", "dual_read_failed"
PAUSE, RESUME, REMOVED = "dual_pause", "dual_resume", "dual_removal_confirmed"

#: counters and their first values; -1 is none
COUNTERS = {"next_seq": 0, "elapsed": 0, "paused_at": -1, "paused_ms": 0, "fed_at": -1, "finished": 0, "reads": 0, "saved": 0, "failed": 0, "removals": 0, "open": 0, "faults": 0, "deadline": -1}
SHOWN = ("next_seq", "elapsed", "paused_ms", "reads", "saved", "failed", "removals", "open", "faults")
EVENT = "kind string, elapsed long, ticket long, lane string, item long"
OUT = StructType([StructField("session", StringType()), StructField("seq", LongType()), StructField("rule", StringType()), *(StructField(c, LongType()) for c in SHOWN), StructField("finished", BooleanType()), StructField("closed", BooleanType())])
LANES = ("USB", "GW")


class Machine:
    """The rules, over any store of counters (a dict) and of two maps with ``get``, ``put``, ``remove``."""

    def __init__(self, counts: dict[str, int], tickets: Any, used: Any):
        self.n, self.tickets, self.used = counts, tickets, used

    def step(self, seq: int, e: tuple) -> list[str]:
        """Take the next event; returns the rules that it breaks. A broken rule is counted and the session goes on."""
        kind, elapsed, ticket, lane, item = e
        n, out = self.n, []
        first = n["next_seq"] == 0
        n["next_seq"] = seq + 1
        if n["finished"]:
            out.append("after_finish")
        if first and kind != START:
            out.append("bad_start")
        if not first and kind == START:
            out.append("extra_start")
        if elapsed is None or elapsed < n["elapsed"]:
            out.append("backward")
        now = n["elapsed"] = max(n["elapsed"], elapsed or 0)
        if kind == READ:
            out += self._read(now, ticket, lane, item)
        elif kind in (SAVED, FAILED):
            out += self._result(kind, ticket, lane, item)
        elif kind == REMOVED:
            n["removals"] += 1
        elif kind == PAUSE:
            n["paused_at"] = now if n["paused_at"] < 0 else n["paused_at"]
        elif kind == RESUME:
            if n["paused_at"] >= 0:
                n["paused_ms"], n["paused_at"] = n["paused_ms"] + now - n["paused_at"], -1
        elif kind == FED:
            if n["fed_at"] >= 0:
                out.append("feed_twice")
            else:
                n["fed_at"] = now
        elif kind == FINISH:
            if n["fed_at"] < 0 or n["open"]:
                out.append("incomplete")
            n["finished"] = 1
        elif kind != START:
            out.append("unknown_kind")
        n["faults"] += len(out)
        return out

    def _read(self, now: int, ticket: int | None, lane: str | None, item: int | None) -> list[str]:
        """One ticket a read, one open read a lane, none once feeding is over."""
        if not ticket or not item or lane not in LANES:
            return ["bad_ticket"]
        out = []
        if self.n["fed_at"] >= 0:
            out.append("after_feed")
        if self.used.get(ticket) is not None:
            return [*out, "ticket_reused"]
        if self.used.get(-1 - LANES.index(lane)) is not None:
            out.append("lane_busy")
        self.used.put(ticket, (now,))
        self.used.put(-1 - LANES.index(lane), (ticket,))
        self.tickets.put(ticket, (lane, item))
        self.n["reads"] += 1
        self.n["open"] += 1
        return out

    def _result(self, kind: str, ticket: int | None, lane: str | None, item: int | None) -> list[str]:
        held = self.tickets.get(ticket) if ticket else None
        if held is None:
            return ["no_start"]
        self.tickets.remove(ticket)
        lock = -1 - LANES.index(held[0])
        if (self.used.get(lock) or (None,))[0] == ticket:
            self.used.remove(lock)
        self.n["open"] -= 1
        self.n["saved" if kind == SAVED else "failed"] += 1
        return [] if tuple(held) == (lane, item) else ["mismatch"]

    def close(self) -> None:
        """An open pause ends with the last event."""
        if self.n["paused_at"] >= 0:
            self.n["paused_ms"], self.n["paused_at"] = self.n["paused_ms"] + self.n["elapsed"] - self.n["paused_at"], -1


class _Map:
    def __init__(self, state: Any):
        self.state = state

    def get(self, key: int) -> tuple | None:
        return tuple(self.state.getValue((key,))) if self.state.containsKey((key,)) else None

    def put(self, key: int, value: tuple) -> None:
        self.state.updateValue((key,), value)

    def remove(self, key: int) -> None:
        self.state.removeKey((key,))

    def clear(self) -> None:
        self.state.clear()


class SessionProcessor(StatefulProcessor):
    """Takes events in the order of seq, whatever order they come in; what waits for a missing one is taken when the session expires."""

    def __init__(self, patience_ms: int):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = {c: handle.getValueState(c, "n long") for c in COUNTERS}
        self.tickets = _Map(handle.getMapState("tickets", "ticket long", "lane string, item long"))
        self.used = _Map(handle.getMapState("used", "ticket long", "at long"))
        self.waiting = handle.getMapState("waiting", "seq long", EVENT)

    def _load(self) -> Machine:
        read = lambda c, v: v.get()[0] if v.exists() else COUNTERS[c]
        return Machine({c: read(c, v) for c, v in self.counts.items()}, self.tickets, self.used)

    def _save(self, m: Machine, before: dict[str, int]) -> None:
        for c, v in m.n.items():
            if v != before[c]:
                self.counts[c].update((v,))

    def _drain(self, session: str, m: Machine, over_gaps: bool) -> Iterator[Row]:
        seqs = sorted(k[0] for k in self.waiting.keys())
        for seq in seqs:
            if seq > m.n["next_seq"]:
                if not over_gaps:
                    return
                m.n["faults"] += 1
                yield self._row(session, m.n["next_seq"], "gap")
            if seq >= m.n["next_seq"]:
                for rule in m.step(seq, tuple(self.waiting.getValue((seq,)))):
                    yield self._row(session, seq, rule)
            self.waiting.removeKey((seq,))

    @staticmethod
    def _row(session: str, seq: int | None, rule: str | None, m: Machine | None = None, closed: bool = False) -> Row:
        shown = [m.n[c] for c in SHOWN] if m else [None] * len(SHOWN)
        return Row(**dict(zip(OUT.names, [session, seq, rule, *shown, bool(m.n["finished"]) if m else None, closed if m else None], strict=True)))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        m = self._load()
        before, latest = dict(m.n), 0
        for r in rows:
            latest = max(latest, int(r.ts.timestamp() * 1000))
            if r.seq >= m.n["next_seq"] and not self.waiting.containsKey((r.seq,)):  # each (session, seq) once
                self.waiting.updateValue((r.seq,), (r.kind, r.elapsed, r.ticket, r.lane, r.item))
        yield from self._drain(key[0], m, False)
        if latest + self.patience > m.n["deadline"]:
            m.n["deadline"] = latest + self.patience
            self.handle.registerTimer(m.n["deadline"])
        self._save(m, before)
        yield self._row(key[0], None, None, m)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        m = self._load()
        if expiredTimerInfo.getExpiryTimeInMs() < m.n["deadline"]:
            return
        yield from self._drain(key[0], m, True)
        m.close()
        yield self._row(key[0], None, None, m, True)
        for v in self.counts.values():
            v.clear()
        for s in (self.tickets, self.used, self.waiting):
            s.clear()

    def close(self) -> None:
        pass


def session_machine(stream: DataFrame, ts: str = "ts", delay: str = DELAY, patience_ms: int = 600_000) -> DataFrame:
    """``OUT`` rows of events (session, seq, kind, elapsed, ticket, lane, item, ``ts``): a row for each rule that an event breaks (seq and rule), and
    the session's counters after every batch, with closed in the last of them.

    A session closes ``patience_ms`` after its last event, by the watermark; then it leaves the state. Update mode.
    """
    events = stream.withWatermark(ts, delay).select("session", "seq", "kind", "elapsed", "ticket", "lane", "item", stream[ts].alias("ts"))
    return events.groupBy("session").transformWithState(SessionProcessor(patience_ms), OUT, "update", "eventTime")
