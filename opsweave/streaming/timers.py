"""Keyed streaming jobs with event-time timers.

Rows wait in the state until the watermark has passed them and are then handled in event order, so
the result does not depend on the order of arrival: rows up to ``delay`` late count as if they had
come in time, later ones are dropped by the watermark. A key's state carries the moment at which
nothing can depend on it any more; a timer removes it then (or reports that the moment has come).
The waiting rows of a key are filed by millisecond, a timer reads those of its own instant only, so
the state holds ``delay``'s worth of rows and one small row per live key.

The session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from opsweave.operators.correlate import COOLDOWNS, SEVERITIES
from opsweave.operators.policy_state import (
    APPROVAL_SECONDS,
    COOLOFF_BLOCKS,
    COOLOFF_SECONDS,
    PENDING_SECONDS,
    Machine,
    step,
)
from opsweave.streaming.jobs import timestamp_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _floor_ms(t: float) -> int:
    return round(t * 1_000_000) // 1000


class InOrder(StatefulProcessor):
    """``fold(state, rows) -> (state, outputs)`` over the rows of one instant, in event order.

    ``due(state)`` gives the second at which ``fire(state) -> (state, outputs)`` is called, None = never.
    A state of None is removed. States and outputs are tuples. A row at the due moment comes first.
    """

    def __init__(self, columns: Sequence[str], row: str, state: str, fold: Callable, due: Callable, fire: Callable, out: Sequence[str]):
        self.columns, self.row, self.state = list(columns), row, state
        self.fold, self.due, self.fire, self.out = fold, due, fire, list(out)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms bigint", f"rows array<struct<{self.row}>>")
        self.held = handle.getValueState("held", f"due_ms bigint, {self.state}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        arrived: dict[int, list[tuple]] = {}
        for r in rows:
            arrived.setdefault(_floor_ms(r["t"]), []).append(tuple(r[c] for c in self.columns))
        for ms, new in arrived.items():
            if self.waiting.containsKey((ms,)):
                new = [tuple(x) for x in self.waiting.getValue((ms,))[0]] + new
            else:
                self.handle.registerTimer(ms)
            self.waiting.updateValue((ms,), (new,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        found = self.held.get() if self.held.exists() else None
        due_ms, state = (found[0], tuple(found[1:])) if found is not None else (None, None)
        before, made = due_ms, []

        def overdue(at: int) -> None:
            nonlocal due_ms, state
            while state is not None and due_ms is not None and due_ms < at:
                state, produced = self.fire(state)
                made.extend(produced)
                due_ms = self._due_ms(state)

        overdue(now)
        if self.waiting.containsKey((now,)):
            rows = [Row(**dict(zip(self.columns, x, strict=True))) for x in self.waiting.getValue((now,))[0]]
            self.waiting.removeKey((now,))
            state, produced = self.fold(state, sorted(rows, key=lambda r: (r["t"], r["_o"], r["event_id"])))
            made.extend(produced)
            due_ms = self._due_ms(state)
        overdue(now + 1)
        self._keep(state, due_ms, before, now, found is not None)
        for x in made:
            yield Row(**dict(zip(self.out, (*key, *x), strict=True)))

    def _due_ms(self, state) -> int | None:
        at = None if state is None else self.due(state)
        return None if at is None else math.ceil(round(at * 1_000_000) / 1000)

    def _keep(self, state, due_ms, before, now: int, held: bool) -> None:
        if before is not None and before != due_ms and before > now and not self.waiting.containsKey((before,)):
            self.handle.deleteTimer(before)
        if state is None:
            if held:
                self.held.clear()
            return
        self.held.update((due_ms, *state))
        if due_ms is not None and due_ms != before and not self.waiting.containsKey((due_ms,)):
            self.handle.registerTimer(due_ms)

    def close(self) -> None:
        pass


def _run(df: DataFrame, key: str, order, columns: dict[str, str], state: str, fold, due, fire, out: str, delay: str) -> DataFrame:
    """Run the callables over ``df(key, t, event_id, ...)``; ``order`` breaks ties before the event id."""
    kind = df.schema[key].dataType.simpleString()
    kept = {"t": "double", "_o": "int", "event_id": "bigint", **columns}
    rows = df.select(
        F.col(key), F.col("t").cast("double").alias("t"), order.cast("int").alias("_o"), F.col("event_id").cast("long").alias("event_id"),
        *[F.col(c).cast(k).alias(c) for c, k in columns.items()], timestamp_of(F.col("t")).alias("_event_time"),
    ).where("t is not null")
    names = [key, *[c.split()[0] for c in out.split(", ")]]
    job = InOrder(list(kept), ", ".join(f"{c}: {k}" for c, k in kept.items()), state, fold, due, fire, names)
    return (
        rows.withWatermark("_event_time", delay).groupBy(key)
        .transformWithState(job, f"{key} {kind}, {out}", "append", "eventTime")
    )


def _forget(state):
    return None, []


def approvals(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Asks with whether an approval of the same (session, rule) lies in the last eight hours:
    ``log(key, t, event_id, kind)``, kind ``approval`` or ``ask``. State goes eight hours after the approval."""

    def fold(state, rows):
        last, made = state[0] if state else None, []
        for r in rows:
            if r["kind"] == "approval":
                last = r["t"]
            else:
                made.append((r["event_id"], last is not None and last >= r["t"] - APPROVAL_SECONDS))
        return None if last is None else (last,), made

    first = F.when(F.col("kind") == "approval", 0).otherwise(1)
    return _run(
        log, "key", first, {"kind": "string"}, "last double", fold, lambda s: s[0] + APPROVAL_SECONDS, _forget,
        "event_id long, approved boolean", delay,
    )


def pending_approvals(log: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Approvals granted by a tool call less than 60 s after an ask: ``log(session, t, event_id, kind, rule)``.
    A newer ask replaces the pending one, a tool call uses it up, and it goes after 60 s."""

    def fold(state, rows):
        made = []
        for r in rows:
            if r["kind"] == "ask":
                state = (r["t"], r["rule"])
                continue
            if state is not None and math.floor(r["t"] - state[0]) < PENDING_SECONDS:
                made.append((r["event_id"], state[1]))
            state = None
        return state, made

    return _run(
        log, "session", F.lit(0), {"kind": "string", "rule": "string"}, "asked double, rule string", fold,
        lambda s: s[0] + PENDING_SECONDS, _forget, "event_id long, rule string", delay,
    )


def cooloff(blocks: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The action of each block, an ask once the rule blocked three times in the five minutes before:
    ``blocks(rule, t, event_id)``. Holds the last three blocks, which go five minutes after the newest."""

    def fold(state, rows):
        times, made = list(state[0]) if state else [], []
        for r in rows:
            recent = [x for x in times if r["t"] - COOLOFF_SECONDS <= x < r["t"]]
            made.append((r["event_id"], "ask" if len(recent) >= COOLOFF_BLOCKS else "block"))
            same = [x for x in times if x == r["t"]]
            if len(same) < COOLOFF_BLOCKS:  # more rows of one instant change nothing
                times = [*[x for x in times if x < r["t"]][-COOLOFF_BLOCKS:], *same, r["t"]]
        return (times,), made

    return _run(
        blocks, "rule", F.lit(0), {}, "times array<double>", fold, lambda s: s[0][-1] + COOLOFF_SECONDS, _forget,
        "event_id long, action_taken string", delay,
    )


def cooldown_fires(evaluations: DataFrame, cycle_seconds: float, delay: str = "10 minutes") -> DataFrame:
    """Alerts that fire: the first of an episode, then after each cool-down. ``evaluations(alert_id, t, event_id,
    severity)`` come every ``cycle_seconds``; an alert missing from one evaluation has cleared, which a timer sees.
    Of several severities in one evaluation the worst counts."""
    rank = {s: i for i, s in enumerate(SEVERITIES)}

    def fold(state, rows):
        t = rows[0]["t"]
        severity = max((r["severity"] for r in rows), key=lambda s: (rank.get(s, -1), s or ""))
        fresh = state is None or t - state[0] > cycle_seconds
        wait = COOLDOWNS.get(severity)
        fire = fresh or (wait is not None and t - state[1] >= wait)
        return (t, t if fire else state[1]), [(t, severity)] if fire else []

    return _run(
        evaluations, "alert_id", F.lit(0), {"severity": "string"}, "seen double, fired double", fold,
        lambda s: s[0] + cycle_seconds, _forget, "t double, severity string", delay,
    )


def machine_timeouts(events: DataFrame, m: Machine, delay: str = "10 minutes") -> DataFrame:
    """Timeouts of idle instances as they come due: ``events(instance, t, event_id, event, guard_ok)``.

    One row per limit that passes without an event: the state, the timeout's event, its hours and the moment it
    fell due. An instance's state stays, as its next event needs it; an instance in a terminal state has no timer.
    """
    limits: dict[str, list[tuple[float, str]]] = {}
    for name, hours, event in m.timeouts:
        if m.states.get(name) != "terminal":
            limits.setdefault(name, []).append((float(hours), event))

    def fold(state, rows):
        now = state[0] if state else m.initial
        for r in rows:
            ok = r["guard_ok"] is None or bool(r["guard_ok"])
            now = step(m, now, r["event"], ok)[0] or now
        return (now, rows[-1]["t"], 0.0), []

    def next_limit(state):
        return min((x for x in limits.get(state[0], ()) if x[0] > state[2]), default=None)

    def due(state):
        limit = next_limit(state)
        return None if limit is None else state[1] + limit[0] * 3600

    def fire(state):
        hours, event = next_limit(state)
        return (state[0], state[1], hours), [(state[0], event, hours, state[1] + hours * 3600)]

    return _run(
        events, "instance", F.lit(0), {"event": "string", "guard_ok": "boolean"}, "state string, last double, passed double",
        fold, due, fire, "state string, event string, hours double, due_t double", delay,
    )
