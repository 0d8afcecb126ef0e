"""Structured Streaming forms of the stateful operators.

Every function takes a streaming frame (it also runs on a static one where Spark
allows) and returns a frame to write. Event time is mandatory and carries a
watermark; stateful jobs keep one small state per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opsweave.functions.text import severity_name, severity_rank
from opsweave.operators.correlate import COOLDOWNS, STORM_RESTARTS, STORM_SECONDS
from opsweave.operators.logs import classify_pod_lines
from opsweave.operators.policy import guard_check
from opsweave.operators.policy_state import APPROVAL_SECONDS, COOLOFF_BLOCKS, COOLOFF_SECONDS, Machine, step
from opsweave.operators.rules import Rule


def guarded(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Verdicts of a live action stream: one projection, no state."""
    return guard_check(events, rules)


def live_buckets(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Log buckets per pod and template over ``lines(namespace, pod, event_time, line)``.

    Update mode: a bucket is sent again whenever it grows. Examples: the first line.
    """
    kept = classify_pod_lines(lines.withWatermark("event_time", delay))
    return kept.groupBy("namespace", "pod", "template_hash").agg(
        F.count("*").alias("count"),
        F.min("event_time").alias("first_seen"),
        F.max("event_time").alias("last_seen"),
        severity_name(F.max(severity_rank(F.col("severity")))).alias("severity"),
        F.min_by("template_text", "event_time").alias("template_text"),
        F.min_by("line", F.struct("event_time", "line")).alias("example"),
    )


def per_minute_failures(lines: DataFrame, failing: Column, delay: str = "2 minutes") -> DataFrame:
    """Tumbling one-minute counts of failing lines per service."""
    return (
        lines.withWatermark("event_time", delay).where(failing)
        .groupBy(F.window("event_time", "1 minute"), "unit").agg(F.count("*").alias("errors"))
        .select(F.col("window.start").alias("minute"), "unit", "errors")
    )


def error_rate(lines: DataFrame, failing: Column, delay: str = "2 minutes") -> DataFrame:
    """Ten-minute windows sliding by one minute with more than ten failing lines."""
    return (
        lines.withWatermark("event_time", delay).where(failing)
        .groupBy(F.window("event_time", "10 minutes", "1 minute"), "unit").agg(F.count("*").alias("errors"))
        .where("errors > 10")
        .select(
            F.col("window.end").alias("window_end"), "unit", "errors",
            F.when(F.col("errors") > 30, "critical").otherwise("warning").alias("severity"),
        )
    )


def once_per_event(events: DataFrame, key: str = "event_id", delay: str = "10 minutes") -> DataFrame:
    """Drop repeated deliveries that arrive within the watermark."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])


def caused_by(logs: DataFrame, changes: DataFrame) -> DataFrame:
    """Stream-stream form of the change correlation: change in [t - 120 s, t + 10 s].

    A change without a namespace concerns all of them: such changes are joined by ten-second steps of
    time instead, each log event looking at the steps its interval touches.
    """
    left = logs.withWatermark("event_time", "10 seconds")
    right = changes.where("label <> ''").withWatermark("change_time", "120 seconds")
    near = (
        (F.col("_ns") == F.col("_change_ns"))
        & (F.col("change_time") >= F.col("event_time") - F.expr("interval 120 seconds"))
        & (F.col("change_time") <= F.col("event_time") + F.expr("interval 10 seconds"))
    )
    step = F.floor(F.unix_seconds("change_time") / 10)
    everywhere = F.col("change_namespace") == ""
    right = right.withColumn("_change_ns", F.when(everywhere, F.concat(F.lit("@"), step)).otherwise(F.concat(F.lit("="), "change_namespace")))
    t = F.unix_seconds("event_time")
    steps = F.transform(
        F.sequence(F.floor((t - 121) / 10), F.floor((t + 11) / 10)), lambda s: F.concat(F.lit("@"), s.cast("string"))
    )
    left = left.withColumn("_ns", F.explode(F.concat(F.array(F.concat(F.lit("="), "namespace")), steps)))
    pairs = left.join(right, near, "inner").drop("_ns", "_change_ns")
    return pairs.withColumn("confidence", F.lit("candidate"))


def _stateful(df: DataFrame, key: str, order: list[str], fold, out: str, state: str) -> DataFrame:
    """Run ``fold(state tuple or None, row) -> (state, output rows)`` over each key's rows
    in event-time order."""
    names = [c.split()[0] for c in out.split(", ")]
    kind = df.schema[key].dataType.simpleString()

    def run(keys, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else None
        rows = pd.concat(list(frames)).sort_values(order)
        made = []
        for row in rows.itertuples(index=False):
            now, produced = fold(now, row)
            made += [(keys[0], *p) for p in produced]
        if now is not None:
            held.update(now)
        yield pd.DataFrame(made, columns=[key, *names])

    return df.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, {out}", state, "append", GroupStateTimeout.NoTimeout
    )


def machine_replay(events: DataFrame, m: Machine) -> DataFrame:
    """State machine per instance over ``events(instance, t, event_id, event, guard_ok)``."""

    def fold(now, row):
        state = now[0] if now else m.initial
        to, blocked, error = step(m, state, row.event, bool(row.guard_ok))
        return (to or state,), [(row.event_id, state, row.event, to, to is not None, blocked, error)]

    out = "event_id long, from_state string, event string, to_state string, success boolean, guard_blocked boolean, error string"
    return _stateful(events, "instance", ["t", "event_id"], fold, out, "state string")


def approvals(log: DataFrame) -> DataFrame:
    """Asks with whether an approval of the same (session, rule) lies in the last eight hours.

    ``log(key, t, event_id, kind)``: kind ``approval`` or ``ask``, key = session and rule.
    """

    def fold(now, row):
        last = now[0] if now else -1e18
        if row.kind == "approval":
            return (max(last, float(row.t)),), []
        return (last,), [(row.event_id, bool(last >= row.t - APPROVAL_SECONDS))]

    ordered = log.withColumn("_o", F.when(F.col("kind") == "approval", 0).otherwise(1))
    return _stateful(ordered, "key", ["t", "_o", "event_id"], fold, "event_id long, approved boolean", "last double")


def cooloff(blocks: DataFrame) -> DataFrame:
    """The action of each block: an ask once the rule blocked three times in five minutes.

    The state holds the current instant with its count and the last three earlier
    blocks, however hot the rule is.
    """

    def fold(now, row):
        earlier, at, n = (list(now[0]), now[1], now[2]) if now else ([], -1e18, 0)
        if row.t > at:
            earlier = [*earlier, *[at] * min(n, COOLOFF_BLOCKS)][-COOLOFF_BLOCKS:]
            at, n = float(row.t), 0
        recent = sum(x >= row.t - COOLOFF_SECONDS for x in earlier)
        action = "ask" if recent >= COOLOFF_BLOCKS else "block"
        return (earlier, at, n + 1), [(row.event_id, action)]

    return _stateful(
        blocks, "rule", ["t", "event_id"], fold, "event_id long, action_taken string",
        "earlier array<double>, at double, n long",
    )


def outside_pauses(log: DataFrame) -> DataFrame:
    """Events outside the pauses of their key: ``log(key, t, event_id, kind, expiry)`` with
    kind ``pause`` (expiry null = until further notice) or ``event``."""

    def fold(now, row):
        until = now[0] if now else -1e18
        if row.kind == "pause":
            return (max(until, 1e18 if pd.isna(row.expiry) else float(row.expiry)),), []
        return (until,), [] if row.t <= until else [(row.event_id,)]

    ordered = log.withColumn("_o", F.when(F.col("kind") == "pause", 0).otherwise(1))
    return _stateful(ordered, "key", ["t", "_o", "event_id"], fold, "event_id long", "until double")


def restart_storms(readings: DataFrame) -> DataFrame:
    """Readings more than three restarts above the oldest of the last ten minutes."""

    def fold(now, row):
        times, counts = now if now else ([], [])
        held = [(t, c) for t, c in zip(times, counts, strict=True) if t >= row.t - STORM_SECONDS]
        held.append((float(row.t), int(row.restart_count)))
        delta = held[-1][1] - held[0][1]
        state = ([t for t, _ in held], [c for _, c in held])
        return state, [(row.event_id, delta)] if delta > STORM_RESTARTS else []

    return _stateful(
        readings, "pod", ["t", "event_id"], fold, "event_id long, delta long", "times array<double>, counts array<long>"
    )


def cooldown_fires(evaluations: DataFrame) -> DataFrame:
    """Alert cool-down over ``evaluations(alert_id, cycle, severity, previous_cycle)``.

    ``previous_cycle`` is the evaluation cycle before this one: an alert missing from
    it has cleared and fires anew.
    """

    def fold(now, row):
        seen, last = now if now else (-1e18, -1e18)
        wait = COOLDOWNS.get(row.severity)
        fresh = seen != row.previous_cycle
        fire = fresh or (wait is not None and row.cycle - last >= wait)
        last = float(row.cycle) if fire else last
        return (float(row.cycle), last), [(float(row.cycle), row.severity)] if fire else []

    return _stateful(evaluations, "alert_id", ["cycle"], fold, "cycle double, severity string", "seen double, last double")


def outages(cycles: DataFrame) -> DataFrame:
    """Outage alerts and recoveries over ``cycles(host, ts, state)``."""

    def fold(now, row):
        fails, since = now if now else (0, -1.0)
        if row.state == "ok":
            done = [(float(row.ts), "recovered", float(row.ts) - since)] if fails >= 2 else []
            return (0, -1.0), done
        fails += 1
        if fails == 2:
            return (fails, float(row.ts)), [(float(row.ts), f"{row.state}_down", None)]
        return (fails, since), []

    return _stateful(cycles, "host", ["ts"], fold, "ts double, event string, seconds double", "fails long, since double")


def failure_sessions(failures: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Sessions of failures: ``failures(host, event_time, gap_seconds)``, a gap per host. State of a session goes once the
    watermark has passed its end."""
    gap = F.concat(F.col("gap_seconds").cast("string"), F.lit(" seconds"))
    seen = failures.withWatermark("event_time", delay)
    sessions = seen.groupBy(F.session_window("event_time", gap).alias("w"), "host").agg(F.count("*").alias("failures"))
    return sessions.select("host", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "failures")


def pending_approvals(log: DataFrame) -> DataFrame:
    """Approvals granted by a tool call within 60 s of an ask: ``log(session, t, event_id,
    kind, rule)``."""

    def fold(now, row):
        asked, rule = now if now else (-1e18, None)
        if row.kind == "ask":
            return (float(row.t), str(row.rule)), []
        ok = rule is not None and int(row.t - asked) < 60
        return (-1e18, None), [(row.event_id, rule)] if ok else []

    return _stateful(log, "session", ["t", "event_id"], fold, "event_id long, rule string", "asked double, rule string")


def timestamp_of(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("long"))


EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
