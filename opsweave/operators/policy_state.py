"""Policy questions that depend on earlier events: approvals, cool-off, pauses, FSMs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsweave.functions.ordered import (
    count_recent,
    with_last_known,
    with_previous,
    with_running_sum,
)

APPROVAL_SECONDS = 8 * 3600
PENDING_SECONDS = 60
COOLOFF_SECONDS = 300
COOLOFF_BLOCKS = 3


def with_approval(
    events: DataFrame, approvals: DataFrame, keys: Sequence[str] = ("session", "rule")
) -> DataFrame:
    """Add ``approved``: the (session, rule) was approved in the last eight hours.

    Both frames carry the keys and ``t``. As-of join by union: no pair of event
    and approval is ever built.
    """
    keys = list(keys)
    both = events.withColumns({"_kind": F.lit(1), "approval": F.lit(None).cast("double")}).unionByName(
        approvals.select(*keys, "t", F.lit(0).alias("_kind"), F.col("t").alias("approval")),
        allowMissingColumns=True,
    )
    seen = with_last_known(both, keys, "t", ["approval"], tie=["_kind"])
    return seen.where("_kind = 1").select(
        *events.columns,
        F.coalesce(F.col("last_approval") >= F.col("t") - APPROVAL_SECONDS, F.lit(False)).alias(
            "approved"
        ),
    )


def granted_approvals(log: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """An ask answered by a successful tool call less than 60 s later is an approval.

    ``log(session, t, event_id, kind, rule)`` with kind ``ask`` or ``tool_ok``; a
    newer ask replaces the pending one and any tool call consumes it.
    """
    seen = with_previous(log, keys, "t", ["kind", "rule", "t"], tie=["event_id"])
    hit = (
        (F.col("kind") == "tool_ok")
        & (F.col("prev_kind") == "ask")
        & (F.floor(F.col("t") - F.col("prev_t")) < PENDING_SECONDS)
    )
    return seen.where(hit).select(*keys, "event_id", F.col("prev_rule").alias("rule"), "t")


def with_cooloff(blocks: DataFrame, keys: Sequence[str] = ("rule",)) -> DataFrame:
    """Blocks of a rule that already blocked three times in five minutes become asks."""
    seen = count_recent(blocks, keys, "t", COOLOFF_SECONDS, "recent_blocks")
    return seen.withColumn(
        "action_taken",
        F.when(F.col("recent_blocks") >= COOLOFF_BLOCKS, "ask").otherwise(F.col("action_taken")),
    )


def outside_pauses(events: DataFrame, pauses: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Events not inside a pause ``[start_t, expiry_t]`` (no expiry = for ever).

    A sweep over starts, events and ends with a running count of open pauses.
    """
    keys = list(keys)
    marks = pauses.select(
        *keys, F.col("start_t").alias("t"), F.lit(0).alias("_kind"), F.lit(1).alias("_open")
    ).unionByName(
        pauses.where("expiry_t is not null").select(
            *keys, F.col("expiry_t").alias("t"), F.lit(2).alias("_kind"), F.lit(-1).alias("_open")
        )
    )
    both = events.withColumns({"_kind": F.lit(1), "_open": F.lit(0)}).unionByName(
        marks, allowMissingColumns=True
    )
    swept = with_running_sum(both, keys, "t", {"_active": F.col("_open")}, tie=["_kind"])
    return swept.where("_kind = 1 and _active <= 0").select(*events.columns)


# --- state machines ---------------------------------------------------------------


@dataclass(frozen=True)
class Machine:
    """States with their type (initial, active, terminal) and what moves them."""

    name: str
    initial: str
    states: dict[str, str]
    transitions: dict[tuple[str, str], str]
    fallbacks: dict[str, str] = field(default_factory=dict)
    reset_event: str | None = None
    reset_to: str | None = None
    timeouts: tuple[tuple[str, float, str], ...] = ()


def step(m: Machine, state: str | None, event: str, guard_ok: bool = True):
    """``(to_state or None, guard_blocked, error or None)`` of one event."""
    kind = m.states.get(state)
    if kind is None:
        return None, False, f"Invalid state: {state}"
    if kind == "terminal":
        if m.reset_event is not None and event == m.reset_event:
            return m.reset_to, False, None
        return None, False, f"Terminal state: {state}"
    target = m.transitions.get((state, event))
    if target is not None:
        return (target, False, None) if guard_ok else (None, True, None)
    target = m.fallbacks.get(event)
    if target:
        return target, False, None
    return None, False, f"No transition from {state} on {event}"


REPLAY_COLUMNS = (
    "event_id long, from_state string, event string, to_state string, success boolean, "
    "guard_blocked boolean, error string"
)


def replay(events: DataFrame, m: Machine, chunk_seconds: int = 24 * 3600) -> DataFrame:
    """Run every instance's events ``(instance, t, event_id, event, guard_ok)`` through
    the machine.

    A chunk of an instance's history acts as a function from start state to end
    state. Chunks are evaluated in parallel for every start state, the functions
    are chained per instance (one small row per chunk), then every chunk is
    replayed from its now known start state.
    """
    kind = events.schema["instance"].dataType.simpleString()
    src = events.select(
        "instance", "t", "event_id", "event", F.coalesce("guard_ok", F.lit(True)).alias("guard_ok"),
        F.floor(F.col("t") / chunk_seconds).cast("long").alias("chunk"),
    )
    names = list(m.states)
    keyed = src.repartition("instance", "chunk").sortWithinPartitions("instance", "chunk", "t", "event_id")

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, {}
        for pdf in frames:
            done = []
            for instance, chunk, event, ok in zip(
                pdf["instance"], pdf["chunk"], pdf["event"], pdf["guard_ok"], strict=True
            ):
                if (instance, chunk) != key:
                    if key is not None:
                        done.append((*key, [now[s] for s in names]))
                    key, now = (instance, chunk), {s: s for s in names}
                moves = {s: step(m, s, event, ok)[0] for s in set(now.values())}
                now = {s: moves[c] or c for s, c in now.items()}
            yield pd.DataFrame(done, columns=["instance", "chunk", "ends"])
        if key is not None:
            yield pd.DataFrame([(*key, [now[s] for s in names])], columns=["instance", "chunk", "ends"])

    summary = keyed.mapInPandas(ends, f"instance {kind}, chunk long, ends array<string>")
    index = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))])
    start = F.struct(
        F.lit(m.initial).alias("state"),
        F.array().cast("array<struct<chunk:bigint,state:string>>").alias("starts"),
    )

    def chain(acc, x):
        known = index[acc["state"]]
        return F.struct(
            F.coalesce(F.get(x["ends"], known), acc["state"]).alias("state"),
            F.concat(
                acc["starts"], F.array(F.struct(x["chunk"].alias("chunk"), acc["state"].alias("state")))
            ).alias("starts"),
        )

    ordered = F.array_sort(F.collect_list(F.struct("chunk", "ends")))
    starts = (
        summary.groupBy("instance")
        .agg(ordered.alias("chunks"))
        .select("instance", F.inline(F.aggregate("chunks", start, chain)["starts"]))
    )
    placed = (
        src.join(starts, ["instance", "chunk"])
        .repartition("instance", "chunk")
        .sortWithinPartitions("instance", "chunk", "t", "event_id")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in frames:
            out = []
            for instance, chunk, first, event_id, event, ok in zip(
                pdf["instance"], pdf["chunk"], pdf["state"], pdf["event_id"], pdf["event"],
                pdf["guard_ok"], strict=True,
            ):
                if (instance, chunk) != key:
                    key, state = (instance, chunk), first
                to, blocked, error = step(m, state, event, ok)
                out.append((instance, event_id, state, event, to, to is not None, blocked, error))
                state = to or state
            yield pd.DataFrame(out, columns=columns)

    columns = ["instance", *[c.split()[0] for c in REPLAY_COLUMNS.split(", ")]]
    return placed.mapInPandas(run, f"instance {kind}, {REPLAY_COLUMNS}")


def final_states(events: DataFrame, replayed: DataFrame) -> DataFrame:
    """State and last activity per instance after the replay."""
    at = events.select("event_id", "t")
    after = F.coalesce("to_state", "from_state")
    return (
        replayed.join(at, "event_id")
        .groupBy("instance")
        .agg(
            F.max_by(after, F.struct("t", "event_id")).alias("state"),
            F.max("t").alias("last_t"),
        )
    )


def due_timeouts(states: DataFrame, m: Machine, now: float) -> DataFrame:
    """Per non-terminal instance the event of the longest timeout already passed."""
    rows = [(s, float(h), e) for s, h, e in m.timeouts if m.states.get(s) != "terminal"]
    limits = states.sparkSession.createDataFrame(rows, "state string, hours double, event string")
    idle = states.withColumn("idle_hours", (F.lit(float(now)) - F.col("last_t")) / 3600)
    return (
        idle.join(F.broadcast(limits), "state")  # the machine's own few timeouts
        .where(F.col("idle_hours") >= F.col("hours"))
        .groupBy("instance", "state")
        .agg(F.max_by("event", "hours").alias("event"), F.max("hours").alias("hours"))
    )
