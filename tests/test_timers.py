"""Streaming jobs with timers against their batch forms, on rows that arrive out of order."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from opsweave.operators import correlate as C
from opsweave.operators import policy_state as S
from opsweave.streaming import timers as W

FAR = 10_000_000.0


@pytest.fixture
def rocksdb(spark):
    wanted = {"spark.sql.streaming.stateStore.providerClass": W.ROCKSDB, "spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def streamed(spark, files, schema, make):
    """Stream one file per batch; gives the rows and the keys left in the state."""
    folder = tempfile.mkdtemp(prefix="opsweave-timers-")
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    name = "w" + "".join(c for c in folder[-8:] if c.isalnum())
    q = (
        make(source).writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    )
    assert q.awaitTermination(120) and q.exception() is None
    left = spark.read.format("statestore").option("stateVarName", "held").load(f"{folder}/ck")
    return spark.table(name).collect(), {r[0][0] for r in left.select("key").collect()}


def out_of_order(rows, t, files=3, late=500.0, seed=1):
    """Rows in files by arrival: every row arrives up to ``late`` seconds after its time."""
    r = random.Random(seed)
    rows = sorted(rows, key=lambda x: x[t] + r.random() * late)
    size = -(-len(rows) // files)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def sentinels(make):
    """Two far rows of another key: the watermark passes everything else."""
    return [[make(FAR, -1)], [make(2 * FAR, -2)]]


def test_approvals(rocksdb):
    r = random.Random(2)
    schema = "key string, t double, event_id long, kind string"
    rows = [(f"k{r.randint(0, 3)}", float(r.randint(0, 90_000)), i, "approval" if r.random() < 0.1 else "ask") for i in range(300)]
    files = out_of_order(rows, 1) + sentinels(lambda t, i: ("far", t, i, "ask"))
    got, _ = streamed(rocksdb, files, schema, W.approvals)
    df = rocksdb.createDataFrame(rows, schema)
    want = S.with_approval(df.where("kind = 'ask'").drop("kind"), df.where("kind = 'approval'").select("key", "t"), ["key"]).collect()
    assert {(x.event_id, x.approved) for x in got if x.event_id >= 0} == {(x.event_id, x.approved) for x in want}
    assert len([x for x in got if x.event_id >= 0]) == len(want) and {x.approved for x in want} == {True, False}


def test_pending_and_late_rows(rocksdb):
    r = random.Random(3)
    schema = "session string, t double, event_id long, kind string, rule string"
    rows = [(f"s{r.randint(0, 2)}", r.randint(0, 60_000) / 4, i, r.choice(["ask", "tool_ok"]), f"r{i % 5}") for i in range(400)]
    late = ("s0", 1.0, 10_000, "tool_ok", "x")  # far beyond the watermark: dropped
    end = sentinels(lambda t, i: ("far", t, i, "ask", "x"))
    files = out_of_order(rows, 1) + [end[0], [late, *end[1]]]
    got, _ = streamed(rocksdb, files, schema, W.pending_approvals)
    want = S.granted_approvals(rocksdb.createDataFrame(rows, schema)).collect()
    assert sorted((x.session, x.event_id, x.rule) for x in got) == sorted((x.session, x.event_id, x.rule) for x in want)
    assert want


def test_cooloff(rocksdb):
    r = random.Random(4)
    schema = "rule string, t double, event_id long"
    rows = [(r.choice(["hot", "hot", "hot", "a", "b"]), float(r.randint(0, 12_000)), i) for i in range(400)] + [("hot", 777.0, 400 + i) for i in range(6)]
    files = out_of_order(rows, 1) + sentinels(lambda t, i: ("far", t, i))
    got, _ = streamed(rocksdb, files, schema, W.cooloff)
    want = S.with_cooloff(rocksdb.createDataFrame(rows, schema).withColumn("action_taken", F.lit("block"))).collect()
    assert sorted((x.event_id, x.action_taken) for x in got if x.event_id >= 0) == sorted((x.event_id, x.action_taken) for x in want)
    assert {x.action_taken for x in want} == {"ask", "block"}


def test_cooldown(rocksdb):
    r = random.Random(5)
    rows, n = [], 0
    for cycle in range(120):
        rows.append(("always", 600 + cycle * 60.0, n, "info"))  # every cycle has an evaluation
        for a in ("x", "y"):
            if r.random() < 0.9:
                rows += [(a, 600 + cycle * 60.0, n + 1, "critical"), (a, 600 + cycle * 60.0, n + 2, "warning")]
        n += 5
    schema = "alert_id string, t double, event_id long, severity string"
    files = out_of_order(rows, 1) + sentinels(lambda t, i: ("far", t, i, "info"))
    got, _ = streamed(rocksdb, files, schema, lambda s: W.cooldown_fires(s, 60.0))
    batch = rocksdb.createDataFrame(rows, schema).withColumnRenamed("t", "cycle")
    want = C.cooldown_fires(batch).collect()
    assert sorted((x.alert_id, x.t, x.severity) for x in got if x.alert_id != "far") == sorted((x.alert_id, x.cycle, x.severity) for x in want)


MACHINE = S.Machine(
    "m", "new", {"new": "initial", "open": "active", "done": "terminal"},
    {("new", "go"): "open", ("open", "close"): "done"}, timeouts=(("open", 1.0, "nudge"), ("open", 5.0, "escalate"), ("new", 2.0, "drop")),
)


def test_machine_timeouts(rocksdb):
    r = random.Random(6)
    schema = "instance string, t double, event_id long, event string, guard_ok boolean"
    rows = [(f"i{r.randint(0, 15)}", float(r.randint(0, 100_000)), i, r.choice(["go", "close", "other", "other"]), r.random() < 0.5) for i in range(60)]
    files = out_of_order(rows, 1) + sentinels(lambda t, i: ("far", t, i, "other", True)) + [[("far", 3 * FAR, -3, "other", True)]]
    got, _ = streamed(rocksdb, files, schema, lambda s: W.machine_timeouts(s, MACHINE))
    assert len({(x.instance, x.due_t) for x in got}) == len(got)
    df = rocksdb.createDataFrame(rows, schema)
    for now in (30_000.0, 60_000.0, 200_000.0):
        past = df.where(F.col("t") <= now)
        states = S.final_states(past, S.replay(past, MACHINE))
        last = {x.instance: x.last_t for x in states.collect()}
        want = {(x.instance, x.state, x.event, x.hours) for x in S.due_timeouts(states, MACHINE, now).collect()}
        due = [x for x in got if x.instance in last and last[x.instance] < x.due_t <= now]
        longest = {x.instance: x for x in sorted(due, key=lambda x: x.hours)}
        assert want and {(x.instance, x.state, x.event, x.hours) for x in longest.values()} == want


def test_state_goes_after_expiry(rocksdb):
    """Only the key whose approval is younger than eight hours at the last watermark keeps a state."""
    schema = "key string, t double, event_id long, kind string"
    rows = [(f"k{i}", 100.0 + i, i, "approval") for i in range(50)]
    files = [rows, *sentinels(lambda t, i: ("far", t, i, "approval")), [("end", 2 * FAR + 3600, -3, "ask")], [("end", 2 * FAR + 7200, -4, "ask")]]
    got, left = streamed(rocksdb, files, schema, W.approvals)
    assert left == {"far"} and {x.key for x in got} <= {"end"}
