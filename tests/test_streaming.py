import tempfile

from pyspark.sql import functions as F

from opsweave.operators import correlate as C
from opsweave.operators import logs as L
from opsweave.operators import metrics as M
from opsweave.operators import policy as P
from opsweave.operators import policy_state as S
from opsweave.plans import correlation as PC
from opsweave.plans import metrics as PM
from opsweave.plans import policy as PP
from opsweave.sources import tables as T
from opsweave.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def streamed(spark, df, make, mode="append", files=1):
    """Write ``df`` as ``files`` files, stream them through ``make`` and collect the sink."""
    folder = tempfile.mkdtemp(prefix="opsweave-stream-")
    df.coalesce(files).write.parquet(f"{folder}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    name = "s" + folder[-8:].replace("-", "_").replace("_", "x")
    q = (
        make(source).writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name)


def same(a, b, *cols):
    pick = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert pick(a) == pick(b)


def test_verdicts(spark):
    e = T.action_events(spark, SF)
    out = streamed(spark, e, lambda s: J.guarded(s, PP.RULES))
    same(out, P.guard_check(e, PP.RULES), "event_id", "rule_no", "blocked")


def test_machine_replay(spark):
    e = PP.fsm_events(spark, SF).orderBy("t")
    out = streamed(spark, e, lambda s: J.machine_replay(s, PP.MACHINE))
    same(out, S.replay(e, PP.MACHINE), "instance", "event_id", "from_state", "to_state", "guard_blocked", "error")


def test_approvals_and_pauses(spark):
    asks, appr = PP.asks_and_approvals(spark, SF)
    key = F.concat_ws("/", "session", "rule").alias("key")
    log = asks.select(key, "t", "event_id", F.lit("ask").alias("kind")).unionByName(
        appr.select(key, "t", F.lit(-1).cast("long").alias("event_id"), F.lit("approval").alias("kind"))
    )
    out = streamed(spark, log, J.approvals)
    same(out, S.with_approval(asks, appr), "event_id", "approved")
    e = T.events(spark, SF)
    log = e.select(
        F.col("user_id").alias("key"), "t", "event_id",
        F.when(F.col("event_type") == "signup", "pause").otherwise("event").alias("kind"),
        (F.col("t") + F.col("k") * 3600).alias("expiry"),
    )
    pauses = log.where("kind = 'pause'").select("key", F.col("t").alias("start_t"), F.col("expiry").alias("expiry_t"))
    rest = log.where("kind = 'event'").select("key", "t", "event_id")
    same(streamed(spark, log, J.outside_pauses), S.outside_pauses(rest, pauses, ["key"]), "event_id")


def test_cooloff_and_pending(spark):
    e = T.events(spark, SF)
    b = e.select("event_id", F.col("event_type").alias("rule"), (F.col("t") / 20).alias("t"), F.lit("block").alias("action_taken"))
    same(streamed(spark, b, J.cooloff), S.with_cooloff(b), "event_id", "action_taken")
    rule = F.floor(F.col("k") / 20).cast("string")
    log = e.select(
        "event_id", rule.alias("session"), (F.col("t") / 20).alias("t"), rule.alias("rule"),
        F.when(F.col("event_type") == "error", "ask").otherwise("tool_ok").alias("kind"),
    )
    want = S.granted_approvals(log)
    assert want.count() > 0
    same(streamed(spark, log, J.pending_approvals), want, "event_id", "rule")


def test_storms_cooldowns_outages(spark):
    r = PC.restart_readings(spark, SF).withColumn("t", F.col("t") / 10)
    want = C.restart_storms(r, ["pod"], "event_id")
    assert want.count() > 0
    same(streamed(spark, r, J.restart_storms), want, "event_id", "delta")
    rows = PC.evaluations(spark, SF).groupBy("alert_id", "cycle").agg(F.max("severity").alias("severity"))
    cycles = [r.cycle for r in rows.select("cycle").distinct().orderBy("cycle").collect()]
    before = spark.createDataFrame(list(zip(cycles, [-1.0, *cycles])), "cycle double, previous_cycle double")
    out = streamed(spark, rows.join(before, "cycle"), J.cooldown_fires)
    same(out, C.cooldown_fires(rows), "alert_id", "cycle", "severity")
    cycles = M.probe_cycles(PM.probes(spark, SF)).withColumn("ts", F.col("ts").cast("double"))
    same(streamed(spark, cycles, J.outages), M.outage_events(cycles), "host", "ts", "event", "seconds")


def test_live_buckets(spark):
    lines = T.pod_log_lines(spark, SF).withColumn("event_time", J.timestamp_of(F.col("ts")))
    out = streamed(spark, lines, J.live_buckets, "complete")
    batch = L.pod_buckets(T.pod_log_lines(spark, SF), ("ts", "event_id"))
    same(out, batch, "namespace", "pod", "template_hash", "count", "severity", "template_text")


def test_caused_by(spark):
    logs, changes = PC.logs_and_changes(spark, SF)
    logs = logs.withColumn("event_time", J.timestamp_of(F.col("ts") / 50))
    changes = changes.withColumn("change_time", J.timestamp_of(F.col("change_ts") / 50))
    want = C.caused_by(logs.withColumn("ts", F.col("ts") / 50), changes.withColumn("change_ts", F.col("change_ts") / 50))
    folder = tempfile.mkdtemp(prefix="opsweave-stream-")
    changes.coalesce(1).write.parquet(f"{folder}/changes")
    source = spark.readStream.schema(changes.schema).parquet(f"{folder}/changes")
    out = streamed(spark, logs, lambda s: J.caused_by(s, source))
    assert want.count() > 10 and want.where("change_namespace = ''").count() > 0
    same(out, want, "event_id", "change_id")


def test_windows_and_duplicates(spark):
    lines = T.pod_log_lines(spark, SF).select(
        "event_id", F.lit("u").alias("unit"), "line", J.timestamp_of(F.col("ts") / 600).alias("event_time")
    )
    failing = F.col("line").contains("refused")
    out = streamed(spark, lines, lambda s: J.per_minute_failures(s, failing), "complete")
    want = lines.where(failing).groupBy(F.date_trunc("minute", "event_time").alias("minute"), "unit").agg(F.count("*").alias("errors"))
    same(out, want, "minute", "unit", "errors")
    rate = streamed(spark, lines, lambda s: J.error_rate(s, failing), "complete")
    assert rate.count() > 0 and rate.agg(F.min("errors")).first()[0] > 10
    twice = lines.unionByName(lines)
    assert streamed(spark, twice, J.once_per_event).count() == lines.count()
