"""Correlation, storm, cool-down and set-change queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.functions.ordered import with_running_sum
from opsweave.operators import correlate as C
from opsweave.operators import inventory as I
from opsweave.plans.logs import SQL_BUCKETS, pod_buckets
from opsweave.plans.policy import SQL_EVENTS
from opsweave.plans.registry import query
from opsweave.sources import tables as T


def logs_and_changes(spark, sf):
    e = T.events(spark, sf)
    ns = F.concat(F.lit("ns"), (F.col("user_id") % 10).cast("string"))
    logs = e.where("event_type = 'error'").select("event_id", ns.alias("namespace"), F.col("t").alias("ts"))
    c = e.where("event_type <> 'error'").select(
        F.col("event_id").alias("change_id"), F.col("event_type").alias("change_type"),
        F.when(F.col("k") < 2, "").otherwise(ns).alias("change_namespace"),
        F.concat(F.lit("res-"), F.col("k").cast("string")).alias("resource_name"),
        F.when(F.col("k") > 97, "").otherwise("K8sDeployment").alias("label"),
        F.col("t").alias("change_ts"),
    )
    return logs, c


SQL_CAUSES = f"""{SQL_EVENTS}, lg AS (SELECT event_id, 'ns' || user_id % 10 AS ns, t FROM ev WHERE event_type = 'error'),
  ch AS (SELECT event_id AS change_id, event_type AS change_type, CASE WHEN k < 2 THEN '' ELSE 'ns' || user_id % 10 END AS cns, 'res-' || k AS resource_name,
     CASE WHEN k > 97 THEN '' ELSE 'K8sDeployment' END AS label, t AS ct FROM ev WHERE event_type <> 'error')"""


@query(
    "correlate_caused_by",
    "COR1 COR2 REL6",
    f"""WITH {SQL_CAUSES} SELECT event_id, change_id, change_type, resource_name, round(t - ct, 1) AS delta_seconds, 'candidate' AS confidence
    FROM lg JOIN ch ON ct >= t - 120 AND ct <= t + 10 AND (cns = '' OR cns = ns) AND label <> ''""",
)
def caused_by(spark, sf):
    c = C.caused_by(*logs_and_changes(spark, sf))
    return c.select("event_id", "change_id", "change_type", "resource_name", "delta_seconds", "confidence")


@query(
    "correlate_caused_by_wide",
    "COR1",
    f"""WITH {SQL_CAUSES} SELECT event_id, change_id, round(t - ct, 1) AS delta_seconds
    FROM lg JOIN ch ON ct >= t - 1800 AND ct <= t + 10 AND (cns = '' OR cns = ns) AND label <> ''""",
)
def caused_by_wide(spark, sf):
    c = C.caused_by(*logs_and_changes(spark, sf), before=1800.0)
    return c.select("event_id", "change_id", "delta_seconds")


def daily_resources(spark, sf):
    """One snapshot per day: a resource per user and event type, version = newest event."""
    e = T.events(spark, sf)
    kind = (
        F.when(F.col("event_type") == "view", "Pod").when(F.col("event_type") == "click", "Deployment")
        .when(F.col("event_type") == "error", "ConfigMap").otherwise("Secret")
    )
    return e.groupBy(
        F.floor(F.col("t") / 86400).alias("day"), kind.alias("kind"),
        F.concat(F.lit("ns"), (F.col("user_id") % 10).cast("string")).alias("namespace"),
        F.col("user_id").cast("string").alias("name"),
    ).agg(F.floor(F.max("k") / 25).alias("version"))


SQL_DAILY = f"""{SQL_EVENTS}, snap AS (SELECT floor(t / 86400)::BIGINT AS day, CASE event_type WHEN 'view' THEN 'Pod' WHEN 'click' THEN 'Deployment' WHEN 'error' THEN 'ConfigMap' ELSE 'Secret' END AS kind,
    'ns' || user_id % 10 AS namespace, user_id::VARCHAR AS name, max(k) // 25 AS version FROM ev GROUP BY ALL),
  days AS (SELECT day, lead(day) OVER (ORDER BY day) AS nxt FROM (SELECT DISTINCT day FROM snap)),
  olds AS (SELECT d.nxt AS day, kind, namespace, name, version FROM snap s JOIN days d ON d.day = s.day WHERE nxt IS NOT NULL),
  diff AS (SELECT day, kind, namespace, name, o.version AS ov, s.version AS nv,
     CASE WHEN o.version IS NULL THEN 'added' WHEN s.version IS NULL THEN 'deleted' WHEN o.version = s.version THEN 'unchanged' ELSE 'updated' END AS status
     FROM olds o FULL JOIN snap s USING (day, kind, namespace, name) WHERE day > (SELECT min(day) FROM snap))"""


@query(
    "correlate_state_changes",
    "COR3",
    f"""WITH {SQL_DAILY} SELECT CASE kind WHEN 'Pod' THEN 'pod_change' WHEN 'Deployment' THEN 'deployment_rollout' WHEN 'ConfigMap' THEN 'configmap_edit' ELSE 'secret_edit' END AS change_type,
    namespace AS change_namespace, name AS resource_name, 'K8s' || kind AS label, day AS change_ts FROM diff WHERE status IN ('added', 'updated')""",
)
def state_changes(spark, sf):
    diff = I.series_diff(daily_resources(spark, sf), "day", ["kind", "namespace", "name"], "version")
    return C.state_changes(diff.withColumnRenamed("day", "ts"))


@query(
    "correlate_near_in_time",
    "COR4",
    f"""WITH {SQL_EVENTS} SELECT a.event_id AS message_id, b.event_id AS cluster_event_id FROM ev a JOIN ev b ON abs(a.t - b.t) < 300
    WHERE a.event_type = 'signup' AND b.event_type = 'error'""",
)
def near_in_time(spark, sf):
    e = T.events(spark, sf)
    m = e.where("event_type = 'signup'").select(F.col("event_id").alias("message_id"), F.col("t").alias("ts"))
    k = e.where("event_type = 'error'").select(F.col("event_id").alias("cluster_event_id"), F.col("t").alias("event_ts"))
    return C.near_in_time(m, k).select("message_id", "cluster_event_id")


def restart_readings(spark, sf):
    """Restart counters per namespace: error events restart k // 10 times."""
    e = T.events(spark, sf).select(
        "event_id", "t", (F.col("user_id") % 10).alias("pod"), F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node_name"),
        F.when(F.col("event_type") == "error", F.floor(F.col("k") / 10)).otherwise(0).alias("grow"),
    )
    return with_running_sum(e, ["pod"], "t", {"restart_count": F.col("grow")}, tie=["event_id"], chunk_seconds=86400)


SQL_RESTARTS = f"""{SQL_EVENTS}, rd AS (SELECT event_id, t, epoch_us(ts) AS us, user_id % 10 AS pod, 'n' || user_id % 3 AS node_name,
     sum(CASE WHEN event_type = 'error' THEN k // 10 ELSE 0 END) OVER (PARTITION BY user_id % 10 ORDER BY t, event_id) AS restart_count FROM ev),
  storm AS (SELECT event_id, pod, node_name, (restart_count - first_value(restart_count) OVER w)::BIGINT AS delta FROM rd WINDOW w AS (PARTITION BY pod ORDER BY us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW))"""


@query("correlate_restart_storms", "COR5", f"WITH {SQL_RESTARTS} SELECT event_id, pod, delta FROM storm WHERE delta > 3")
def restart_storms(spark, sf):
    return C.restart_storms(restart_readings(spark, sf), ["pod"], "event_id").select("event_id", "pod", "delta")


@query(
    "correlate_noisy_neighbours",
    "COR7",
    f"""WITH {SQL_RESTARTS}, p AS (SELECT node_name, 'ns' || pod AS namespace, 'pod-' || pod AS name, max(restart_count)::BIGINT AS restart_count FROM rd GROUP BY ALL),
    w AS (SELECT node_name, arg_min(namespace || '/' || name, (-restart_count, namespace, name)) AS neighbour, max(restart_count) AS neighbour_restarts FROM p GROUP BY 1)
    SELECT event_id, neighbour, neighbour_restarts FROM storm JOIN w USING (node_name) WHERE delta > 3""",
)
def noisy_neighbours(spark, sf):
    r = restart_readings(spark, sf)
    pod = F.col("pod").cast("string")
    p = r.groupBy("node_name", F.concat(F.lit("ns"), pod).alias("namespace"), F.concat(F.lit("pod-"), pod).alias("name")).agg(
        F.max("restart_count").alias("restart_count")
    )
    out = C.noisy_neighbours(C.restart_storms(r, ["pod"], "event_id"), p)
    return out.select("event_id", "neighbour", "neighbour_restarts")


@query(
    "correlate_worthy_events",
    "COR6 COR8 COR9",
    f"""WITH {SQL_EVENTS}, c AS (SELECT CASE k % 9 WHEN 0 THEN 'Unhealthy' WHEN 1 THEN 'BackOff' WHEN 2 THEN 'Pulled' WHEN 3 THEN 'Evicted' ELSE 'Started' END AS reason,
      CASE WHEN user_id % 4 = 0 THEN 'kube-system' ELSE 'ns' END AS namespace, CASE WHEN k % 2 = 0 THEN 'coredns-' || k ELSE 'web-' || k END AS object FROM ev)
    SELECT reason, CASE WHEN namespace = 'kube-system' AND starts_with(object, 'coredns') THEN 'critical' ELSE 'warning' END AS severity, count(*) AS n
    FROM c WHERE reason IN ('Unhealthy', 'BackOff', 'Evicted') GROUP BY ALL""",
)
def worthy_events(spark, sf):
    k = F.col("k")
    e = T.events(spark, sf).select(
        F.when(k % 9 == 0, "Unhealthy").when(k % 9 == 1, "BackOff").when(k % 9 == 2, "Pulled")
        .when(k % 9 == 3, "Evicted").otherwise("Started").alias("reason"),
        F.when(F.col("user_id") % 4 == 0, "kube-system").otherwise("ns").alias("namespace"),
        F.concat(F.when(k % 2 == 0, "coredns-").otherwise("web-"), k.cast("string")).alias("object"),
    )
    return C.worthy_events(e).groupBy("reason", "severity").agg(F.count("*").alias("n"))


@query(
    "correlate_watch_severity",
    "COR6 COR9",
    f"""WITH {SQL_EVENTS} SELECT event_type AS action, CASE WHEN user_id % 2 = 0 THEN 'Pod' ELSE 'Deployment' END AS kind,
      CASE WHEN event_type = 'error' OR (user_id % 2 = 0 AND (value > 200 OR k % 10 > 5)) OR (user_id % 2 = 1 AND k < 50) THEN 'warning' ELSE 'info' END AS severity,
      CASE k % 4 WHEN 0 THEN 'CoreDNS' WHEN 1 THEN 'kube-proxy' WHEN 2 THEN 'cloudflared' ELSE '' END AS system, count(*) AS n FROM ev GROUP BY ALL""",
)
def watch_severity(spark, sf):
    k = F.col("k")
    kind = F.when(F.col("user_id") % 2 == 0, "Pod").otherwise("Deployment")
    action = F.when(F.col("event_type") == "error", "deleted").otherwise("applied")
    phase = F.when(F.col("value") > 200, "Failed").otherwise("Running")
    app = F.when(k % 4 == 0, "kube-dns").when(k % 4 == 1, "kube-proxy").otherwise("other")
    labels = F.when(k % 4 == 2, F.create_map(F.lit("app"), F.lit("cloudflared"))).otherwise(F.create_map(F.lit("k8s-app"), app))
    e = T.events(spark, sf).select(
        F.col("event_type").alias("action"), kind.alias("kind"),
        C.watch_severity(kind, action, phase, k % 10, k, F.lit(50)).alias("severity"),
        F.coalesce(C.system_pod(F.lit("kube-system"), labels), F.lit("")).alias("system"),
    )
    return e.groupBy("action", "kind", "severity", "system").agg(F.count("*").alias("n"))


def evaluations(spark, sf):
    """Alert evaluations every ten minutes: user 0..9's alert is active when any event fell in the cycle."""
    e = T.events(spark, sf).withColumn("alert_id", F.concat(F.lit("alert:"), (F.col("user_id") % 10).cast("string")))
    return e.select(
        "alert_id", (F.floor(F.col("t") / 600) * 600).cast("double").alias("cycle"),
        F.when(F.col("user_id") % 3 == 0, "critical").when(F.col("user_id") % 3 == 1, "warning").otherwise("info").alias("severity"),
    )


SQL_EVALS = f"""{SQL_EVENTS}, evals AS (SELECT 'alert:' || user_id % 10 AS alert_id, (floor(t / 600) * 600)::DOUBLE AS cycle,
     CASE max(CASE user_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END) WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' ELSE 'info' END AS severity
     FROM ev GROUP BY 1, 2),
  cyc AS (SELECT cycle, row_number() OVER (ORDER BY cycle) AS no FROM (SELECT DISTINCT cycle FROM evals)),
  num AS (SELECT alert_id, cycle, severity, no, no - 1 IS DISTINCT FROM lag(no) OVER (PARTITION BY alert_id ORDER BY no) AS is_new,
     row_number() OVER (PARTITION BY alert_id ORDER BY no) AS rn FROM evals JOIN cyc USING (cycle))"""


@query(
    "correlate_cooldown",
    "COR10",
    f"""WITH RECURSIVE {SQL_EVALS}, f AS (SELECT alert_id, rn, cycle, severity, true AS fire, cycle AS last FROM num WHERE rn = 1
      UNION ALL SELECT alert_id, rn, cycle, severity, fire, CASE WHEN fire THEN cycle ELSE last END FROM (
        SELECT n.alert_id, n.rn, n.cycle, n.severity, f.last, n.is_new OR CASE n.severity WHEN 'critical' THEN n.cycle - f.last >= 900 WHEN 'warning' THEN n.cycle - f.last >= 1800 ELSE false END AS fire
        FROM f JOIN num n ON n.alert_id = f.alert_id AND n.rn = f.rn + 1))
    SELECT alert_id, cycle, severity FROM f WHERE fire""",
)
def cooldown(spark, sf):
    return C.cooldown_fires(evaluations(spark, sf))


@query("correlate_new_findings", "COR11", f"WITH {SQL_EVALS} SELECT alert_id, cycle FROM num WHERE is_new")
def new_findings(spark, sf):
    rows = evaluations(spark, sf).select("alert_id", "cycle").distinct()
    return C.new_findings(rows, "alert_id", "cycle").select("alert_id", "cycle")


@query(
    "correlate_actionable",
    "COR12",
    f"""WITH {SQL_EVENTS}, c AS (SELECT CASE k % 8 WHEN 0 THEN 'kernel_process_exec_' || user_id WHEN 1 THEN 'ebpf_tcpdrop' WHEN 2 THEN 'gateway_packet_loss' WHEN 3 THEN 'service_errors_' || user_id
       WHEN 4 THEN 'memory_high' WHEN 5 THEN 'nvme_0' WHEN 6 THEN 'unknown_key' ELSE 'disk_root' END AS key, CASE WHEN value > 60 THEN 'critical' ELSE 'warning' END AS severity, k % 8 AS m FROM ev)
    SELECT m, severity, CASE WHEN m IN (0, 1) THEN false WHEN m IN (2, 4, 5, 7) THEN true ELSE severity = 'critical' END AS notify, count(*) AS n FROM c GROUP BY ALL""",
)
def actionable(spark, sf):
    m, u = F.col("k") % 8, F.col("user_id").cast("string")
    key = (
        F.when(m == 0, F.concat(F.lit("kernel_process_exec_"), u)).when(m == 1, "ebpf_tcpdrop").when(m == 2, "gateway_packet_loss")
        .when(m == 3, F.concat(F.lit("service_errors_"), u)).when(m == 4, "memory_high").when(m == 5, "nvme_0")
        .when(m == 6, "unknown_key").otherwise("disk_root")
    )
    severity = F.when(F.col("value") > 60, "critical").otherwise("warning")
    e = T.events(spark, sf).select(m.alias("m"), severity.alias("severity"), C.actionable(key, severity).alias("notify"))
    return e.groupBy("m", "severity", "notify").agg(F.count("*").alias("n"))


@query(
    "correlate_fresh_problems",
    "COR13",
    f"""WITH {SQL_BUCKETS} SELECT namespace, pod, template_hash, count FROM buckets WHERE severity IN ('ERROR', 'FATAL') AND first_seen >= 1704153600
    QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY count DESC, pod, template_hash) <= 10""",
)
def fresh_problems(spark, sf):
    out = C.fresh_problems(pod_buckets(spark, sf), 1704155400.0, "namespace", ["pod", "template_hash"])
    return out.select("namespace", "pod", "template_hash", "count")


@query(
    "correlate_new_members",
    "COR14 REL7",
    f"""WITH {SQL_EVENTS}, s AS (SELECT DISTINCT event_type AS host, floor(t / 86400)::BIGINT AS poll, user_id AS member FROM ev),
    p AS (SELECT host, poll, lag(poll) OVER (PARTITION BY host ORDER BY poll) AS prev FROM (SELECT DISTINCT host, poll FROM s))
    SELECT s.host, s.poll, s.member FROM s JOIN p USING (host, poll) WHERE prev IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM s o WHERE o.host = s.host AND o.poll = p.prev AND o.member = s.member)""",
)
def new_members(spark, sf):
    s = T.events(spark, sf).select(
        F.col("event_type").alias("host"), F.floor(F.col("t") / 86400).alias("poll"), F.col("user_id").alias("member")
    ).distinct()
    return C.new_members(s, ["host"], "poll", ["member"])
