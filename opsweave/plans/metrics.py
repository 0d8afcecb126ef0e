"""Metric and network queries; readings are derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.functions.ordered import with_running_sum
from opsweave.operators import metrics as M
from opsweave.plans.policy import SQL_EVENTS
from opsweave.plans.registry import query
from opsweave.sources import tables as T


def counters(spark, sf):
    """Cumulative counters per user: every event adds one read, its value in ticks, k segments."""
    e = T.events(spark, sf).select("event_id", "user_id", "t", "k", F.floor("value").alias("v"))
    grow = {
        "reads": F.lit(1), "io_ticks_ms": F.col("v") * 2, "pgfault": F.col("k") * 30,
        "pgmajfault": F.col("v") * 3, "oom_kill": (F.col("k") == 13).cast("int"),
        "out_segs": F.col("k") * 4, "retrans": F.floor(F.col("v") / 4),
    }
    e = with_running_sum(e, ["user_id"], "t", grow, tie=["event_id"], chunk_seconds=86400)
    return e.withColumn("writes", F.col("reads") * 0)


def deltas(spark, sf, *names):
    return M.counter_deltas(counters(spark, sf).select("event_id", "user_id", "t", *names), ["user_id"], list(names), tie=["event_id"])


SQL_COUNTERS = f"""{SQL_EVENTS}, v AS (SELECT event_id, user_id, t, k, floor(value)::BIGINT AS v,
   row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ev), c AS (SELECT * FROM v WHERE rn > 1)"""


@query(
    "metric_disk_latency",
    "MET1",
    f"""WITH {SQL_COUNTERS} SELECT event_id, user_id, (v * 2)::DOUBLE AS avg_latency_ms,
    CASE WHEN v * 2 > 200 THEN 'critical' ELSE 'warning' END AS severity FROM c WHERE v * 2 > 50""",
)
def disk_latency(spark, sf):
    d = M.disk_latency(deltas(spark, sf, "reads", "writes", "io_ticks_ms"))
    return d.select("event_id", "user_id", "avg_latency_ms", "severity")


@query(
    "metric_cache_misses",
    "MET2",
    f"""WITH {SQL_COUNTERS} SELECT event_id, user_id, round(CASE WHEN k > 0 THEN v * 3 / (k * 30) * 100 ELSE 0 END, 6) AS miss_pct,
    CASE WHEN k > 0 AND v * 3 / (k * 30) * 100 > 10 THEN 'warning' ELSE 'info' END AS severity FROM c WHERE v * 3 > 100""",
)
def cache_misses(spark, sf):
    d = M.cache_misses(deltas(spark, sf, "pgfault", "pgmajfault"))
    return d.select("event_id", "user_id", F.round("miss_pct", 6).alias("miss_pct"), "severity")


@query(
    "metric_oom_kills",
    "MET3",
    f"WITH {SQL_COUNTERS} SELECT event_id, user_id, 1::BIGINT AS kills, 'critical' AS severity FROM c WHERE k = 13",
)
def oom_kills(spark, sf):
    d = M.oom_kills(deltas(spark, sf, "oom_kill"))
    return d.select("event_id", "user_id", F.col("d_oom_kill").cast("long").alias("kills"), "severity")


@query(
    "metric_retransmits",
    "MET4",
    f"""WITH {SQL_COUNTERS}, r AS (SELECT *, (v // 4) / (k * 4) * 100 AS rate FROM c WHERE k * 4 > 100 AND v // 4 > 0)
    SELECT event_id, user_id, round(rate, 6) AS rate_pct, CASE WHEN rate > 20 THEN 'critical' ELSE 'warning' END AS severity FROM r WHERE rate > 5""",
)
def retransmits(spark, sf):
    d = M.retransmit_spikes(deltas(spark, sf, "out_segs", "retrans"))
    return d.select("event_id", "user_id", F.round("rate_pct", 6).alias("rate_pct"), "severity")


SQL_HIST = f"""{SQL_EVENTS}, hist AS (SELECT event_type AS device, least(length(bin(greatest(floor(value * 1000)::BIGINT, 1))) - 1, 31)::INTEGER AS bucket,
     count(*) AS n FROM ev GROUP BY ALL),
  hc AS (SELECT *, sum(n) OVER (PARTITION BY device ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY device) AS total FROM hist),
  pct AS (SELECT device, max(total)::BIGINT AS total, min(CASE WHEN cum >= total // 2 THEN (2 ** (bucket + 1))::BIGINT END) AS p50,
     min(CASE WHEN cum >= total * 99 // 100 THEN (2 ** (bucket + 1))::BIGINT END) AS p99, max((2 ** (bucket + 1))::BIGINT) AS max FROM hc GROUP BY device)"""


def histogram(spark, sf):
    e = T.events(spark, sf).select(F.col("event_type").alias("device"), F.floor(F.col("value") * 1000).alias("us"))
    return M.log2_histogram(e, ["device"], "us")


@query("metric_histogram", "MET5", f"WITH {SQL_HIST} SELECT device, bucket, n FROM hist")
def log2_histogram(spark, sf):
    return histogram(spark, sf)


@query("metric_percentiles", "MET5", f"WITH {SQL_HIST} SELECT * FROM pct")
def percentiles(spark, sf):
    return M.histogram_percentiles(histogram(spark, sf), ["device"])


@query(
    "metric_histogram_findings",
    "MET6",
    f"""WITH {SQL_HIST} SELECT device, p99, CASE WHEN p99 > 500000 THEN 'critical' ELSE 'warning' END AS severity FROM pct WHERE p99 > 50000""",
)
def histogram_findings(spark, sf):
    p = M.histogram_percentiles(histogram(spark, sf), ["device"])
    return M.histogram_findings(p, 50_000, 500_000).select("device", "p99", "severity")


@query(
    "metric_by_destination",
    "MET7",
    f"""WITH {SQL_EVENTS}, d AS (SELECT user_id AS host, '10.0.0.' || k // 30 AS dest, sum(k) AS n FROM ev GROUP BY ALL)
    SELECT host, sum(n)::BIGINT AS total, count(*) AS destinations, arg_min(dest, (-n, dest)) AS top_dest,
    CASE WHEN count(*) >= 3 THEN 'local link' WHEN count(*) = 1 THEN 'remote' ELSE 'healthy' END AS verdict FROM d GROUP BY host""",
)
def by_destination(spark, sf):
    e = T.events(spark, sf)
    dest = F.concat(F.lit("10.0.0."), F.floor(F.col("k") / 30).cast("string"))
    return M.by_destination(e.select(F.col("user_id").alias("host"), dest.alias("dest"), F.col("k").alias("n")), ["host"])


@query(
    "metric_drop_reasons",
    "MET8",
    f"""WITH {SQL_EVENTS}, d AS (SELECT user_id AS host, event_type AS reason, sum(k) AS n FROM ev GROUP BY ALL)
    SELECT host, sum(n)::BIGINT AS total, arg_min(reason, (-n, reason)) AS top_reason,
    coalesce(CASE WHEN sum(n) > 1000 THEN 'critical' WHEN sum(n) > 100 THEN 'warning' END, '') AS severity FROM d GROUP BY host""",
)
def drop_reasons(spark, sf):
    e = T.events(spark, sf).select(
        F.col("user_id").alias("host"), F.col("event_type").alias("reason"), F.col("k").alias("n")
    )
    return M.drop_reasons(e, ["host"]).fillna("", ["severity"])


def connections(spark, sf):
    e = T.events(spark, sf)
    return e.select(
        (F.col("user_id") % 7).alias("host"), F.col("k").alias("port"),
        F.floor(F.col("value") * 60).alias("duration_ms"),
    )


@query(
    "metric_connection_lifecycle",
    "MET9",
    f"""WITH {SQL_EVENTS} SELECT user_id % 7 AS host, count(*) AS total, count(*) FILTER (floor(value * 60) < 1000) AS short_lived, count(DISTINCT k) AS ports,
    coalesce(CASE WHEN count(*) FILTER (floor(value * 60) < 1000) > 200 THEN 'warning' WHEN count(*) FILTER (floor(value * 60) < 1000) > 50 THEN 'info' END, '') AS severity
    FROM ev GROUP BY 1""",
)
def connection_lifecycle(spark, sf):
    return M.connection_lifecycle(connections(spark, sf), ["host"]).fillna("", ["severity"])


@query(
    "metric_busiest_ports",
    "MET9 REL18",
    f"""WITH {SQL_EVENTS} SELECT user_id % 7 AS host, k AS port, count(*) AS n FROM ev GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY host ORDER BY n DESC, port) <= 5""",
)
def busiest_ports(spark, sf):
    return M.busiest_ports(connections(spark, sf), ["host"])


@query(
    "metric_connection_severity",
    "MET10",
    f"""WITH {SQL_EVENTS}, c AS (SELECT CASE user_id % 5 WHEN 0 THEN '127.0.0.1' WHEN 1 THEN '10.2.3.' || k WHEN 2 THEN '172.40.0.' || k WHEN 3 THEN '8.8.4.' || k ELSE '93.184.1.' || k END AS ip,
      CASE WHEN k = 4 THEN 4444 WHEN k = 5 THEN 1337 ELSE k * 100 END AS port FROM ev),
    s AS (SELECT CASE WHEN ip IN ('127.0.0.1', '0.0.0.0') THEN '' WHEN port IN (4444, 5555, 1337, 31337, 9999) THEN 'high'
      WHEN ip LIKE '10.%' OR ip LIKE '172.%' OR ip LIKE '192.168.%' OR ip LIKE '100.%' THEN '' ELSE 'info' END AS severity FROM c)
    SELECT severity, count(*) AS n FROM s GROUP BY ALL""",
)
def connection_severity(spark, sf):
    k = F.col("k").cast("string")
    u = F.col("user_id") % 5
    ip = (
        F.when(u == 0, "127.0.0.1").when(u == 1, F.concat(F.lit("10.2.3."), k))
        .when(u == 2, F.concat(F.lit("172.40.0."), k)).when(u == 3, F.concat(F.lit("8.8.4."), k))
        .otherwise(F.concat(F.lit("93.184.1."), k))
    )
    port = F.when(F.col("k") == 4, 4444).when(F.col("k") == 5, 1337).otherwise(F.col("k") * 100)
    e = T.events(spark, sf).select(F.coalesce(M.connection_severity(ip, port), F.lit("")).alias("severity"))
    return e.groupBy("severity").agg(F.count("*").alias("n"))


@query(
    "metric_process_severity",
    "MET11",
    f"""WITH {SQL_EVENTS}, c AS (SELECT CASE k % 10 WHEN 0 THEN 'bash' WHEN 1 THEN 'kworker/0' WHEN 2 THEN 'xmrig' WHEN 3 THEN 'sshd' WHEN 4 THEN '/usr/bin/curl' ELSE 'app' || k END AS comm,
       command || CASE k % 7 WHEN 0 THEN ' readiness' WHEN 1 THEN ' curl x | sh' WHEN 2 THEN ' /dev/tcp/1' ELSE '' END AS cmd, event_type <> 'view' AS inside FROM ev),
    s AS (SELECT CASE WHEN comm LIKE 'kworker%' THEN '' WHEN comm = 'xmrig' OR contains(cmd, '/dev/tcp/') OR (contains(cmd, '| sh') AND contains(cmd, 'curl')) THEN 'critical'
       WHEN inside AND comm IN ('bash', '/usr/bin/curl') AND NOT contains(cmd, 'readiness') THEN 'warning' WHEN inside THEN 'info' WHEN comm = 'sshd' THEN '' ELSE 'info' END AS severity FROM c)
    SELECT severity, count(*) AS n FROM s GROUP BY ALL""",
)
def process_severity(spark, sf):
    k = F.col("k")
    comm = (
        F.when(k % 10 == 0, "bash").when(k % 10 == 1, "kworker/0").when(k % 10 == 2, "xmrig")
        .when(k % 10 == 3, "sshd").when(k % 10 == 4, "/usr/bin/curl")
        .otherwise(F.concat(F.lit("app"), k.cast("string")))
    )
    extra = F.when(k % 7 == 0, " readiness").when(k % 7 == 1, " curl x | sh").when(k % 7 == 2, " /dev/tcp/1").otherwise("")
    e = T.action_events(spark, sf)
    box = F.when(F.col("tool") != "view", "c1")
    s = M.process_severity(comm, F.concat("command", extra), box)
    return e.groupBy(F.coalesce(s, F.lit("")).alias("severity")).agg(F.count("*").alias("n"))


@query(
    "metric_pressure",
    "MET12",
    f"""WITH {SQL_EVENTS} SELECT user_id, coalesce(CASE WHEN sum(k) / 5000 * 100 > 95 THEN 'critical' WHEN sum(k) / 5000 * 100 > 80 THEN 'warning' END, '') AS fd,
    coalesce(CASE WHEN max(value) / 5 > 50 THEN 'critical' WHEN max(value) / 5 > 20 THEN 'warning' END, '') AS io FROM ev GROUP BY user_id""",
)
def pressure(spark, sf):
    e = T.events(spark, sf).groupBy("user_id").agg(F.sum("k").alias("s"), F.max("value").alias("m"))
    return e.select(
        "user_id", F.coalesce(M.fd_pressure(F.col("s"), F.lit(5000)), F.lit("")).alias("fd"),
        F.coalesce(M.io_pressure(F.col("m") / 5), F.lit("")).alias("io"),
    )


SQL_PROBES = f"""{SQL_EVENTS}, probes AS (SELECT user_id % 3 AS host, floor(t / 3600)::BIGINT * 3600 AS ts, CASE event_type WHEN 'signup' THEN 'gateway' ELSE event_type END AS target,
     max(k) >= 55 AS reachable, min(k)::DOUBLE AS loss_pct, max(value) AS avg_ms FROM ev GROUP BY ALL),
  cyc AS (SELECT host, ts, CASE WHEN coalesce(bool_or(NOT reachable) FILTER (target = 'gateway'), false) THEN 'network'
     WHEN coalesce(bool_and(NOT reachable) FILTER (target <> 'gateway'), true) THEN 'isp' ELSE 'ok' END AS state FROM probes GROUP BY ALL)"""


def probes(spark, sf):
    e = T.events(spark, sf)
    target = F.when(F.col("event_type") == "signup", "gateway").otherwise(F.col("event_type"))
    return e.groupBy(
        (F.col("user_id") % 3).alias("host"), (F.floor(F.col("t") / 3600) * 3600).alias("ts"), target.alias("target")
    ).agg(
        (F.max("k") >= 55).alias("reachable"), F.min("k").cast("double").alias("loss_pct"),
        F.max("value").alias("avg_ms"),
    )


@query(
    "metric_outages",
    "MET13",
    f"""WITH {SQL_PROBES}, r AS (SELECT *, sum((state = 'ok')::INT) OVER (PARTITION BY host ORDER BY ts) AS run FROM cyc),
    b AS (SELECT *, row_number() OVER (PARTITION BY host, run ORDER BY ts) AS rn FROM r WHERE state <> 'ok'), s AS (SELECT * FROM b WHERE rn = 2)
    SELECT host, ts, state || '_down' AS event, -1::DOUBLE AS seconds FROM s
    UNION ALL SELECT s.host, g.ts, 'recovered', (g.ts - s.ts)::DOUBLE FROM s JOIN r g ON g.host = s.host AND g.run = s.run + 1 AND g.state = 'ok'""",
)
def outages(spark, sf):
    return M.outage_events(M.probe_cycles(probes(spark, sf))).fillna(-1.0, ["seconds"])


@query(
    "metric_degradations",
    "MET13",
    f"""WITH {SQL_PROBES}, d AS (SELECT p.host, p.ts, target, CASE WHEN target <> 'gateway' AND loss_pct > 20 THEN 'degraded' WHEN avg_ms > 100 THEN 'slow' END AS kind
      FROM probes p JOIN cyc c ON c.host = p.host AND c.ts = p.ts AND state = 'ok')
    SELECT * FROM d WHERE kind IS NOT NULL""",
)
def degradations(spark, sf):
    p = probes(spark, sf)
    return M.degradations(p, M.probe_cycles(p)).select("host", "ts", "target", "kind")


@query(
    "metric_uptime",
    "MET14",
    f"""WITH {SQL_PROBES}, r AS (SELECT *, sum(reachable::INT) OVER (PARTITION BY host, target ORDER BY ts) AS run FROM probes),
    s AS (SELECT host, target, run, min(ts) AS st FROM r WHERE NOT reachable GROUP BY ALL),
    o AS (SELECT s.host, s.target, count(*) AS outages, sum(r.ts - s.st)::BIGINT AS downtime FROM s JOIN r ON r.host = s.host AND r.target = s.target AND r.run = s.run + 1 AND r.reachable GROUP BY ALL)
    SELECT p.host, p.target, count(*) AS total_probes, count(*) FILTER (NOT reachable) AS down_probes, count(*) FILTER (reachable) AS up_probes,
      round(count(*) FILTER (reachable) / count(*) * 100, 4) AS uptime_pct, round(coalesce(avg(CAST(avg_ms AS DECIMAL(18,2))) FILTER (reachable), 0), 4) AS avg_latency_ms, coalesce(max(avg_ms) FILTER (reachable), 0) AS max_latency_ms,
      coalesce(any_value(outages), 0) AS outages, coalesce(any_value(downtime), 0) AS downtime FROM probes p LEFT JOIN o USING (host, target) GROUP BY ALL""",
)
def uptime(spark, sf):
    u = M.uptime_summary(probes(spark, sf), ["host", "target"])
    return u.withColumns({c: F.round(c, 4) for c in ("uptime_pct", "avg_latency_ms")})


SQL_HOPS = f"""{SQL_EVENTS}, hops AS (SELECT user_id % 5 AS host, CASE WHEN event_type IN ('view', 'click') THEN 'gateway' ELSE 'external' END AS hop,
    round(value, 2) AS avg_ms, k::DOUBLE AS jitter_ms FROM ev)"""


def hops(spark, sf):
    e = T.events(spark, sf)
    return e.select(
        (F.col("user_id") % 5).alias("host"),
        F.when(F.col("event_type").isin("view", "click"), "gateway").otherwise("external").alias("hop"),
        F.col("value").alias("avg_ms"), F.col("k").cast("double").alias("jitter_ms"),
    )


@query(
    "metric_network_report",
    "MET15",
    f"""WITH {SQL_HOPS}, p AS (SELECT host, hop, avg(CAST(avg_ms AS DECIMAL(18,2))) AS a, max(avg_ms) AS m, list_sort(list(jitter_ms))[floor(count(*) * 0.95)::BIGINT + 1] AS j FROM hops GROUP BY ALL),
    w AS (SELECT host, max(a) FILTER (hop = 'gateway') AS gw_avg, max(m) FILTER (hop = 'gateway') AS gw_max, max(a) FILTER (hop = 'external') AS ext_avg, max(m) FILTER (hop = 'external') AS ext_max,
      max(j) FILTER (hop = 'gateway') AS gw_p95_jitter, max(j) FILTER (hop = 'external') AS ext_p95_jitter FROM p GROUP BY host)
    SELECT host, round(gw_avg, 4) AS gw_avg, gw_max, round(ext_avg, 4) AS ext_avg, ext_max, gw_p95_jitter, ext_p95_jitter,
      CASE WHEN gw_p95_jitter > 30 THEN 'wifi bufferbloat' WHEN ext_p95_jitter > 50 AND gw_p95_jitter < 10 THEN 'isp jitter' ELSE 'healthy' END AS verdict FROM w""",
)
def network_report(spark, sf):
    r = M.network_report(hops(spark, sf), ["host"])
    return r.withColumns({c: F.round(c, 4) for c in ("gw_avg", "ext_avg")})


@query(
    "metric_exact_p95",
    "MET15",
    f"""WITH {SQL_EVENTS} SELECT event_type, list_sort(list(value))[floor(count(*) * 0.95)::BIGINT + 1] AS value FROM ev GROUP BY event_type""",
)
def exact_p95(spark, sf):
    return M.nth_value(T.events(spark, sf), ["event_type"], "value", 0.95, 1.0)


SQL_PATH = f"""{SQL_EVENTS}, path AS (SELECT user_id AS host, floor(t / 86400)::BIGINT AS ts,
   CASE event_type WHEN 'signup' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS hop_no, event_type AS hop,
   min(k)::DOUBLE AS avg_ms, max(k)::DOUBLE AS max_ms, (count(*) * 6)::DOUBLE AS loss_pct FROM ev GROUP BY ALL)"""


@query(
    "metric_path_bottleneck",
    "MET16",
    f"""WITH {SQL_PATH}, h AS (SELECT *, max_ms - avg_ms AS j, CASE WHEN lag(avg_ms) OVER w > 0 THEN avg_ms - lag(avg_ms) OVER w ELSE avg_ms END AS hl FROM path WINDOW w AS (PARTITION BY host, ts ORDER BY hop_no)),
    g AS (SELECT host, ts, coalesce(arg_min(hop, (-j, hop_no)) FILTER (j > 0), '') AS bottleneck, max(hl) AS max_hop_latency_ms,
      coalesce(max(loss_pct) FILTER (hop_no = 0), 0) AS gl, coalesce(max(j) FILTER (hop_no = 0), 0) AS gj, coalesce(max(loss_pct) FILTER (hop_no = 2), 0) AS el, coalesce(max(j) FILTER (hop_no = 2), 0) AS ej FROM h GROUP BY ALL),
    v AS (SELECT *, CASE WHEN gl > 10 THEN 'wifi loss' WHEN gj > 30 THEN 'wifi bufferbloat' WHEN el > 10 AND gl = 0 THEN 'isp loss' WHEN ej > 50 AND gj < 10 THEN 'isp jitter' ELSE 'healthy' END AS verdict FROM g)
    SELECT host, ts, bottleneck, max_hop_latency_ms, verdict, CASE WHEN verdict LIKE '%loss' THEN 'critical' WHEN verdict = 'healthy' THEN 'info' ELSE 'warning' END AS severity FROM v""",
)
def path_bottleneck(spark, sf):
    e, t = T.events(spark, sf), F.col("event_type")
    no = F.when(t == "signup", 0).when(t == "click", 1).when(t == "error", 2).when(t == "view", 3).otherwise(4)
    p = e.groupBy(F.col("user_id").alias("host"), F.floor(F.col("t") / 86400).alias("ts"), no.alias("hop_no"), t.alias("hop")).agg(
        F.min("k").cast("double").alias("avg_ms"), F.max("k").cast("double").alias("max_ms"),
        (F.count("*") * 6).cast("double").alias("loss_pct"),
    )
    return M.path_bottleneck(p)


@query(
    "metric_dns_comparison",
    "MET17",
    f"""WITH {SQL_EVENTS}, c AS (SELECT user_id AS host, CASE event_type WHEN 'view' THEN '1.1.1.1' WHEN 'click' THEN '8.8.8.8' ELSE '192.168.1.' || k // 50 END AS resolver, value * 5 AS ms FROM ev),
    g AS (SELECT host, arg_min(resolver, (ms, resolver)) FILTER (resolver LIKE '192%') AS own_resolver, min(ms) FILTER (resolver LIKE '192%') AS own_ms, min(ms) FILTER (resolver NOT LIKE '192%') AS public_ms FROM c GROUP BY host)
    SELECT host, coalesce(own_resolver, '') AS own_resolver, round(coalesce(own_ms, -1), 4) AS own_ms, round(coalesce(public_ms, -1), 4) AS public_ms,
    NOT (coalesce(own_ms > 200, false) AND coalesce(public_ms > 200, true)) AS resolving FROM g""",
)
def dns_comparison(spark, sf):
    t = F.col("event_type")
    own = F.concat(F.lit("192.168.1."), F.floor(F.col("k") / 50).cast("string"))
    e = T.events(spark, sf).select(
        F.col("user_id").alias("host"),
        F.when(t == "view", "1.1.1.1").when(t == "click", "8.8.8.8").otherwise(own).alias("resolver"),
        (F.col("value") * 5).alias("response_ms"),
    )
    d = M.dns_comparison(e, ["host"]).fillna(-1.0, ["own_ms", "public_ms"]).fillna("", ["own_resolver"])
    return d.withColumns({c: F.round(c, 4) for c in ("own_ms", "public_ms")})


def failures(spark, sf):
    """Errors of a user as failed probes of a host; the gap of a session is two hours, or a day for even users."""
    return T.events(spark, sf).where("event_type = 'error'").select(
        F.col("user_id").alias("host"), F.col("t").alias("ts"), F.when(F.col("user_id") % 2 == 0, 86400).otherwise(7200).alias("gap_seconds")
    )


@query(
    "metric_failure_sessions",
    "MET13",
    f"""WITH {SQL_EVENTS}, f AS (SELECT user_id AS host, t, CASE WHEN user_id % 2 = 0 THEN 86400 ELSE 7200 END AS gap FROM ev WHERE event_type = 'error'),
    n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY host ORDER BY t) <= gap THEN 0 ELSE 1 END AS new FROM f),
    s AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY t ROWS UNBOUNDED PRECEDING) AS nr FROM n)
    SELECT host, round(min(t), 3) AS started, round(max(t + gap), 3) AS ended, count(*) AS failures FROM s GROUP BY host, nr""",
)
def failure_sessions(spark, sf):
    s = M.failure_sessions(failures(spark, sf), ["host"])
    return s.withColumns({c: F.round(c, 3) for c in ("started", "ended")})


@query(
    "metric_link_quality",
    "MET18",
    f"""WITH {SQL_EVENTS}, s AS (SELECT event_id AS ts, user_id AS host, CASE WHEN k < 50 THEN k - 10 ELSE 0 END AS gw, CASE WHEN event_type = 'error' THEN k ELSE 0 END AS ex, value AS mx, k AS busy, user_id % 4 AS dns, k * k AS err FROM ev)
    SELECT host, ts, CASE WHEN gw > 0 THEN 'gateway_packet_loss' WHEN ex > 0 THEN 'upstream_packet_loss' ELSE 'gateway_high_jitter' END AS key,
       CASE WHEN gw >= 40 OR (gw <= 0 AND ex >= 40) THEN 'critical' ELSE 'warning' END AS severity FROM s WHERE gw > 0 OR ex > 0 OR mx > 50
    UNION ALL SELECT host, ts, 'wifi_channel_congested', CASE WHEN busy > 80 THEN 'critical' ELSE 'warning' END FROM s WHERE busy > 50
    UNION ALL SELECT host, ts, 'dns_resolution_failing', CASE WHEN dns >= 2 THEN 'critical' ELSE 'warning' END FROM s WHERE dns > 0
    UNION ALL SELECT host, ts, 'iface_errors', CASE WHEN err > 10000 THEN 'critical' ELSE 'warning' END FROM s WHERE err > 100""",
)
def link_quality(spark, sf):
    k = F.col("k")
    e = T.events(spark, sf).select(
        F.col("user_id").alias("host"), F.col("event_id").alias("ts"),
        F.when(k < 50, k - 10).otherwise(0).alias("gw_loss"),
        F.when(F.col("event_type") == "error", k).otherwise(0).alias("ext_loss"),
        F.col("value").alias("gw_max_ms"), k.alias("channel_busy_pct"),
        (F.col("user_id") % 4).alias("dns_failures"), (k * k).alias("iface_errors"),
    )
    return M.link_quality(e)
