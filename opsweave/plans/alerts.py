"""Alert and diagnosis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.operators import alerts as A
from opsweave.operators import codegraph as G
from opsweave.operators import diagnose as D
from opsweave.operators import inventory as I
from opsweave.operators import logs as L
from opsweave.operators import metrics as M
from opsweave.plans.codegraph import SQL_BODIES, SQL_FN, SQL_IMPORTS, SQL_MOD, functions_with_bodies, import_edges
from opsweave.plans.inventory import SQL_PODS, raw_pods
from opsweave.plans.logs import SQL_BUCKETS, SQL_HOSTS, SQL_JOURNAL_LINES, SQL_KERNEL, host_tables, pod_buckets
from opsweave.plans.policy import SQL_EVENTS
from opsweave.plans.registry import query
from opsweave.sources import tables as T

# Pods of this family are named like the log pods, so buckets and causes join.
SQL_UPODS = f"""{SQL_BUCKETS}, up AS (SELECT 'main' AS cluster, 'ns' || user_id % 10 AS namespace, 'pod-' || user_id AS name, max(k) AS restart_count,
    CASE WHEN min(k) < 1 THEN 'CrashLoopBackOff' WHEN min(k) < 3 THEN 'Failed' ELSE 'Running' END AS status, 'web' || user_id % 30 AS owner_name FROM ev GROUP BY user_id),
  cz AS (SELECT 'ns' || user_id % 10 AS namespace, 'pod-' || user_id AS pod, event_type AS change_type, 'cm-' || k AS resource_name, round(value, 1) AS delta_seconds FROM ev)"""


def user_pods(spark, sf):
    e = T.events(spark, sf)
    u = F.col("user_id")
    low = F.col("_min")
    return e.groupBy("user_id").agg(F.max("k").alias("restart_count"), F.min("k").alias("_min")).select(
        F.lit("main").alias("cluster"), F.concat(F.lit("ns"), (u % 10).cast("string")).alias("namespace"),
        F.concat(F.lit("pod-"), u.cast("string")).alias("name"), "restart_count",
        F.when(low < 1, "CrashLoopBackOff").when(low < 3, "Failed").otherwise("Running").alias("status"),
        F.concat(F.lit("web"), (u % 30).cast("string")).alias("owner_name"),
    )


def causes(spark, sf):
    e = T.events(spark, sf)
    u = F.col("user_id")
    return e.select(
        F.concat(F.lit("ns"), (u % 10).cast("string")).alias("namespace"), F.concat(F.lit("pod-"), u.cast("string")).alias("pod"),
        F.col("event_type").alias("change_type"), F.concat(F.lit("cm-"), F.col("k").cast("string")).alias("resource_name"),
        F.round("value", 1).alias("delta_seconds"),
    )


@query(
    "alert_crashloop",
    "ALR1",
    f"""WITH {SQL_UPODS}, c AS (SELECT namespace, pod, arg_min(change_type || ' of ' || resource_name, (delta_seconds, resource_name, change_type)) AS c FROM cz GROUP BY ALL),
    e AS (SELECT namespace, pod, arg_min('top error (x' || count || '): ' || left(template_text, 100), (-count, template_hash)) AS e FROM buckets WHERE severity IN ('ERROR', 'FATAL') GROUP BY ALL)
    SELECT 'crashloop:main:' || namespace || ':' || name AS alert_id, 'critical' AS severity, 'CrashLoopBackOff: ' || namespace || '/' || name AS title,
    concat_ws('; ', restart_count || ' restarts', 'after ' || c, e) AS detail FROM up LEFT JOIN c USING (namespace) LEFT JOIN e ON e.namespace = up.namespace AND e.pod = up.name
    WHERE status = 'CrashLoopBackOff' AND (c.pod = up.name OR c.pod IS NULL)""",
)
def crashloop(spark, sf):
    return A.crashloop_alerts(user_pods(spark, sf), causes(spark, sf), pod_buckets(spark, sf))


@query(
    "alert_failed_pods",
    "ALR2 REL8",
    f"""WITH {SQL_UPODS}, d AS (SELECT namespace, pod, string_agg(DISTINCT 'ConfigMap: ' || resource_name, ', ' ORDER BY 'ConfigMap: ' || resource_name) AS deps FROM cz GROUP BY ALL),
    r AS (SELECT up.*, EXISTS (SELECT 1 FROM up o WHERE o.namespace = up.namespace AND o.owner_name = up.owner_name AND o.status = 'Running') AS ok FROM up WHERE status = 'Failed')
    SELECT 'failed:main:' || r.namespace || ':' || name AS alert_id, CASE WHEN ok THEN 'info' ELSE 'warning' END AS severity, 'Failed pod ' || r.namespace || '/' || name AS title,
      CASE WHEN ok THEN 'its owner has another running pod' ELSE coalesce('depends on ' || deps, 'reads no config') END AS detail FROM r LEFT JOIN d ON d.namespace = r.namespace AND d.pod = r.name""",
)
def failed_pods(spark, sf):
    reads = causes(spark, sf).select("namespace", "pod", F.lit("ConfigMap").alias("kind"), F.col("resource_name").alias("target"))
    return A.failed_pod_alerts(user_pods(spark, sf), reads)


@query(
    "alert_disks",
    "ALR3",
    f"""WITH {SQL_HOSTS}, d AS (SELECT hostname, event_type AS m, max(k) AS p FROM hv GROUP BY ALL)
    SELECT 'disk:' || hostname || ':' || m AS alert_id, CASE WHEN p > 95 THEN 'emergency' WHEN p > 90 THEN 'critical' ELSE 'warning' END AS severity, 'Disk ' || p || '% full: ' || m AS title, hostname AS detail FROM d WHERE p > 85""",
)
def disks(spark, sf):
    return A.disk_alerts(host_tables(spark, sf)[1])


@query(
    "alert_units_wifi_kernel",
    "ALR4",
    f"""WITH {SQL_HOSTS} SELECT DISTINCT 'systemd:' || hostname || ':unit-' || k AS alert_id, 'warning' AS severity, 'Unit down: unit-' || k AS title, hostname AS detail FROM hv WHERE event_type = 'error'
    UNION ALL SELECT 'wifi:' || hostname || ':wlan0', 'warning', 'Wireless drops: ' || sum(k) * 2, hostname FROM hv GROUP BY hostname HAVING sum(k) * 2 > 5000
    UNION ALL SELECT DISTINCT 'security:' || hostname || ':' || event_type || ':cmd' || k % 10, 'critical', 'Security: suspicious ' || event_type || ' on ' || hostname, 'cmd' || k % 10 FROM hv WHERE k < 10""",
)
def units_wifi_kernel(spark, sf):
    e = T.events(spark, sf).withColumn("hostname", F.concat(F.lit("host-"), F.col("user_id").cast("string")))
    wifi = e.groupBy("hostname").agg((F.sum("k") * 2).alias("discarded")).withColumn("interface", F.lit("wlan0"))
    kernel = e.select(
        "hostname", F.col("event_type").alias("probe"), F.concat(F.lit("cmd"), (F.col("k") % 10).cast("string")).alias("comm"),
        F.when(F.col("k") < 5, "CRITICAL").when(F.col("k") < 10, "HIGH").otherwise("LOW").alias("severity"),
    )
    units = host_tables(spark, sf)[2].distinct()
    return A.unit_alerts(units).unionByName(A.wifi_alerts(wifi)).unionByName(A.kernel_alerts(kernel))


@query(
    "alert_host_thresholds",
    "ALR5",
    f"""WITH {SQL_HOSTS}, h AS (SELECT hostname, min(k) + 84 AS m, max(k) AS d, count(*) % 16 AS l, 4 AS c FROM hv GROUP BY 1)
    SELECT hostname, CASE WHEN m >= 95 THEN 'memory_critical' ELSE 'memory_high' END AS key, CASE WHEN m >= 95 THEN 'critical' ELSE 'warning' END AS severity FROM h WHERE m >= 85
    UNION ALL SELECT hostname, CASE WHEN d >= 95 THEN 'disk_critical' ELSE 'disk_high' END, CASE WHEN d >= 95 THEN 'critical' ELSE 'warning' END FROM h WHERE d >= 85
    UNION ALL SELECT hostname, 'load_high', 'warning' FROM h WHERE l > c * 2""",
)
def host_thresholds(spark, sf):
    return A.host_thresholds(threshold_hosts(spark, sf))


def threshold_hosts(spark, sf):
    e = T.events(spark, sf)
    return e.groupBy(F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("hostname")).agg(
        (F.min("k") + 84).alias("memory_percent"), F.max("k").alias("disk_percent"),
        (F.count("*") % 16).alias("load_1m"), F.lit(4).alias("cores"), F.max("k").alias("uptime_seconds"),
    )


@query(
    "alert_bad_pods",
    "ALR6",
    f"""WITH {SQL_PODS}, b AS (SELECT *, CASE WHEN status = 'CrashLoopBackOff' THEN status WHEN restart_count > 10 THEN restart_count || ' restarts' END AS s FROM pods)
    SELECT 'pod_' || namespace || '_' || name AS alert_id, 'critical' AS severity, 'Pod ' || namespace || '/' || name || ': ' || s AS title, s AS detail FROM b WHERE s IS NOT NULL""",
)
def bad_pods(spark, sf):
    return A.bad_pods(I.pods(raw_pods(spark, sf)))


@query(
    "alert_warning_events",
    "ALR7",
    f"""WITH {SQL_EVENTS}, e AS (SELECT 'ns' || user_id % 10 AS namespace, 'pod-' || user_id AS object, CASE k % 6 WHEN 0 THEN 'OOMKilling' WHEN 1 THEN 'BackOff' WHEN 2 THEN 'Pulled' WHEN 3 THEN 'NodeNotReady' WHEN 4 THEN 'FailedMount' ELSE 'Created' END AS reason FROM ev),
    g AS (SELECT namespace, object, reason, count(*) AS count FROM e GROUP BY ALL)
    SELECT 'k8s_event_' || namespace || '_' || object || '_' || reason AS alert_id, CASE WHEN reason IN ('OOMKilling', 'NodeNotReady') THEN 'critical' ELSE 'warning' END AS severity, reason AS title, count || 'x' AS detail
    FROM g WHERE reason IN ('OOMKilling', 'BackOff', 'NodeNotReady', 'FailedMount') AND count > 1""",
)
def warning_events(spark, sf):
    k, u = F.col("k") % 6, F.col("user_id")
    reason = (
        F.when(k == 0, "OOMKilling").when(k == 1, "BackOff").when(k == 2, "Pulled").when(k == 3, "NodeNotReady")
        .when(k == 4, "FailedMount").otherwise("Created")
    )
    e = T.events(spark, sf).groupBy(
        F.concat(F.lit("ns"), (u % 10).cast("string")).alias("namespace"), F.concat(F.lit("pod-"), u.cast("string")).alias("object"),
        reason.alias("reason"),
    ).agg(F.count("*").alias("count"))
    return A.warning_events(e)


def unit_lines(spark, sf):
    """Journal lines with unit = first part of the pod name; one real hour stands for a minute."""
    lines = L.journal_fields(T.journal_lines(spark, sf))
    return lines.select("hostname", F.lit("pod").alias("unit"), (F.col("ts") / 60).alias("ts"), "line")


@query(
    "alert_service_failures",
    "ALR8",
    rf"""WITH {SQL_JOURNAL_LINES}, w AS (SELECT hostname, 'pod' AS unit, floor(ts / 60 / 120)::BIGINT * 120 AS "window", regexp_matches(lower(line), 'deadline exceeded|timed out|i/o timeout|connection reset|connection refused|unreachable|failed|error|panic|no route to host') AS bad FROM jl)
    SELECT hostname, unit, "window", 'all' AS what, count(*) AS n, CASE WHEN count(*) > 10 THEN 'critical' ELSE 'warning' END AS severity FROM w GROUP BY ALL
    UNION ALL SELECT hostname, unit, "window", 'failing', count(*), CASE WHEN count(*) > 10 THEN 'critical' WHEN count(*) > 3 THEN 'warning' ELSE 'info' END FROM w WHERE bad GROUP BY ALL""",
)
def service_failures(spark, sf):
    lines = unit_lines(spark, sf)
    a = A.journal_errors(lines).withColumn("what", F.lit("all"))
    return a.unionByName(A.service_failures(lines).withColumn("what", F.lit("failing")))


@query(
    "alert_kernel_families",
    "ALR8",
    f"""WITH {SQL_EVENTS}, l AS (SELECT user_id AS hostname, k % 7 AS m FROM ev)
    SELECT hostname, unnest(['usb', 'io', 'fs', 'oom'][m + 1:m + 1]) AS family, count(*) AS n, CASE WHEN m = 0 AND count(*) <= 10 THEN 'warning' ELSE 'critical' END AS severity FROM l WHERE m < 4 GROUP BY hostname, m""",
)
def kernel_families(spark, sf):
    m = F.col("k") % 7
    line = (
        F.when(m == 0, "usb 1-2: USB disconnect").when(m == 1, "blk_update_request: I/O error, dev sda")
        .when(m == 2, "EXT4-fs (sda1): remounting filesystem read-only").when(m == 3, "Out of memory: Killed process 7")
        .otherwise("eth0: link up")
    )
    lines = T.events(spark, sf).select(F.col("user_id").alias("hostname"), line.alias("line"))
    return A.kernel_families(lines)


@query(
    "alert_baseline_drift",
    "ALR9",
    f"""WITH {SQL_EVENTS}, m AS (SELECT DISTINCT 'h' || user_id % 4 AS hostname, CASE event_type WHEN 'view' THEN 'ssh_keys' WHEN 'click' THEN 'cron_jobs' ELSE 'users' END AS kind, floor(t / 432000)::BIGINT AS poll, k * 1000 + user_id AS member FROM ev),
    f AS (SELECT hostname, kind, min(poll) AS f FROM m GROUP BY ALL), b AS (SELECT m.hostname, m.kind, member FROM m JOIN f USING (hostname, kind) WHERE poll = f),
    p AS (SELECT m.hostname, m.kind, poll, count(*) AS n, count(b.member) AS same FROM m JOIN f USING (hostname, kind) LEFT JOIN b ON b.hostname = m.hostname AND b.kind = m.kind AND b.member = m.member WHERE poll > f GROUP BY ALL),
    nb AS (SELECT hostname, kind, count(*) AS nb FROM b GROUP BY ALL)
    SELECT hostname, kind, poll, n - same AS added, nb - same AS removed, CASE kind WHEN 'cron_jobs' THEN 'warning' ELSE 'critical' END AS severity FROM p JOIN nb USING (hostname, kind)
    WHERE CASE WHEN kind = 'users' THEN n > same ELSE n > same OR nb > same END""",
)
def baseline_drift(spark, sf):
    t = F.col("event_type")
    m = T.events(spark, sf).select(
        F.concat(F.lit("h"), (F.col("user_id") % 4).cast("string")).alias("hostname"),
        F.when(t == "view", "ssh_keys").when(t == "click", "cron_jobs").otherwise("users").alias("kind"),
        F.floor(F.col("t") / 432000).alias("poll"), (F.col("k") * 1000 + F.col("user_id")).alias("member"),
    )
    return A.baseline_drift(m)


@query(
    "alert_security_findings",
    "ALR10",
    f"""WITH {SQL_EVENTS}, p AS (SELECT 'h' || user_id % 4 AS hostname, event_id AS pid, CASE k % 5 WHEN 0 THEN 'xmrig' WHEN 1 THEN 'node' WHEN 2 THEN 'worker' ELSE 'app' END AS comm, CASE k % 7 WHEN 0 THEN 'x stratum+tcp://' ELSE command END AS cmd, k + 5 AS cpu, 9990 + k AS port, ts FROM ev)
    SELECT 'suspicious_process:xmrig' AS sign, 'critical' AS severity, count(*) AS n FROM p WHERE comm = 'xmrig' HAVING count(*) > 0
    UNION ALL SELECT 'suspicious_cmdline:stratum+', 'critical', count(*) FROM p WHERE contains(cmd, 'stratum+tcp') HAVING count(*) > 0
    UNION ALL SELECT 'high_cpu_process', 'warning', count(*) FROM p WHERE cpu > 90 AND comm <> 'node' HAVING count(*) > 0
    UNION ALL SELECT 'outbound', 'warning', count(*) FROM p WHERE port > 10000 HAVING count(*) > 0
    UNION ALL SELECT 'privileged_pod', 'warning', count(DISTINCT pid) FROM p WHERE cpu % 4 = 0 AND hostname <> 'h0' HAVING count(*) > 0
    UNION ALL SELECT 'host_access_pod', 'warning', count(DISTINCT pid) FROM p WHERE cpu % 6 = 0 AND hostname <> 'h0' HAVING count(*) > 0""",
)
def security_findings(spark, sf):
    k, host = F.col("k"), F.concat(F.lit("h"), (F.col("session") % 4).cast("string"))
    e = T.action_events(spark, sf).select(
        host.alias("hostname"), F.col("event_id").alias("pid"),
        F.when(k % 5 == 0, "xmrig").when(k % 5 == 1, "node").when(k % 5 == 2, "worker").otherwise("app").alias("comm"),
        F.when(k % 7 == 0, "x stratum+tcp://").otherwise(F.col("command")).alias("cmdline"),
        (k + 5).alias("cpu"), (k + 9990).alias("port"), F.lit("curl").alias("process"),
        F.when(host == "h0", "kube-system").otherwise(host).alias("namespace"), F.col("event_id").cast("string").alias("name"),
        ((k + 5) % 4 == 0).alias("privileged"), ((k + 5) % 6 == 0).alias("host_network"), F.lit(False).alias("host_pid"),
    )
    rows = A.process_findings(e).select("sign", "severity")
    rows = rows.unionByName(A.outbound_findings(e).select(F.lit("outbound").alias("sign"), "severity"))
    rows = rows.unionByName(A.privileged_pods(e).select(F.col("key").alias("sign"), "severity"))
    return rows.groupBy("sign", "severity").agg(F.count("*").alias("n"))


@query(
    "alert_after_boot",
    "ALR11",
    f"""WITH {SQL_HOSTS}, f AS (SELECT hostname, CASE k % 3 WHEN 0 THEN 'ebpf_tcpdrop' WHEN 1 THEN 'dmesg_new_errors_' || event_type ELSE 'disk_root' END AS key, event_id FROM hv), h AS (SELECT hostname, count(*) * 9 AS up FROM hv GROUP BY 1)
    SELECT hostname, key, count(*) AS n FROM f JOIN h USING (hostname) WHERE NOT (up < 600 AND key <> 'disk_root') GROUP BY ALL""",
)
def after_boot(spark, sf):
    k = F.col("k") % 3
    e = T.events(spark, sf).withColumn("hostname", F.concat(F.lit("host-"), F.col("user_id").cast("string")))
    f = e.select("hostname", F.when(k == 0, "ebpf_tcpdrop").when(k == 1, F.concat(F.lit("dmesg_new_errors_"), "event_type")).otherwise("disk_root").alias("key"))
    h = e.groupBy("hostname").agg((F.count("*") * 9).alias("uptime_seconds"))
    return A.after_boot(f, h).groupBy("hostname", "key").agg(F.count("*").alias("n"))


# --- diagnosis --------------------------------------------------------------------------


def _sql_patterns() -> str:
    def quoted(w: str) -> str:
        return w.lower().replace("'", "''")

    cases = " UNION ALL ".join(
        f"SELECT {i} AS ord, '{pid}' AS pattern, '{cat}' AS category, {sev} AS sev, [{', '.join(chr(39) + quoted(w) + chr(39) for w in words)}] AS words"
        for i, (pid, cat, sev, words) in enumerate(D.PATTERNS)
    )
    return f"pat AS ({cases}), kw AS (SELECT * EXCLUDE (words), unnest(words) AS word FROM pat)"


@query(
    "diagnose_document_patterns",
    "DIA1",
    f"""WITH {_sql_patterns()}, m AS (SELECT DISTINCT doc_id, pattern, category, sev FROM documents JOIN kw ON contains(lower(text), word))
    SELECT pattern, category, CASE sev WHEN 3 THEN 'critical' WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, count(*) AS documents FROM m GROUP BY ALL""",
)
def document_patterns(spark, sf):
    d = T.load(spark, sf, "documents").select(D.pattern_matches(F.col("text")).alias("ps"))
    d = d.select(F.explode("ps").alias("p"))
    return d.groupBy("p.pattern", "p.category", D.severity_label(F.col("p.neg")).alias("severity")).agg(F.count("*").alias("documents"))


SQL_DIAG = """hit AS (SELECT src.*, arg_min(kw.pattern, (-sev, ord)) AS pattern, arg_min(category, (-sev, ord)) AS category, max(sev) AS sev FROM src JOIN kw ON contains(lower(template_text), word) GROUP BY ALL),
  diag AS (SELECT source, pattern, category, CASE sev WHEN 3 THEN 'critical' WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS pattern_severity, max(count) AS occurrences, arg_min(template_text, (-count, template_text)) AS template_text, count(*) AS templates FROM hit GROUP BY source, pattern, category, sev)"""


@query(
    "diagnose_report",
    "DIA2 DIA4",
    f"""WITH {SQL_BUCKETS}, {SQL_KERNEL}, {_sql_patterns()}, kt AS (SELECT hostname, template_hash, arg_min(template_text, (doc_id, pos)) AS template_text FROM kc GROUP BY ALL),
    src AS (SELECT 'cluster' AS source, namespace || pod || template_hash AS key, template_text, count FROM buckets UNION ALL SELECT 'kernel', kernel.hostname || kernel.template_hash, template_text, count FROM kernel JOIN kt USING (hostname, template_hash)), {SQL_DIAG}
    SELECT * FROM diag""",
)
def report(spark, sf):
    kernel = L.kernel_buckets(T.document_lines(spark, sf), ("ts", "pos"))
    r = D.diagnose_report({"cluster": pod_buckets(spark, sf), "kernel": kernel})
    return r.select("source", "pattern", "category", "pattern_severity", "occurrences", "template_text", "templates")


@query(
    "diagnose_context_advice",
    "DIA3",
    f"""WITH {SQL_HOSTS}, w AS (SELECT hostname, CASE max(k) % 4 WHEN 0 THEN '2.4GHz' WHEN 1 THEN 'ac' WHEN 2 THEN 'bgn' END AS band, min(k) AS ch, count(*) % 2 = 0 AS g5, count(*) % 3 = 0 AS eth FROM hv GROUP BY 1),
    d AS (SELECT hostname, event_type AS m, max(k) AS p FROM hv GROUP BY ALL)
    SELECT 'wifi' AS topic, hostname AS who, CASE WHEN (contains(band, '2.4') OR band IN ('bg', 'bgn')) AND g5 THEN 'on 2.4 GHz channel ' || ch || ': switch to the 5 GHz network' WHEN contains(band, '2.4') OR band IN ('bg', 'bgn') THEN 'on 2.4 GHz channel ' || ch || ': use the least busy of channels 1, 6, 11'
      WHEN band = 'ac' THEN 'on 5 GHz: signal may be short-ranged, move closer or add a repeater' ELSE 'band unknown: check by hand' END || CASE WHEN eth THEN '; ethernet is connected, prefer it' ELSE '' END AS advice FROM w
    UNION ALL SELECT 'disk', hostname || ' ' || m, CASE WHEN p > 90 THEN 'nearly full: free space now' WHEN p > 80 THEN 'approaching full: find the largest folders' ELSE 'healthy' END FROM d""",
)
def context_advice(spark, sf):
    e = T.events(spark, sf).withColumn("hostname", F.concat(F.lit("host-"), F.col("user_id").cast("string")))
    w = e.groupBy("hostname").agg(
        (F.max("k") % 4).alias("b"), F.min("k").alias("channel"), (F.count("*") % 2 == 0).alias("has_5ghz"),
        (F.count("*") % 3 == 0).alias("has_ethernet"),
    ).withColumn("band", F.when(F.col("b") == 0, "2.4GHz").when(F.col("b") == 1, "ac").when(F.col("b") == 2, "bgn"))
    wifi = D.wifi_advice(w).select(F.lit("wifi").alias("topic"), F.col("hostname").alias("who"), "advice")
    disk = D.disk_advice(host_tables(spark, sf)[1])
    return wifi.unionByName(disk.select(F.lit("disk").alias("topic"), F.concat_ws(" ", "hostname", "mountpoint").alias("who"), "advice"))


@query("diagnose_dns_and_crash_advice", "DIA3")
def dns_and_crash_advice(spark, sf):
    """Resolver advice per host and the causes listed for crashing pods."""
    t = F.col("event_type")
    checks = T.events(spark, sf).select(
        F.col("user_id").cast("string").alias("who"),
        F.when(t == "view", "1.1.1.1").when(t == "click", "8.8.8.8").otherwise("192.168.1.1").alias("resolver"),
        (F.col("value") * 40).alias("response_ms"),
    )
    dns = D.dns_advice(M.dns_comparison(checks, ["who"]), ["who"])
    crash = D.crashloop_advice(user_pods(spark, sf), causes(spark, sf))
    return dns.unionByName(crash.select(F.col("name").alias("who"), F.col("causes").alias("advice")))


@query(
    "diagnose_command_safety",
    "DIA5",
    f"""WITH {SQL_EVENTS}, c AS (SELECT CASE k % 6 WHEN 0 THEN 'kubectl DELETE namespace x' WHEN 1 THEN 'kubectl scale --replicas=0 web' WHEN 2 THEN 'kubectl scale web' WHEN 3 THEN 'git push --force' WHEN 4 THEN 'systemctl restart ' || user_id ELSE command END AS c, event_type FROM ev)
    SELECT event_type, CASE WHEN regexp_matches(lower(c), 'delete namespace|scale --replicas=0|push --force') THEN 'blocked' WHEN regexp_matches(lower(c), 'kubectl scale|systemctl restart') THEN 'safe' ELSE 'needs_review' END AS safety, count(*) AS n FROM c GROUP BY ALL""",
)
def command_safety(spark, sf):
    k = F.col("k") % 6
    c = (
        F.when(k == 0, "kubectl DELETE namespace x").when(k == 1, "kubectl scale --replicas=0 web").when(k == 2, "kubectl scale web")
        .when(k == 3, "git push --force").when(k == 4, F.concat(F.lit("systemctl restart "), F.col("session").cast("string")))
        .otherwise(F.col("command"))
    )
    e = T.action_events(spark, sf).select(F.col("tool").alias("event_type"), D.command_safety(c).alias("safety"))
    return e.groupBy("event_type", "safety").agg(F.count("*").alias("n"))


@query(
    "diagnose_error_category",
    "DIA8",
    "WITH c AS (SELECT source, CASE WHEN regexp_matches(lower(text), '" + "|".join(D.INFRASTRUCTURE_WORDS) + "') THEN 'infrastructure' WHEN regexp_matches(lower(text), '"
    + "|".join(D.CONFIGURATION_WORDS) + "') THEN 'configuration' ELSE 'application' END AS category FROM documents) SELECT source, category, count(*) AS n FROM c GROUP BY ALL",
)
def error_category(spark, sf):
    d = T.load(spark, sf, "documents").select("source", D.error_category(F.col("text")).alias("category"))
    return d.groupBy("source", "category").agg(F.count("*").alias("n"))


def camel_functions(spark, sf):
    """Functions with camelCase names (one per part name and file) and short bodies."""
    p = T.load(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.concat(F.split("p_name", " ")[0], F.initcap(F.split("p_name", " ")[1])).alias("name"),
        F.lower(F.concat_ws(" ", "p_type", "p_brand")).alias("body"),
    )
    return T.functions(spark, sf).select("id", "file").join(p, "id")


def error_texts(spark, sf):
    e = T.events(spark, sf).where("event_type = 'error'")
    p = T.load(spark, sf, "part").select(
        F.col("p_partkey").alias("k"),
        F.concat(F.split("p_name", " ")[0], F.initcap(F.split("p_name", " ")[1])).alias("name"), "p_name",
    )
    m = F.col("event_id") % 6
    text = (
        F.when(m == 0, F.concat(F.lit("TypeError: ["), "name", F.lit("] exploded &amp; burned")))
        .when(m == 1, F.concat(F.lit("Cannot read property of "), "name"))
        .when(m == 2, F.concat(F.lit("boom at "), "name", F.lit(" (app.js:3)")))
        .when(m == 3, F.concat(F.lit("The "), F.initcap(F.split("p_name", " ")[0]), F.lit("Gateway service is failing")))
        .when(m == 4, F.concat(F.lit("oops in "), F.lower("name"), F.lit(" during startup")))
        .otherwise(F.concat(F.lit("Something about economy parts under Brand of "), "p_name"))
    )
    return e.join(p, "k").select(F.col("event_id").alias("error_id"), text.alias("text"))


@query("diagnose_candidate_functions", "DIA6")
def candidate_functions(spark, sf):
    return D.candidate_functions(error_texts(spark, sf), camel_functions(spark, sf))


@query(
    "diagnose_upstream_trace",
    "DIA7",
    f"""WITH {SQL_IMPORTS}, t AS (SELECT id, name FROM fn), up AS (SELECT dst AS id, file AS upstream FROM calls JOIN fn ON fn.id = src WHERE dst IN (SELECT id FROM t) UNION SELECT t.id, importer FROM edges JOIN t USING (name)),
    vi AS (SELECT DISTINCT importer FROM edges WHERE contains(replace(name, 'red_', 'validate_'), 'validate')), vu AS (SELECT DISTINCT file FROM fn WHERE line > 45)
    SELECT id, upstream, upstream IN (SELECT importer FROM vi) OR upstream IN (SELECT file FROM vu) AS validated, upstream NOT IN (SELECT importer FROM vi) AND NOT starts_with(upstream, 'src/') AS root_cause FROM up""",
)
def upstream_trace(spark, sf):
    f = T.functions(spark, sf)
    edges = import_edges(spark, sf)
    name = F.replace(F.col("name"), F.lit("red_"), F.lit("validate_"))
    renamed = f.withColumn("name", name)
    return D.upstream_trace(
        f, renamed, T.call_pairs(spark, sf), edges.withColumn("name", name), f.where("line > 45")
    )


@query(
    "diagnose_confidence",
    "DIA9",
    """WITH c AS (SELECT count(*) AS n FROM part UNION ALL SELECT count(*) FROM orders UNION ALL SELECT count(*) FROM lineitem UNION ALL SELECT count(*) FROM conversations
      UNION ALL SELECT count(*) FROM benchmark WHERE text = 'no such ticket' UNION ALL SELECT count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT count(*) FROM events WHERE event_type = 'no pods' UNION ALL SELECT count(*) FROM events)
    SELECT count(*) AS total, count(*) FILTER (n > 0) AS available, floor(count(*) FILTER (n > 0) / count(*) * 100)::BIGINT AS percent, 'MEDIUM' AS label FROM c""",
)
def confidence(spark, sf):
    def load(t):
        return T.load(spark, sf, t)

    sources = {
        "functions": load("part"), "commits": load("orders"), "imports": load("lineitem"), "chat": load("conversations"),
        "tickets": load("benchmark").where("text = 'no such ticket'"), "prs": load("orders").where("o_orderstatus = 'O'"),
        "pods": load("events").where("event_type = 'no pods'"), "hosts": load("events"),
    }
    counts = I.table_counts(sources)
    return D.confidence(counts)


@query(
    "diagnose_blind_spots",
    "DIA10",
    """WITH b AS (SELECT lower(html) AS x FROM pages), c AS (SELECT lower(text || CASE WHEN turn % 5 = 1 THEN ' see Kibana' WHEN turn % 5 = 2 THEN ' check Grafana' ELSE '' END) AS x FROM conversations)
    SELECT 'Grafana' AS tool, 'chat' AS place, count(*) AS n FROM c WHERE contains(x, 'grafana') HAVING count(*) > 0 UNION ALL SELECT 'Kibana/ELK', 'chat', count(*) FROM c WHERE contains(x, 'kibana') HAVING count(*) > 0
    UNION ALL SELECT 'Database queries', 'code', count(*) FROM b WHERE contains(x, '@prisma') HAVING count(*) > 0""",
)
def blind_spots(spark, sf):
    m = F.col("turn") % 5
    chat = T.load(spark, sf, "conversations").select(
        F.concat("text", F.when(m == 1, " see Kibana").when(m == 2, " check Grafana").otherwise("")).alias("text")
    )
    bodies = T.load(spark, sf, "pages").select(F.col("html").alias("body"))
    connected = T.load(spark, sf, "region").where("r_regionkey = 0").select(F.lit("Datadog").alias("tool"))
    return D.blind_spots(bodies, chat, connected)


@query(
    "diagnose_people",
    "DIA11",
    f"""WITH {SQL_MOD}, l AS (SELECT fn AS id, commit, author FROM modi QUALIFY row_number() OVER (PARTITION BY fn ORDER BY date DESC, commit DESC) <= 3)
    SELECT id, commit, author, CASE WHEN c_acctbal > 0 THEN '' WHEN c_nationkey % 2 = 0 THEN 'no recent activity, try ' || c_mktsegment ELSE 'no recent activity' END AS note FROM l JOIN customer ON c_custkey = author""",
)
def people(spark, sf):
    act = T.load(spark, sf, "customer").select(
        F.col("c_custkey").alias("author"), (F.col("c_acctbal") > 0).alias("active"),
        F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("suggested"),
    )
    targets = T.functions(spark, sf).select("id")
    return D.people_with_context(targets, T.modified(spark, sf), act)


@query(
    "diagnose_test_coverage",
    "DIA12 REL5",
    f"""WITH {SQL_FN}, f AS (SELECT DISTINCT CASE WHEN id % 5 = 0 THEN replace(replace(file, 'src/', 'tests/'), '.py', '.test.py') ELSE file END AS file FROM fn),
    s AS (SELECT file, regexp_replace(split_part(file, '/', -1), '\\.(tsx|ts|js|py)', '') AS stem FROM f WHERE NOT contains(file, '.test.'))
    SELECT file, stem, EXISTS (SELECT 1 FROM f t WHERE contains(t.file, '.test.') AND contains(t.file, s.stem)) AS covered FROM s""",
)
def test_coverage(spark, sf):
    moved = F.replace(F.replace(F.col("file"), F.lit("src/"), F.lit("tests/")), F.lit(".py"), F.lit(".test.py"))
    f = T.functions(spark, sf).select(F.when(F.col("id") % 5 == 0, moved).otherwise(F.col("file")).alias("file")).distinct()
    return D.test_coverage(f)


def cases(spark, sf):
    """Diagnosis texts: the documents with a generated conclusion; truth from the labels."""
    d = T.load(spark, sf, "documents").join(T.load(spark, sf, "labels"), "doc_id")
    tail = F.when(F.col("quality") == 1, " CONCLUSION: src/payments/charge.py is an infrastructure problem").otherwise(
        F.when(F.col("toxic") == 1, " payments maybe").otherwise("")
    )
    return d.select(
        F.col("doc_id").alias("case_id"), "lang", F.concat("text", tail).alias("diagnosis"),
        F.lit("src/payments/charge.py").alias("root_cause_file"), F.array(F.lit("The"), F.lit("Charge"), F.lit("qqqq")).alias("must_mention"),
        F.when(F.col("lang") == "en", "infrastructure").otherwise("config").alias("category"),
    )


SQL_CASES = """c AS (SELECT doc_id AS case_id, lang, text || CASE WHEN quality = 1 THEN ' CONCLUSION: src/payments/charge.py is an infrastructure problem' WHEN toxic = 1 THEN ' payments maybe' ELSE '' END AS d FROM documents JOIN labels USING (doc_id)),
  p AS (SELECT *, CASE WHEN contains(d, 'src/payments/charge.py') THEN 3 WHEN contains(d, 'payments') OR contains(d, 'charge.py') THEN 1 ELSE 0 END + round_even((contains(lower(d), 'the')::INT + contains(lower(d), 'charge')::INT + contains(lower(d), 'qqqq')::INT) / 3 * 4, 0)::INT
     + CASE WHEN contains(lower(d), CASE lang WHEN 'en' THEN 'infrastructure' ELSE 'config' END) THEN 2 ELSE 0 END + CASE WHEN contains(d, 'CONCLUSION') OR contains(d, 'ROOT CAUSE') THEN 1 ELSE 0 END AS score FROM c),
  s AS (SELECT *, CASE WHEN score >= 8 THEN 'CORRECT' WHEN score >= 5 THEN 'PARTIAL' WHEN score >= 3 THEN 'DIRECTION' ELSE 'WRONG' END AS grade FROM p)"""


@query("diagnose_scores", "DIA13", f"WITH {SQL_CASES} SELECT case_id, score::INTEGER AS score, grade FROM s")
def scores(spark, sf):
    return D.score_diagnoses(cases(spark, sf)).select("case_id", "score", "grade")


@query(
    "diagnose_accuracy",
    "DIA14",
    f"""WITH {SQL_CASES}, a AS (SELECT lang, count(*)::DOUBLE AS n, count(*) FILTER (grade = 'CORRECT') AS c, count(*) FILTER (grade IN ('CORRECT', 'PARTIAL')) AS u, count(*) FILTER (grade <> 'WRONG') AS d FROM s GROUP BY 1)
    SELECT lang, n::BIGINT AS cases, floor(c * 100 / n)::BIGINT AS strict, floor(u * 100 / n)::BIGINT AS useful, floor(d * 100 / n)::BIGINT AS category_accuracy,
    round((c / n + 3.8416 / (2 * n) - 1.96 * sqrt(c / n * (1 - c / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS wilson_low, round((c / n + 3.8416 / (2 * n) + 1.96 * sqrt(c / n * (1 - c / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS wilson_high FROM a""",
)
def accuracy(spark, sf):
    a = D.accuracy(D.score_diagnoses(cases(spark, sf)), "lang")
    return a.withColumns({c: F.round(c, 6) for c in ("wilson_low", "wilson_high")})


@query(
    "diagnose_validation_users",
    "DIA7 GRA5",
    f"""WITH {SQL_BODIES}, v AS (SELECT replace(name, 'red_', 'check_') AS name, file, lower(replace(body, 'red_', 'check_')) AS body FROM fb),
    e AS (SELECT DISTINCT a.name, a.file, b.name AS validator, b.file AS validator_file FROM v a JOIN v b ON contains(a.body, lower(b.name))
      WHERE regexp_matches(lower(b.name), 'validate|retry|guard|assert|check|sanitize|verify') AND NOT (a.name = b.name AND a.file = b.file))
    SELECT file, count(*) AS n FROM e GROUP BY 1""",
)
def validation_users(spark, sf):
    """Files whose functions use a validating function, from the bodies."""
    f = functions_with_bodies(spark, sf)
    f = f.withColumns({c: F.replace(F.col(c), F.lit("red_"), F.lit("check_")) for c in ("name", "body")})
    return G.validation_edges(f).groupBy("file").agg(F.count("*").alias("n"))
