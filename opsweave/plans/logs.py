"""Log queries over event-derived pod lines, journal lines and document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.functions.text import line_severity
from opsweave.operators import logs as L
from opsweave.plans.policy import SQL_EVENTS
from opsweave.plans.registry import query
from opsweave.sources import tables as T

SQL_LINES = f"""{SQL_EVENTS}, lines AS (SELECT 'ns' || user_id % 10 AS namespace, 'pod-' || user_id AS pod, t AS ts, event_id,
  CASE event_type WHEN 'error' THEN 'ERROR request ' || regexp_replace(md5(event_id::VARCHAR), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')
         || ' from 10.0.' || user_id || '.' || k || ':80 failed'
     WHEN 'click' THEN 'WARN slow click 0xab' || k || ' of svc-' || k || ' took ' || event_id
     WHEN 'purchase' THEN 'gateway of svc-' || k || ': connection refused, order ' || event_id
     WHEN 'view' THEN 'DEBUG healthz ok, error count ' || k
     ELSE CASE WHEN k < 50 THEN 'FATAL cannot create user-' || user_id ELSE 'signup done ' || k END END AS line FROM ev)"""
SQL_SEVERITY = r"""CASE WHEN line = '' OR strlen(line) > 8192 OR regexp_matches(line, '(^|[^\p{L}\p{N}_])(DEBUG|TRACE|healthz|readyz|livez)', 'i') THEN NULL
   WHEN regexp_matches(line, '(^|[^\p{L}\p{N}_])(FATAL|PANIC)($|[^\p{L}\p{N}_])') THEN 'FATAL'
   WHEN regexp_matches(line, '(^|[^\p{L}\p{N}_])(ERROR|ERR|Exception|Traceback)($|[^\p{L}\p{N}_])', 'i') THEN 'ERROR'
   WHEN regexp_matches(line, '(^|[^\p{L}\p{N}_])(WARN|WARNING)($|[^\p{L}\p{N}_])', 'i')
     OR regexp_matches(line, '(^|[^\p{L}\p{N}_])(OOMKilled|connection\s+refused|permission\s+denied|timeout|timed\s+out|segfault|5\d\d\s|no\s+such\s+file)', 'i') THEN 'WARN' END"""
SQL_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def sql_pod_template(col: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({col}, '{SQL_UUID}', '<UUID>', 'g'), "
        r"'\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(:\d+)?\b', '<IP>', 'g'), '\b0x[0-9a-fA-F]+\b', '<HEX>', 'g'), "
        r"'\b\d+\b', '<N>', 'g')"
    )


def sql_host_template(col: str) -> str:
    return (
        f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({col}, '{SQL_UUID}', '<UUID>', 'g'), "
        r"'\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', '<IP>', 'g'), "
        r"'\b0x[0-9a-fA-F]{8,}\b|\b[0-9a-fA-F]{9,}\b', '<HEX>', 'g'), '\b\d{4,}\b', '<NUM>', 'g')"
    )


SQL_RANK = "CASE severity WHEN 'FATAL' THEN 3 WHEN 'ERROR' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END"
SQL_BUCKETS = f"""{SQL_LINES}, sev AS (SELECT *, {SQL_SEVERITY} AS severity FROM lines),
  tpl AS (SELECT *, {sql_pod_template("line")} AS template_text FROM sev WHERE severity IS NOT NULL),
  hashed AS (SELECT *, left(sha256(template_text), 16) AS template_hash FROM tpl),
  buckets AS (SELECT namespace, pod, template_hash, min(template_text) AS template_text, count(*) AS count,
     min(ts) AS first_seen, max(ts) AS last_seen,
     CASE max({SQL_RANK}) WHEN 3 THEN 'FATAL' WHEN 2 THEN 'ERROR' ELSE 'WARN' END AS severity,
     list(line ORDER BY ts, event_id)[1:5] AS examples FROM hashed GROUP BY ALL)"""


def pod_buckets(spark, sf):
    return L.pod_buckets(T.pod_log_lines(spark, sf), ("ts", "event_id"))


@query(
    "log_severity_counts",
    "LOG1",
    f"""WITH {SQL_LINES}, s AS (SELECT namespace, coalesce({SQL_SEVERITY}, 'drop') AS severity FROM lines)
    SELECT namespace, severity, count(*) AS n FROM s GROUP BY ALL""",
)
def severity_counts(spark, sf):
    sev = F.coalesce(line_severity(F.col("line")), F.lit("drop"))
    return T.pod_log_lines(spark, sf).groupBy("namespace", sev.alias("severity")).agg(F.count("*").alias("n"))


@query(
    "log_document_line_severity",
    "LOG1",
    rf"""WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
    s AS (SELECT source, coalesce({SQL_SEVERITY}, 'drop') AS severity FROM lines)
    SELECT source, severity, count(*) AS n FROM s GROUP BY ALL""",
)
def document_line_severity(spark, sf):
    sev = F.coalesce(line_severity(F.col("line")), F.lit("drop"))
    lines = T.document_lines(spark, sf)
    return lines.groupBy(F.col("hostname").alias("source"), sev.alias("severity")).agg(F.count("*").alias("n"))


@query(
    "log_pod_buckets",
    "LOG1 LOG2 LOG4 LOG5",
    f"""WITH {SQL_BUCKETS} SELECT namespace, pod, template_hash, template_text, count, severity,
    epoch_us(make_timestamp((first_seen * 1000000)::BIGINT)) AS first_us, (last_seen * 1000000)::BIGINT AS last_us,
    array_to_string(examples, ' | ') AS examples FROM buckets""",
)
def log_pod_buckets(spark, sf):
    b = pod_buckets(spark, sf)
    return b.select(
        "namespace", "pod", "template_hash", "template_text", "count", "severity",
        F.round(F.col("first_seen") * 1_000_000).cast("long").alias("first_us"),
        F.round(F.col("last_seen") * 1_000_000).cast("long").alias("last_us"),
        F.array_join("examples", " | ").alias("examples"),
    )


SQL_HOST = rf"""dl AS (SELECT doc_id, source AS hostname, unnest(string_split(text, chr(10))) AS raw,
     generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
  host AS (SELECT doc_id, hostname, pos, trim(raw) AS line FROM dl WHERE trim(raw) <> ''),
  ht AS (SELECT *, {sql_host_template("line")} AS template_text FROM host),
  hh AS (SELECT *, left(sha256(template_text), 16) AS template_hash FROM ht)"""


@query(
    "log_host_templates",
    "LOG3 LOG4",
    f"WITH {SQL_HOST} SELECT template_hash, min(template_text) AS template_text, count(*) AS n FROM hh GROUP BY template_hash",
)
def host_templates(spark, sf):
    lines = L._host_templates(T.document_lines(spark, sf))
    return lines.groupBy("template_hash").agg(
        F.min("template_text").alias("template_text"), F.count("*").alias("n")
    )


SQL_KERNEL = rf"""{SQL_HOST}, kc AS (SELECT *, CASE
    WHEN regexp_matches(line, 'Out of memory|oom-kill|oom_reaper|invoked oom-killer', 'i') THEN 'oom'
    WHEN regexp_matches(line, 'I/O error|Buffer I/O error|blk_update_request', 'i') THEN 'io_error'
    WHEN regexp_matches(line, 'segfault|general protection fault', 'i') THEN 'segfault'
    WHEN regexp_matches(line, 'Hardware Error|MCE|mce:|GHES', 'i') THEN 'hardware'
    WHEN regexp_matches(line, 'nfs|NFSD|rpc_task', 'i') THEN 'nfs'
    WHEN regexp_matches(line, 'Kernel panic|BUG:', 'i') THEN 'panic' ELSE 'other' END AS category,
   CASE WHEN regexp_matches(lower(line), 'emerg|panic|bug:|oops') THEN 'FATAL'
    WHEN regexp_matches(lower(line), 'err|crit|alert|error') THEN 'ERROR' ELSE 'WARN' END AS sev FROM hh),
  kernel AS (SELECT hostname, template_hash, arg_min(category, (doc_id, pos)) AS category,
    arg_min(sev, (doc_id, pos)) AS severity, count(*) AS count, min(doc_id)::DOUBLE AS first_seen, max(doc_id)::DOUBLE AS last_seen,
    list(left(line, 300) ORDER BY doc_id, pos)[1:5] AS examples FROM kc GROUP BY ALL)"""


@query(
    "log_kernel_buckets",
    "LOG6",
    f"""WITH {SQL_KERNEL} SELECT hostname, template_hash, category, severity, count, first_seen, last_seen,
    array_to_string(examples, ' | ') AS examples FROM kernel""",
)
def kernel_buckets(spark, sf):
    b = L.kernel_buckets(T.document_lines(spark, sf), ("ts", "pos"))
    return b.select(
        "hostname", "template_hash", "category", "severity", "count", "first_seen", "last_seen",
        F.array_join("examples", " | ").alias("examples"),
    )


SQL_JOURNAL_LINES = f"""{SQL_LINES}, jl AS (SELECT namespace AS hostname, ts, event_id AS line_id,
    strftime(make_timestamp((ts * 1000000)::BIGINT), '%b %d %H:%M:%S') || ' ' || pod || '[' || event_id || ']: ' || line AS line FROM lines)"""
SQL_JOURNAL = rf"""{SQL_JOURNAL_LINES}, jt AS (SELECT *, {sql_host_template("line")} AS template_text FROM jl),
  jh AS (SELECT *, left(sha256(template_text), 16) AS template_hash, regexp_extract(line, '\S+\s+(\S+?)(?:\[\d+\])?:\s', 1) AS unit FROM jt),
  journal AS (SELECT hostname, template_hash, arg_min(unit, (ts, line_id)) AS unit, 'ERROR' AS severity, count(*) AS count,
    min(ts) AS first_seen, max(ts) AS last_seen FROM jh GROUP BY hostname, template_hash)"""


def journal(spark, sf):
    return L.journal_buckets(T.journal_lines(spark, sf), ("ts", "line_id"))


@query("log_journal_buckets", "LOG7", f"WITH {SQL_JOURNAL} SELECT hostname, template_hash, unit, severity, count FROM journal")
def journal_buckets(spark, sf):
    return journal(spark, sf).select("hostname", "template_hash", "unit", "severity", "count")


@query(
    "log_merge_history",
    "LOG8 SNK1",
    f"""WITH {SQL_BUCKETS}, per AS (SELECT namespace, template_hash, date_trunc('month', make_timestamp((ts * 1000000)::BIGINT) + INTERVAL 16 DAY) AS half, ts FROM hashed),
    h AS (SELECT namespace, template_hash, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS count FROM per WHERE half = TIMESTAMP '2024-01-01' GROUP BY ALL),
    n AS (SELECT namespace, template_hash, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS count FROM per WHERE half <> TIMESTAMP '2024-01-01' GROUP BY ALL)
    SELECT coalesce(h.namespace, n.namespace) AS namespace, coalesce(h.template_hash, n.template_hash) AS template_hash,
      round(coalesce(h.first_seen, n.first_seen), 3) AS first_seen, round(coalesce(n.last_seen, h.last_seen), 3) AS last_seen, coalesce(n.count, h.count) AS count
    FROM h FULL JOIN n ON h.namespace = n.namespace AND h.template_hash = n.template_hash""",
)
def merge_history(spark, sf):
    lines = L.classify_pod_lines(T.pod_log_lines(spark, sf))
    keys = ["namespace", "template_hash"]

    def half(df):
        return df.groupBy(*keys).agg(
            F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("count")
        )

    cut = 1705363200  # 2024-01-16: history before, fresh lines after
    merged = L.merge_buckets(half(lines.where(f"ts < {cut}")), half(lines.where(f"ts >= {cut}")), keys)
    return merged.select(*keys, F.round("first_seen", 3).alias("first_seen"), F.round("last_seen", 3).alias("last_seen"), "count")


SQL_MENTIONS = f"""{SQL_BUCKETS}, ent AS (SELECT DISTINCT 'ns' || user_id % 10 AS namespace, 'Service' AS label, 'svc-' || k AS name FROM ev
     UNION SELECT DISTINCT 'ns' || user_id % 10, 'Secret', 'user-' || user_id FROM ev),
  men AS (SELECT b.namespace, b.pod, b.template_hash, e.label, e.name FROM buckets b JOIN ent e
     ON b.namespace = e.namespace AND contains(b.template_text || ' ' || b.examples[1], e.name))"""


def entity_names(spark, sf):
    e = T.events(spark, sf)
    ns = F.concat(F.lit("ns"), (F.col("user_id") % 10).cast("string")).alias("namespace")
    svc = e.select(ns, F.lit("Service").alias("label"), F.concat(F.lit("svc-"), F.col("k").cast("string")).alias("name"))
    sec = e.select(ns, F.lit("Secret").alias("label"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("name"))
    return svc.unionByName(sec).distinct()


@query("log_mentions", "LOG9 REL5", f"WITH {SQL_MENTIONS} SELECT * FROM men")
def log_mentions(spark, sf):
    return L.mentions(pod_buckets(spark, sf), entity_names(spark, sf))


@query(
    "log_top_mentions",
    "LOG14",
    f"""WITH {SQL_MENTIONS} SELECT label, name, namespace, count(DISTINCT (pod, template_hash)) AS events FROM men
    GROUP BY ALL ORDER BY events DESC, label, name, namespace LIMIT 20""",
)
def top_mentions(spark, sf):
    return L.most_mentioned(L.mentions(pod_buckets(spark, sf), entity_names(spark, sf)))


@query(
    "log_emitted_edges",
    "LOG10 REL4",
    f"""WITH {SQL_BUCKETS}, pods AS (SELECT DISTINCT 'ns' || user_id % 10 AS namespace, 'pod-' || user_id AS pod FROM ev)
    SELECT namespace, pod, template_hash FROM buckets JOIN pods USING (namespace, pod)""",
)
def emitted_edges(spark, sf):
    e = T.events(spark, sf)
    pods = e.select(
        F.concat(F.lit("ns"), (F.col("user_id") % 10).cast("string")).alias("namespace"),
        F.concat(F.lit("pod-"), F.col("user_id").cast("string")).alias("name"),
    ).distinct()
    return L.emitted(pods, pod_buckets(spark, sf))


SINCE = 1706140800.0  # five days before the newest event


@query(
    "log_pod_story",
    "LOG11 REL1 REL2 REL3 REL13 REL18",
    f"""WITH {SQL_BUCKETS} SELECT namespace, pod, template_hash, severity, count FROM buckets
    WHERE last_seen >= {SINCE} AND severity IN ('ERROR', 'FATAL')
    ORDER BY {SQL_RANK} DESC, count DESC, namespace, pod, template_hash LIMIT 15""",
)
def pod_story(spark, sf):
    b = L.in_scope(pod_buckets(spark, sf), "ERROR", SINCE, pod=None)
    top = L.worst_first(b, ["namespace", "pod", "template_hash"])
    return top.select("namespace", "pod", "template_hash", "severity", "count")


@query(
    "log_severity_histogram",
    "LOG12 REL11",
    f"""WITH {SQL_BUCKETS} SELECT severity, count(*) AS templates, sum(count)::BIGINT AS occurrences, count(DISTINCT pod) AS who
    FROM buckets GROUP BY severity""",
)
def severity_histogram(spark, sf):
    return L.severity_histogram(L.in_scope(pod_buckets(spark, sf)), "pod")


@query(
    "log_window_hint",
    "LOG13",
    f"""WITH {SQL_BUCKETS}, r AS (SELECT count(*) AS events, min(last_seen) AS o, max(last_seen) AS n FROM buckets WHERE severity IN ('ERROR', 'FATAL'))
    SELECT events, floor((1706745600 - o) / 60)::BIGINT AS oldest_minutes_ago, floor((1706745600 - n) / 60)::BIGINT AS newest_minutes_ago,
    floor((1706745600 - n) / 60)::BIGINT + 10 AS suggested_minutes FROM r""",
)
def window_hint(spark, sf):
    return L.window_hint(pod_buckets(spark, sf), 1706745600).drop("oldest", "newest")


@query(
    "log_tombstones",
    "LOG15",
    f"""WITH {SQL_EVENTS}, d AS (SELECT user_id, max(t) FILTER (event_type = 'purchase') AS da FROM ev GROUP BY user_id)
    SELECT user_id, CASE WHEN da IS NULL THEN '' WHEN floor((1706659200 - da) / 60) > 0
      THEN 'pod deleted ' || floor((1706659200 - da) / 60)::BIGINT || 'm ago' ELSE 'pod just deleted' END AS tombstone FROM d""",
)
def tombstones(spark, sf):
    e = T.events(spark, sf)
    d = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("t"))).alias("da"))
    return d.select("user_id", L.tombstone(F.col("da"), 1706659200).alias("tombstone"))


@query(
    "log_host_story",
    "LOG16 REL14",
    f"""WITH {SQL_JOURNAL}, {SQL_KERNEL}, h AS (
      SELECT severity, count(*) AS templates, sum(count)::BIGINT AS occurrences, count(DISTINCT hostname) AS who FROM journal GROUP BY severity
      UNION ALL SELECT severity, count(*), sum(count)::BIGINT, count(DISTINCT hostname) FROM kernel GROUP BY severity)
    SELECT sum(templates)::BIGINT AS templates, sum(occurrences)::BIGINT AS occurrences, max(who) AS who FROM h""",
)
def host_story(spark, sf):
    kernel = L.kernel_buckets(T.document_lines(spark, sf), ("ts", "pos"))
    return L.host_story(journal(spark, sf), kernel)["totals"]


def host_tables(spark, sf):
    """Hosts from the users of the events: disks per type, units per k, processes per event."""
    e = T.events(spark, sf).withColumn("hostname", F.concat(F.lit("host-"), F.col("user_id").cast("string")))
    hosts = e.groupBy("hostname").agg(
        F.count("*").cast("int").alias("cpu_count"),
        (F.max("k") * 7201).alias("uptime_seconds"),
        F.sum("k").alias("memory_total_mb"),
        F.sum(F.least(F.col("k"), F.lit(60))).alias("memory_used_mb"),
    )
    disks = e.groupBy("hostname", F.col("event_type").alias("mountpoint")).agg(F.max("k").alias("percent"))
    units = e.select(
        "hostname", F.concat(F.lit("unit-"), F.col("k").cast("string")).alias("name"),
        F.when(F.col("event_type") == "error", "failed").otherwise("active").alias("active_state"),
    )
    procs = e.select("hostname", F.col("event_id").alias("pid"), F.col("event_type").alias("name"),
                     F.col("value").alias("memory_mb"), F.col("k").alias("cpu"))
    return hosts, disks, units, procs


SQL_HOSTS = f"""{SQL_EVENTS}, hv AS (SELECT *, 'host-' || user_id AS hostname FROM ev)"""


@query(
    "log_host_state",
    "LOG17",
    f"""WITH {SQL_HOSTS},
    h AS (SELECT hostname, max(k) * 7201 AS up, sum(k) AS tot, sum(least(k, 60)) AS used FROM hv GROUP BY 1),
    d AS (SELECT hostname, event_type AS m, max(k) AS p FROM hv GROUP BY 1, 2),
    dl AS (SELECT hostname, string_agg(m || ' ' || p || CASE WHEN p > 90 THEN ' !!' ELSE '' END, ',' ORDER BY p DESC, m DESC) AS disks FROM d GROUP BY 1),
    u AS (SELECT hostname, string_agg(DISTINCT 'unit-' || k, ',' ORDER BY 'unit-' || k) AS failed_units FROM hv WHERE event_type = 'error' GROUP BY 1),
    p AS (SELECT hostname, event_id, value, row_number() OVER (PARTITION BY hostname ORDER BY value DESC, event_id) AS rn FROM hv),
    pl AS (SELECT hostname, string_agg(event_id::VARCHAR, ',' ORDER BY rn) AS top_pids FROM p WHERE rn <= 10 GROUP BY 1)
    SELECT hostname, up // 86400 || 'd ' || up % 86400 // 3600 || 'h' AS uptime, CASE WHEN tot > 0 THEN round(used / tot * 100, 1) END AS memory_percent, disks, coalesce(failed_units, '') AS failed_units, top_pids
    FROM h JOIN dl USING (hostname) JOIN pl USING (hostname) LEFT JOIN u USING (hostname)""",
)
def host_state(spark, sf):
    s = L.host_state(*host_tables(spark, sf))
    mark = F.transform(
        "disks",
        lambda x: F.concat(x["mountpoint"], F.lit(" "), x["percent"].cast("string"), F.when(x["warn"], " !!").otherwise("")),
    )
    return s.select(
        "hostname", "uptime", "memory_percent", F.array_join(mark, ",").alias("disks"),
        F.coalesce(F.array_join("failed_units", ","), F.lit("")).alias("failed_units"),
        F.array_join("top_pids", ",").alias("top_pids"),
    )


@query(
    "log_terminal_story",
    "LOG18",
    f"""WITH {SQL_JOURNAL} SELECT hostname, template_hash, unit, count FROM journal
    QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY count DESC, template_hash) <= 15""",
)
def terminal_story(spark, sf):
    return L.terminal_story(journal(spark, sf)).select("hostname", "template_hash", "unit", "count")


SQL_WORDS = "deadline exceeded|timed out|i/o timeout|connection reset|connection refused|unreachable|failed|error|panic|oom|killed|segfault|denied|refused|503|502|no route|network is unreachable|broken pipe"
SQL_FAIL = rf"""{SQL_JOURNAL_LINES}, jf AS (SELECT *, regexp_matches(lower(line), '{SQL_WORDS}') AS bad,
    regexp_replace(string_split(string_split_regex(line, '\s+')[4], '[')[1], ':+$', '') AS unit, left(line, 15) AS time, left(line, 12) AS minute FROM jl)"""


@query(
    "log_postmortem_services",
    "LOG19",
    f"""WITH {SQL_FAIL} SELECT unit, count(*) AS error_count, arg_min(time, (ts, line_id)) AS first_error, arg_max(time, (ts, line_id)) AS last_error,
      array_to_string(list(line ORDER BY ts, line_id)[1:5], ' | ') AS sample_lines FROM jf WHERE bad GROUP BY unit ORDER BY error_count DESC, unit LIMIT 20""",
)
def postmortem_services(spark, sf):
    s = L.postmortem_services(T.journal_lines(spark, sf))
    return s.withColumn("sample_lines", F.array_join("sample_lines", " | "))


@query("log_postmortem_timeline", "LOG19", f"WITH {SQL_FAIL} SELECT minute, count(*) AS errors FROM jf WHERE bad GROUP BY minute")
def postmortem_timeline(spark, sf):
    return L.postmortem_timeline(T.journal_lines(spark, sf))


@query(
    "log_postmortem_summary",
    "LOG19",
    f"""WITH {SQL_FAIL} SELECT count(*) AS total_lines, count(*) FILTER (bad) AS error_lines, count(DISTINCT unit) FILTER (bad) AS services,
    round(count(*) FILTER (bad) / count(*) * 100, 6) AS error_rate_pct FROM jf""",
)
def postmortem_summary(spark, sf):
    s = L.postmortem_summary(T.journal_lines(spark, sf))
    return s.withColumn("error_rate_pct", F.round("error_rate_pct", 6))


@query(
    "log_probable_cause",
    "LOG19",
    f"""WITH {SQL_FAIL}, s AS (SELECT unit, min(ts) AS f, arg_min(time, (ts, line_id)) AS ft, arg_min(line, (ts, line_id)) AS l, count(*) AS n FROM jf WHERE bad GROUP BY unit)
    SELECT unit AS service, ft AS first_error_time, n AS total_errors, left(l, 120) AS first_error_line FROM s ORDER BY f, n DESC, unit LIMIT 1""",
)
def probable_cause(spark, sf):
    return L.probable_cause(T.journal_lines(spark, sf))


@query(
    "log_service_error_rate",
    "LOG20",
    f"""WITH {SQL_LINES}, b AS (SELECT floor(ts / 3600 / 10)::BIGINT AS minute FROM lines
        WHERE regexp_matches(lower(line), 'error|fatal|panic|failed|connection refused|name resolution|timeout') AND NOT regexp_matches(lower(line), 'no error|error=0|error_count=0')),
    w AS (SELECT minute + unnest(range(10)) AS end_minute FROM b)
    SELECT 'all' AS service, end_minute, count(*) AS errors, CASE WHEN count(*) > 30 THEN 'critical' ELSE 'warning' END AS severity
    FROM w GROUP BY end_minute HAVING count(*) > 10""",
)
def service_error_rate(spark, sf):
    # the events are sparse: ten real hours stand for one minute
    lines = T.pod_log_lines(spark, sf).select(F.lit("all").alias("service"), (F.col("ts") / 600).alias("ts"), "line")
    return L.service_error_rate(lines, ["service"])


@query(
    "log_kernel_findings",
    "LOG21",
    f"""WITH {SQL_EVENTS}, ke AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'process_exec' WHEN 'click' THEN 'network_connect' WHEN 'error' THEN 'fd_pressure' ELSE 'oomkill' END AS probe,
      'cmd' || user_id AS comm, CASE WHEN k < 2 THEN 'critical' WHEN k < 5 THEN 'high' WHEN k < 9 THEN 'warning' WHEN k > 95 THEN 'ignore' ELSE 'info' END AS severity,
      CASE WHEN k % 2 = 0 THEN 'c' || k END AS container_id FROM ev),
    g AS (SELECT probe, comm, count(*) AS count, max(CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS r,
       (list(container_id ORDER BY event_id))[1] AS c, array_to_string(list(event_id ORDER BY event_id)[1:5], ',') AS samples FROM ke WHERE severity <> 'ignore' GROUP BY ALL),
    s AS (SELECT *, CASE WHEN r = 3 THEN 'critical' WHEN r = 2 THEN 'high' WHEN r = 1 OR count > 10 THEN 'warning' ELSE 'info' END AS severity FROM g)
    SELECT 'kernel_' || probe || '_' || comm AS key, probe, comm, CASE probe WHEN 'process_exec' THEN 'process' WHEN 'network_connect' THEN 'network' WHEN 'fd_pressure' THEN 'system' ELSE 'kernel' END AS category,
    severity, count, samples FROM s WHERE NOT (severity = 'info' AND c IS NULL AND count <= 3)""",
)
def kernel_findings(spark, sf):
    e, t, k = T.events(spark, sf), F.col("event_type"), F.col("k")
    ke = e.select(
        "event_id",
        F.when(t == "view", "process_exec").when(t == "click", "network_connect")
        .when(t == "error", "fd_pressure").otherwise("oomkill").alias("probe"),
        F.concat(F.lit("cmd"), F.col("user_id").cast("string")).alias("comm"),
        F.when(k < 2, "critical").when(k < 5, "high").when(k < 9, "warning").when(k > 95, "ignore")
        .otherwise("info").alias("severity"),
        F.when(k % 2 == 0, F.concat(F.lit("c"), k.cast("string"))).alias("container_id"),
    )
    return L.kernel_findings(ke).withColumn("samples", F.array_join(F.col("samples").cast("array<string>"), ","))


@query(
    "log_ssh_brute_force",
    "LOG22 REL12",
    f"""WITH {SQL_EVENTS}, l AS (SELECT 'host-' || user_id % 10 AS hostname, 'Failed password for root from 10.1.0.' || k // 3 || ' port ' || event_id || ' ssh2' AS line FROM ev)
    SELECT hostname, regexp_extract(line, 'from\\s+(\\S+)\\s+port', 1) AS source_ip, count(*) AS attempts FROM l GROUP BY ALL HAVING count(*) > 10""",
)
def ssh_brute_force(spark, sf):
    e = T.events(spark, sf)
    lines = e.select(
        F.concat(F.lit("host-"), (F.col("user_id") % 10).cast("string")).alias("hostname"),
        F.concat(
            F.lit("Failed password for root from 10.1.0."), F.floor(F.col("k") / 3).cast("string"),
            F.lit(" port "), F.col("event_id").cast("string"), F.lit(" ssh2"),
        ).alias("line"),
    )
    return L.ssh_brute_force(lines)


@query(
    "log_self_checks",
    "LOG23",
    f"""WITH {SQL_HOSTS}, m AS (SELECT hostname, user_id, sum(k) AS s, max(k) AS mx, min(k) AS mn, count(*) AS n FROM hv GROUP BY 1, 2)
    SELECT hostname, 'wifi' AS source, 'wifi-discard-high' AS key, 'WARN' AS severity, s::DOUBLE AS value FROM m WHERE s > 1000
    UNION ALL SELECT hostname, 'wifi', 'wifi-signal-weak', 'WARN', -mx FROM m WHERE -mx < -75 AND -mx > -256
    UNION ALL SELECT hostname, 'disk_io', 'diskio-high-sda', 'WARN', s * 4 FROM m WHERE s * 4 > 10000
    UNION ALL SELECT hostname, 'dns', 'dns-slow-1.1.1.1', 'WARN', n * 8 - 5 FROM m WHERE n * 8 - 5 > 500 OR n * 8 - 5 < 0
    UNION ALL SELECT hostname, 'tls', 'tls-expiry-443', 'WARN', mn - 1 FROM m WHERE mn - 1 BETWEEN 0 AND 29
    UNION ALL SELECT hostname, 'ntp', 'ntp-drift', 'WARN', mn - 1 FROM m WHERE mx < 99 OR abs(mn - 1) > 1
    UNION ALL SELECT hostname, 'updates', 'security-updates-pending', 'WARN', mn FROM m WHERE mn > 0
    UNION ALL SELECT hostname, 'hardware', 'hw-health-flag', 'WARN', mx FROM m WHERE mx > 80 OR n > 70""",
)
def self_checks(spark, sf):
    e = T.events(spark, sf).withColumn("hostname", F.concat(F.lit("host-"), F.col("user_id").cast("string")))
    m = e.groupBy("hostname").agg(
        F.sum("k").alias("s"), F.max("k").alias("mx"), F.min("k").alias("mn"), F.count("*").alias("n")
    )
    c = F.col
    return L.self_checks(
        {
            "wifi": m.select("hostname", c("s").alias("discarded"), (-c("mx")).alias("signal_dbm")),
            "disk_io": m.select("hostname", F.lit("sda").alias("device"), (c("s") * 4).alias("weighted_io_ms")),
            "dns": m.select("hostname", F.lit("1.1.1.1").alias("resolver"), (c("n") * 8 - 5).alias("response_ms")),
            "tls": m.select("hostname", F.lit(443).alias("port"), (c("mn") - 1).alias("days_remaining")),
            "ntp": m.select("hostname", (c("mx") >= 99).alias("synchronized"), (c("mn") - 1).alias("offset_seconds")),
            "updates": m.select("hostname", c("mn").alias("security_pending")),
            "hardware": m.select("hostname", c("mx").alias("max_temp"), F.when(c("n") > 70, "FAILED").otherwise("PASSED").alias("smart_status")),
        }
    )
