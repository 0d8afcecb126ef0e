"""Log intelligence: templates, buckets, stories, timelines, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.functions.ordered import top_k
from opsweave.functions.text import (
    HOST_MASKS,
    POD_MASKS,
    any_of,
    contains_join,
    line_severity,
    masked,
    severity_name,
    severity_rank,
    short_hash,
)

EXAMPLES = 5


def _buckets(
    lines: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    first_cols: Sequence[str] = (),
    example: Column | None = None,
) -> DataFrame:
    """Count, first/last seen, highest severity, columns of the first line, and the
    first five examples. Both branches trim or combine before their shuffle.

    Lines without a key are left out. Every other bucket has an example, so the outer join drops nothing; as its right
    side has one row per key, Spark leaves out that branch where a caller doesn't read the examples."""
    keys, order = list(keys), list(order)
    lines = lines.dropna(subset=keys)
    first = F.struct(*order)
    agg = lines.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        severity_name(F.max(severity_rank(F.col("severity")))).alias("severity"),
        *[F.min_by(c, first).alias(c) for c in first_cols],
    )
    shown = lines.withColumn("_line", example if example is not None else F.col("line"))
    firsts = top_k(shown, keys, [F.col(c) for c in order], EXAMPLES)
    examples = firsts.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(*order, "_line"))), lambda x: x["_line"]
        ).alias("examples")
    )
    return agg.join(examples, keys, "left")


def classify_pod_lines(lines: DataFrame) -> DataFrame:
    """Significant lines of ``(namespace, pod, ts, …, line)`` with severity and template.

    The severity comes out of an array: a filter on it would be moved below it, and all its patterns be tried
    twice, on a line made anew for each."""
    kept = lines.withColumn("severity", F.explode(F.array_compact(F.array(line_severity(F.col("line"))))))
    templated = kept.withColumn("template_text", masked(F.col("line"), POD_MASKS))
    return templated.withColumn("template_hash", short_hash(F.col("template_text")))


def pod_buckets(lines: DataFrame, order: Sequence[str] = ("ts", "line")) -> DataFrame:
    return _buckets(
        classify_pod_lines(lines),
        ["namespace", "pod", "template_hash"],
        order,
        first_cols=["template_text"],
    )


# Kernel line categories (first match) and severity words.
KERNEL_CATEGORIES = (
    ("oom", ("out of memory", "oom-kill", "oom_reaper", "invoked oom-killer")),
    ("io_error", ("i/o error", "buffer i/o error", "blk_update_request")),
    ("segfault", ("segfault", "general protection fault")),
    ("hardware", ("hardware error", "mce", "mce:", "ghes")),
    ("nfs", ("nfs", "nfsd", "rpc_task")),
    ("panic", ("kernel panic", "bug:")),
)
KERNEL_FATAL = ("emerg", "panic", "bug:", "oops")
KERNEL_ERROR = ("err", "crit", "alert", "error")


def _host_templates(lines: DataFrame) -> DataFrame:
    trimmed = lines.withColumn("line", F.trim("line")).where("line <> ''")
    templated = trimmed.withColumn("template_text", masked(F.col("line"), HOST_MASKS))
    return templated.withColumn("template_hash", short_hash(F.col("template_text")))


def kernel_buckets(lines: DataFrame, order: Sequence[str] = ("ts", "line")) -> DataFrame:
    """Buckets per (hostname, template); category and severity of the first line."""
    low = F.lower("line")
    category = F.lit("other")
    for label, words in reversed(KERNEL_CATEGORIES):
        category = F.when(any_of(low, words), label).otherwise(category)
    severity = (
        F.when(any_of(low, KERNEL_FATAL), "FATAL").when(any_of(low, KERNEL_ERROR), "ERROR").otherwise("WARN")
    )
    t = _host_templates(lines).withColumns({"category": category, "severity": severity, "_sev": severity})
    b = _buckets(
        t, ["hostname", "template_hash"], order, ["template_text", "category", "_sev"],
        F.substring("line", 1, 300),
    )
    return b.withColumn("severity", F.col("_sev")).drop("_sev")


def journal_buckets(lines: DataFrame, order: Sequence[str] = ("ts", "line")) -> DataFrame:
    """Buckets of error lines per (hostname, template) with the unit of the first line."""
    t = _host_templates(lines).where("not startswith(line, '--')")
    unit = F.regexp_extract("line", r"(?U)\S+\s+(\S+?)(?:\[\d+\])?:\s", 1)
    t = t.withColumns({"unit": unit, "severity": F.lit("ERROR")})
    return _buckets(
        t, ["hostname", "template_hash"], order, ["template_text", "unit"], F.substring("line", 1, 300)
    )


def merge_buckets(history: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New values overwrite, ``first_seen`` stays when it is already set."""
    keys = list(keys)
    rest = [c for c in fresh.columns if c not in keys and c != "first_seen"]
    h, n = history.alias("h"), fresh.alias("n")
    joined = h.join(n, keys, "full_outer")
    kept = F.when(F.col("h.first_seen") != 0, F.col("h.first_seen"))
    return joined.select(
        *keys,
        F.coalesce(kept, F.col("n.first_seen")).alias("first_seen"),
        *[F.coalesce(f"n.{c}", f"h.{c}").alias(c) for c in rest],
    )


def mentions(buckets: DataFrame, entities: DataFrame) -> DataFrame:
    """Buckets whose template or first example names an entity of their namespace.

    ``entities(namespace, label, name)``; names under four characters never count.
    """
    scan = F.concat_ws(" ", "template_text", F.get("examples", F.lit(0)))
    texts = buckets.select("namespace", "pod", "template_hash", scan.alias("_scan"))
    hits = contains_join(texts, "_scan", entities, "name", on=["namespace"])
    return hits.select("namespace", "pod", "template_hash", "label", "name").distinct()


def emitted(pods: DataFrame, buckets: DataFrame) -> DataFrame:
    """Edges pod -> bucket for pods of the inventory."""
    return pods.select("namespace", F.col("name").alias("pod")).join(
        buckets.select("namespace", "pod", "template_hash"), ["namespace", "pod"]
    )


# --- stories ------------------------------------------------------------------------


def in_scope(
    buckets: DataFrame,
    min_severity: str = "WARN",
    since: float | None = None,
    **equals: str | None,
) -> DataFrame:
    """Optional filters are added only when given."""
    ranks = {"INFO": 0, "WARN": 1, "ERROR": 2, "FATAL": 3}
    out = buckets.where(severity_rank(F.col("severity")) >= ranks.get(min_severity.upper(), 0))
    if since is not None:
        out = out.where(F.col("last_seen") >= since)
    for col, value in equals.items():
        if value is not None:
            out = out.where(F.col(col) == value)
    return out


def worst_first(buckets: DataFrame, tie: Sequence[str], k: int = 15) -> DataFrame:
    rank = severity_rank(F.col("severity"))
    return buckets.orderBy(rank.desc(), F.desc("count"), *tie).limit(k)


def severity_histogram(buckets: DataFrame, who: str) -> DataFrame:
    return buckets.groupBy("severity").agg(
        F.count("*").alias("templates"),
        F.sum("count").alias("occurrences"),
        F.countDistinct(who).alias("who"),
    )


def story_totals(histogram: DataFrame) -> DataFrame:
    """Totals; the number of pods or hosts is the highest of the severities."""
    return histogram.agg(
        F.sum("templates").alias("templates"),
        F.sum("occurrences").alias("occurrences"),
        F.max("who").alias("who"),
    )


def host_story(journal: DataFrame, kernel: DataFrame, k: int = 15) -> dict[str, DataFrame]:
    """Top rows and histogram of both bucket tables and the combined totals."""
    parts = {}
    for name, b in (("journal", journal), ("kernel", kernel)):
        parts[f"{name}_top"] = worst_first(b, ["hostname", "template_hash"], k)
        parts[f"{name}_histogram"] = severity_histogram(b, "hostname")
    per = parts["journal_histogram"].unionByName(parts["kernel_histogram"])
    parts["totals"] = story_totals(per)
    return parts


def window_hint(buckets: DataFrame, now: float) -> DataFrame:
    """When a window is empty: where the ERROR/FATAL events are, and a window that works."""
    ago = {n: F.floor((F.lit(float(now)) - F.col(c)) / 60).cast("long") for n, c in
           (("oldest_minutes_ago", "oldest"), ("newest_minutes_ago", "newest"))}
    r = buckets.where(F.col("severity").isin("ERROR", "FATAL")).agg(
        F.count("*").alias("events"), F.min("last_seen").alias("oldest"), F.max("last_seen").alias("newest")
    )
    return r.withColumns(ago).withColumn("suggested_minutes", F.col("newest_minutes_ago") + 10)


def most_mentioned(mention_rows: DataFrame, k: int = 20) -> DataFrame:
    counted = mention_rows.groupBy("label", "name", "namespace").agg(
        F.count_distinct("pod", "template_hash").alias("events")
    )
    return counted.orderBy(F.desc("events"), "label", "name", "namespace").limit(k)


def tombstone(deleted_at: Column, now: float) -> Column:
    minutes = F.floor((F.lit(float(now)) - deleted_at) / 60).cast("long")
    return F.when(deleted_at.isNull(), "").when(
        minutes > 0, F.concat(F.lit("pod deleted "), minutes.cast("string"), F.lit("m ago"))
    ).otherwise("pod just deleted")


def host_state(
    hosts: DataFrame, disks: DataFrame, units: DataFrame, processes: DataFrame, k: int = 10
) -> DataFrame:
    """One row per host with uptime text, memory percent and three nested lists."""
    disk = disks.groupBy("hostname").agg(
        F.sort_array(
            F.collect_list(
                F.struct("percent", "mountpoint", (F.col("percent") > 90).alias("warn"))
            ),
            asc=False,
        ).alias("disks")
    )  # a host has few mount points
    failed = units.where("active_state = 'failed'").groupBy("hostname").agg(
        F.array_sort(F.collect_set("name")).alias("failed_units")
    )
    top = top_k(processes, ["hostname"], [F.desc("memory_mb"), F.col("pid")], k)
    procs = top.groupBy("hostname").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("memory_mb")).alias("m"), "pid", "name"))),
            lambda x: x["pid"],
        ).alias("top_pids")
    )
    up = F.col("uptime_seconds")
    out = hosts.withColumns(
        {
            "uptime": F.concat(
                F.floor(up / 86400).cast("string"), F.lit("d "),
                F.floor(up % 86400 / 3600).cast("string"), F.lit("h"),
            ),
            "memory_percent": F.when(
                F.col("memory_total_mb") > 0,
                F.round(F.col("memory_used_mb") / F.col("memory_total_mb") * 100, 1),
            ),
        }
    )
    for part in (disk, failed, procs):
        out = out.join(part, "hostname", "left")
    return out


def terminal_story(journal: DataFrame, k: int = 15) -> DataFrame:
    """Top buckets by count for every host."""
    return top_k(journal, ["hostname"], [F.desc("count"), F.col("template_hash")], k)


# --- timelines and rates --------------------------------------------------------------

# Words that mark a failing line.
FAILURE_WORDS = (
    "deadline exceeded", "timed out", "i/o timeout", "connection reset",
    "connection refused", "unreachable", "failed", "error", "panic",
    "oom", "killed", "segfault", "denied", "refused", "503", "502",
    "no route", "network is unreachable", "broken pipe",
)
RATE_WORDS = (
    "error", "fatal", "panic", "failed", "connection refused", "name resolution", "timeout",
)
RATE_NEGATIVES = ("no error", "error=0", "error_count=0")


def journal_fields(lines: DataFrame) -> DataFrame:
    """Unit, time (15 characters) and minute (12) of short-format journal lines."""
    word = F.get(F.split(F.trim("line"), r"\s+"), F.lit(3))
    unit = F.regexp_replace(F.split(F.coalesce(word, F.lit("unknown")), r"\[")[0], ":+$", "")
    return lines.withColumns(
        {"unit": unit, "time": F.substring("line", 1, 15), "minute": F.substring("line", 1, 12)}
    )


def failing_lines(lines: DataFrame) -> DataFrame:
    return journal_fields(lines).where(any_of(F.lower("line"), FAILURE_WORDS))


def postmortem_services(lines: DataFrame, k: int = 20) -> DataFrame:
    """Failing lines per unit: count, first and last time, five samples."""
    bad = failing_lines(lines)
    order = F.struct("ts", "line_id")
    per = bad.groupBy("unit").agg(
        F.count("*").alias("error_count"),
        F.min_by("time", order).alias("first_error"),
        F.max_by("time", order).alias("last_error"),
    )
    worst = per.orderBy(F.desc("error_count"), "unit").limit(k)
    sample = top_k(bad, ["unit"], [F.col("ts"), F.col("line_id")], EXAMPLES).groupBy("unit").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ts", "line_id", "line"))), lambda x: x["line"]
        ).alias("sample_lines")
    )
    return worst.join(sample, "unit")


def postmortem_timeline(lines: DataFrame) -> DataFrame:
    return failing_lines(lines).groupBy("minute").agg(F.count("*").alias("errors"))


def postmortem_summary(lines: DataFrame) -> DataFrame:
    bad = any_of(F.lower("line"), FAILURE_WORDS)
    f = journal_fields(lines)
    return f.agg(
        F.count("*").alias("total_lines"),
        F.count_if(bad).alias("error_lines"),
        F.countDistinct(F.when(bad, F.col("unit"))).alias("services"),
    ).withColumn("error_rate_pct", F.col("error_lines") / F.col("total_lines") * 100)


def probable_cause(lines: DataFrame) -> DataFrame:
    """The service that failed first (most errors on a tie)."""
    per = failing_lines(lines).groupBy("unit").agg(
        F.min("ts").alias("first_ts"),
        F.min_by("time", F.struct("ts", "line_id")).alias("first_error_time"),
        F.min_by("line", F.struct("ts", "line_id")).alias("line"),
        F.count("*").alias("total_errors"),
    )
    first = per.orderBy("first_ts", F.desc("total_errors"), "unit").limit(1)
    return first.select(
        F.col("unit").alias("service"), "first_error_time", "total_errors",
        F.substring("line", 1, 120).alias("first_error_line"),
    )


def service_error_rate(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Error lines per service in ten-minute windows sliding by one minute."""
    low = F.lower("line")
    bad = lines.where(any_of(low, RATE_WORDS) & ~any_of(low, RATE_NEGATIVES))
    minute = bad.groupBy(*keys, F.floor(F.col("ts") / 60).cast("long").alias("minute")).agg(
        F.count("*").alias("n")
    )  # combine first: ten copies of a minute's count, not of its lines
    spread = minute.withColumn("end_minute", F.explode(F.sequence("minute", F.col("minute") + 9)))
    per = spread.groupBy(*keys, "end_minute").agg(F.sum("n").alias("errors"))
    return per.where("errors > 10").withColumn(
        "severity", F.when(F.col("errors") > 30, "critical").otherwise("warning")
    )


def kernel_findings(events: DataFrame) -> DataFrame:
    """Kernel events grouped by probe and command; boring groups dropped.

    ``events(event_id, probe, comm, severity, container_id)``.
    """
    rank = (
        F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "high", 2)
        .when(F.col("severity") == "warning", 1).otherwise(0)
    )
    comm = F.when(F.col("comm") == "", "unknown").otherwise(F.col("comm"))
    live = events.where("severity <> 'ignore'").withColumn("comm", comm)
    per = live.groupBy("probe", "comm").agg(
        F.count("*").alias("count"),
        F.max(rank).alias("_rank"),
        F.min_by(
            F.struct(F.col("container_id").alias("c")), "event_id"
        )["c"].alias("container_id"),
    )
    severity = (
        F.when(F.col("_rank") == 3, "critical").when(F.col("_rank") == 2, "high")
        .when((F.col("_rank") == 1) | (F.col("count") > 10), "warning").otherwise("info")
    )
    category = (
        F.when(F.col("probe") == "process_exec", "process")
        .when(F.col("probe").isin("network_connect", "network_listen"), "network")
        .when(F.col("probe") == "fd_pressure", "system")
        .otherwise("kernel")
    )
    kept = per.withColumns({"severity": severity, "category": category}).where(
        ~((F.col("severity") == "info") & F.col("container_id").isNull() & (F.col("count") <= 3))
    )
    samples = top_k(live, ["probe", "comm"], [F.col("event_id")], EXAMPLES).groupBy("probe", "comm").agg(
        F.array_sort(F.collect_list("event_id")).alias("samples")
    )
    return kept.join(samples, ["probe", "comm"]).select(
        F.concat_ws("_", F.lit("kernel"), "probe", "comm").alias("key"),
        "probe", "comm", "category", "severity", "count", "samples",
    )


def ssh_brute_force(lines: DataFrame) -> DataFrame:
    """Sources with more than ten failed logins per host."""
    source = F.regexp_extract("line", r"from\s+(\S+)\s+port", 1)
    hits = lines.where(F.col("line").contains("Failed password")).withColumn("source_ip", source)
    return (
        hits.where("source_ip <> ''").groupBy("hostname", "source_ip")
        .agg(F.count("*").alias("attempts")).where("attempts > 10")
    )


def self_checks(tables: dict[str, DataFrame]) -> DataFrame:
    """Host tables against their thresholds -> WARN rows ``(hostname, source, key, value)``.

    Any of ``wifi``, ``disk_io``, ``dns``, ``tls``, ``ntp``, ``updates``, ``hardware``.
    """
    c = F.col
    # Thresholds.
    checks = (
        ("wifi", F.lit("wifi-discard-high"), c("discarded") > 1000, c("discarded")),
        ("wifi", F.lit("wifi-signal-weak"), (c("signal_dbm") < -75) & (c("signal_dbm") > -256), c("signal_dbm")),
        ("disk_io", F.concat(F.lit("diskio-high-"), c("device")), c("weighted_io_ms") > 10000, c("weighted_io_ms")),
        ("dns", F.concat(F.lit("dns-slow-"), c("resolver")), (c("response_ms") < 0) | (c("response_ms") > 500), c("response_ms")),
        ("tls", F.concat(F.lit("tls-expiry-"), c("port").cast("string")), (c("days_remaining") >= 0) & (c("days_remaining") < 30), c("days_remaining")),
        ("ntp", F.lit("ntp-drift"), ~c("synchronized") | (F.abs(c("offset_seconds")) > 1), c("offset_seconds")),
        ("updates", F.lit("security-updates-pending"), c("security_pending") > 0, c("security_pending")),
        ("hardware", F.lit("hw-health-flag"), (c("max_temp") > 80) | (c("smart_status") == "FAILED"), c("max_temp")),
    )
    out = None
    for source, key, bad, value in checks:
        if source in tables:
            rows = tables[source].where(bad).select(
                "hostname", F.lit(source).alias("source"), key.alias("key"),
                F.lit("WARN").alias("severity"), value.cast("double").alias("value"),
            )
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no known host table given")
    return out
