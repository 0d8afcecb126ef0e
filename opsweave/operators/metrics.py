"""Counters, histograms, outages and link quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsweave.functions.ordered import top_k, with_previous, with_running_sum
from opsweave.functions.text import any_of


def _levels(value: Column, *steps: tuple[float, str], otherwise: str | None = None) -> Column:
    """Label of the first exceeded limit; limits go from the highest down."""
    out = F.lit(otherwise)
    for limit, label in reversed(steps):
        out = F.when(value > limit, label).otherwise(out)
    return out


def _mean(col: str, where: Column) -> Column:
    """Mean of the chosen rows, added as decimals so that it does not depend on their order."""
    return F.avg(F.when(where, F.col(col).cast("decimal(28,6)"))).cast("double")


# --- counter deltas -----------------------------------------------------------------


def counter_deltas(
    df: DataFrame, keys: Sequence[str], counters: Sequence[str], tie: Sequence[str] = ()
) -> DataFrame:
    """Growth of cumulative counters since the previous reading (``d_<name>``).

    The first reading of a key gives no row; a counter that went back (restart)
    counts as no growth.
    """
    seen = with_previous(df, keys, "t", list(counters), tie=tie)
    first = seen.where(F.col(f"prev_{counters[0]}").isNotNull())
    deltas = {
        f"d_{c}": F.greatest(F.col(c) - F.col(f"prev_{c}"), F.lit(0)) for c in counters
    }
    return first.withColumns(deltas).drop(*[f"prev_{c}" for c in counters])


def disk_latency(deltas: DataFrame) -> DataFrame:
    """Average latency between readings: above 50 ms a warning, above 200 ms critical."""
    ops = F.col("d_reads") + F.col("d_writes")
    out = deltas.where(ops > 0).withColumn("avg_latency_ms", F.col("d_io_ticks_ms") / ops)
    level = _levels(F.col("avg_latency_ms"), (200, "critical"), (50, "warning"))
    return out.withColumn("severity", level).where("severity is not null")


def cache_misses(deltas: DataFrame) -> DataFrame:
    """More than 100 major faults between readings; above 10 % of all faults a warning."""
    fault, major = F.col("d_pgfault"), F.col("d_pgmajfault")
    rate = F.when(fault > 0, major / fault * 100).otherwise(F.lit(0.0))
    out = deltas.where(major > 100).withColumn("miss_pct", rate)
    return out.withColumn("severity", _levels(F.col("miss_pct"), (10, "warning"), otherwise="info"))


def oom_kills(deltas: DataFrame) -> DataFrame:
    return deltas.where("d_oom_kill > 0").withColumn("severity", F.lit("critical"))


def retransmit_spikes(deltas: DataFrame) -> DataFrame:
    """Retransmits above 5 % (20 %: critical) of more than 100 sent segments."""
    out = deltas.where("d_out_segs > 100 and d_retrans > 0").withColumn(
        "rate_pct", F.col("d_retrans") / F.col("d_out_segs") * 100
    )
    level = _levels(F.col("rate_pct"), (20, "critical"), (5, "warning"))
    return out.withColumn("severity", level).where("severity is not null")


# --- log2 histograms ----------------------------------------------------------------


def log2_histogram(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts per power-of-two bucket 0..31 (bucket = position of the highest bit)."""
    bits = F.length(F.bin(F.greatest(F.col(value), F.lit(1)))) - 1
    bucket = F.least(bits, F.lit(31)).alias("bucket")
    return values.groupBy(*keys, bucket).agg(F.count("*").alias("n"))


def histogram_percentiles(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total and the upper bucket bounds that hold the 50th and 99th percentile and the maximum."""
    w = Window.partitionBy(*keys)  # at most 32 rows per key
    cum = F.sum("n").over(
        w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    h = hist.select("*", cum.alias("cum"), F.sum("n").over(w).alias("total"))
    top = F.pow(F.lit(2.0), F.col("bucket") + 1)

    def at(target: Column) -> Column:
        return F.min(F.when(F.col("cum") >= target, top)).cast("long")

    return h.groupBy(*keys).agg(
        F.max("total").alias("total"),
        at(F.floor(F.col("total") / 2)).alias("p50"),
        at(F.floor(F.col("total") * 99 / 100)).alias("p99"),
        F.max(top).cast("long").alias("max"),
    )


def histogram_findings(percentiles: DataFrame, warn_us: int, critical_us: int) -> DataFrame:
    """Disk I/O: 50 000 / 500 000; run queue: 10 000 / 100 000 microseconds."""
    level = _levels(F.col("p99"), (critical_us, "critical"), (warn_us, "warning"))
    return percentiles.withColumn("severity", level).where("severity is not null")


def nth_value(df: DataFrame, keys: Sequence[str], value: str, fraction: float, width: float) -> DataFrame:
    """Exact value at sorted position ``floor(fraction * n)`` (0-based) per key.

    Counts per value bucket locate the bucket of that position; only the distinct
    values of this one bucket are then ranked. No task sorts a whole group.
    """
    keys = list(keys)
    src = df.where(F.col(value).isNotNull()).withColumn("_b", F.floor(F.col(value) / width))
    counts = src.groupBy(*keys, "_b", F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    per = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy(*keys)
    before = F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    placed = per.select(
        *keys, "_b", F.col("_n").alias("_bn"),
        F.coalesce(before, F.lit(0)).alias("_before"),
        F.floor(F.sum("_n").over(w) * fraction).alias("_target"),
    )
    chosen = placed.where("_target >= _before and _target < _before + _bn")
    inside = counts.join(chosen, [*keys, "_b"])
    run = F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = inside.withColumn("_run", run + F.col("_before"))
    return ranked.where("_run > _target").groupBy(*keys).agg(F.min("_v").alias(value))


# --- network tables -------------------------------------------------------------------


def by_destination(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Retransmits or resets per destination: three or more point at the own link."""
    per = counts.groupBy(*keys, "dest").agg(F.sum("n").alias("n"))
    worst = F.min_by("dest", F.struct((-F.col("n")).alias("neg"), "dest"))
    out = per.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.count("*").alias("destinations"), worst.alias("top_dest")
    )
    return out.withColumn(
        "verdict",
        F.when(F.col("destinations") >= 3, "local link")
        .when(F.col("destinations") == 1, "remote")
        .otherwise("healthy"),
    )


def drop_reasons(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Packet drops: total, most frequent reason, above 100 a warning, above 1000 critical."""
    per = counts.groupBy(*keys, "reason").agg(F.sum("n").alias("n"))
    out = per.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        F.min_by("reason", F.struct((-F.col("n")).alias("neg"), "reason")).alias("top_reason"),
    )
    return out.withColumn("severity", _levels(F.col("total"), (1000, "critical"), (100, "warning")))


def connection_lifecycle(conns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Connections, those under one second, ports, and the finding level."""
    out = conns.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("duration_ms") < 1000).alias("short_lived"),
        F.countDistinct("port").alias("ports"),
    )
    return out.withColumn("severity", _levels(F.col("short_lived"), (200, "warning"), (50, "info")))


def busiest_ports(conns: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    per = conns.groupBy(*keys, "port").agg(F.count("*").alias("n"))
    return top_k(per, keys, [F.desc("n"), F.col("port")], k)


# Ports and address prefixes.
SUSPICIOUS_PORTS = (4444, 5555, 1337, 31337, 9999)
INTERNAL_PREFIXES = ("10.", "172.", "192.168.", "100.")


def connection_severity(dest_ip: Column, dest_port: Column) -> Column:
    internal = F.lit(False)
    for p in INTERNAL_PREFIXES:
        internal = internal | dest_ip.startswith(p)
    return (
        F.when(dest_ip.isin("127.0.0.1", "0.0.0.0"), None)
        .when(dest_port.isin(*SUSPICIOUS_PORTS), "high")
        .when(internal, None)
        .otherwise("info")
    )


# Process names.
MALWARE = ("xmrig", "minerd", "kdevtmpfsi", "kinsing", "masscan", "meterpreter")
CONTAINER_TOOLS = ("bash", "sh", "nc", "ncat", "curl", "wget", "python", "perl")
HEALTH_PROBES = ("ping_", "health", "readiness", "liveness", "pg_isready", "redis-cli")
KERNEL_THREADS = (
    "kworker", "rcu_", "migration", "ksoftirqd", "watchdog", "irq/",
    "scsi_", "jbd2", "kswapd", "oom_reaper",
)
HOST_SERVICES = (
    "systemd", "journald", "logind", "udevd", "dbus-daemon", "NetworkManager", "dhcpcd",
    "wpa_supplicant", "sshd", "agetty", "polkitd", "containerd", "dockerd", "k3s", "kubelet",
    "nix-daemon", "nix-build", "nix-env", "nix-store", "auto-cpufreq", "thermald", "cron",
    "anacron",
)


def process_severity(comm: Column, cmdline: Column, container: Column) -> Column:
    """Null for kernel threads and known host services."""

    def starts(words):
        test = F.lit(False)
        for w in words:
            test = test | comm.startswith(w)
        return test

    shell = any_of(cmdline, ("/dev/tcp/", "base64 -d | bash")) | (
        cmdline.contains("| sh") & cmdline.contains("curl")
    )
    tool = F.element_at(F.split(comm, "/"), -1).isin(*CONTAINER_TOOLS)
    return (
        F.when(starts(KERNEL_THREADS), None)
        .when(any_of(comm, MALWARE) | any_of(cmdline, MALWARE) | shell, "critical")
        .when(container.isNotNull() & tool & ~any_of(cmdline, HEALTH_PROBES), "warning")
        .when(container.isNotNull(), "info")
        .when(~starts(HOST_SERVICES), "info")
    )


def fd_pressure(allocated: Column, maximum: Column) -> Column:
    return _levels(allocated / maximum * 100, (95, "critical"), (80, "warning"))


def io_pressure(avg10: Column) -> Column:
    return _levels(avg10, (50, "critical"), (20, "warning"))


# --- outages --------------------------------------------------------------------------


def probe_cycles(probes: DataFrame) -> DataFrame:
    """One row per (host, ts) with the state of the cycle: ok, isp or network."""
    per = probes.groupBy("host", "ts").agg(
        F.coalesce(F.every(F.when(F.col("target") != "gateway", ~F.col("reachable"))), F.lit(True)).alias(
            "external_down"
        ),
        F.coalesce(F.some(F.when(F.col("target") == "gateway", ~F.col("reachable"))), F.lit(False)).alias(
            "gateway_down"
        ),
    )
    state = F.when(F.col("gateway_down"), "network").when(F.col("external_down"), "isp").otherwise("ok")
    return per.select("host", "ts", state.alias("state"))


def _runs(cycles: DataFrame, keys: Sequence[str], up: Column) -> DataFrame:
    """Number the failing runs: ``run`` = how many good cycles the key has seen so far."""
    marked = cycles.withColumn("_ok", up.cast("int"))
    return with_running_sum(marked, keys, "ts", {"run": F.col("_ok")})


def outage_events(cycles: DataFrame) -> DataFrame:
    """An alert at the second failing cycle in a row, a recovery at the next good one."""
    runs = _runs(cycles, ["host"], F.col("state") == "ok")
    bad = runs.where("_ok = 0")
    w = Window.partitionBy("host", "run").orderBy("ts")
    second = (
        bad.withColumn("_rn", F.row_number().over(w)).where("_rn <= 2").where("_rn = 2")
        .select("host", "run", F.col("ts").alias("alert_ts"), "state")
    )
    good = runs.where("_ok = 1").select(
        "host", (F.col("run") - 1).alias("run"), F.col("ts").alias("recovered_ts")
    )
    alerts = second.select(
        "host", F.col("alert_ts").alias("ts"),
        F.concat(F.col("state"), F.lit("_down")).alias("event"), F.lit(None).cast("double").alias("seconds"),
    )
    recovered = second.join(good, ["host", "run"]).select(
        "host", F.col("recovered_ts").alias("ts"), F.lit("recovered").alias("event"),
        (F.col("recovered_ts") - F.col("alert_ts")).cast("double").alias("seconds"),
    )
    return alerts.unionByName(recovered)


def failure_sessions(failures: DataFrame, keys: Sequence[str], gap: str = "gap_seconds") -> DataFrame:
    """Failures of a key less than its gap apart are one session: ``(keys, started, ended, failures)``.

    ``failures(keys, ts, gap)`` in seconds, one gap per key. A session ends its gap after its last failure. Histories are cut
    into chunks, so no task holds those of one key; the streaming form uses Spark's session windows.
    """
    keys = list(keys)
    before = with_previous(failures, keys, "ts", ["ts"])
    new = F.when(F.col("prev_ts").isNull() | (F.col("ts") - F.col("prev_ts") > F.col(gap)), 1).otherwise(0)
    numbered = with_running_sum(before.withColumn("_new", new), keys, "ts", {"session": F.col("_new")})
    return numbered.groupBy(*keys, "session").agg(
        F.min("ts").alias("started"), F.max(F.col("ts") + F.col(gap)).alias("ended"), F.count("*").alias("failures")
    ).drop("session")


def degradations(probes: DataFrame, cycles: DataFrame) -> DataFrame:
    """In good cycles: external targets above 20 % loss, else anything slower than 100 ms."""
    good = cycles.where("state = 'ok'").select("host", "ts")
    kind = F.when((F.col("target") != "gateway") & (F.col("loss_pct") > 20), "degraded").when(
        F.col("avg_ms") > 100, "slow"
    )
    return probes.join(good, ["host", "ts"]).withColumn("kind", kind).where("kind is not null")


def uptime_summary(probes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probes, failures, uptime, latency, closed outages and their seconds."""
    keys = list(keys)
    base = probes.groupBy(*keys).agg(
        F.count("*").alias("total_probes"),
        F.count_if(~F.col("reachable")).alias("down_probes"),
        _mean("avg_ms", F.col("reachable")).alias("avg_latency"),
        F.max(F.when(F.col("reachable"), F.col("avg_ms"))).alias("max_latency"),
    )
    runs = _runs(probes, keys, F.col("reachable"))
    starts = runs.where("_ok = 0").groupBy(*keys, "run").agg(F.min("ts").alias("start"))
    ends = runs.where("_ok = 1").select(*keys, (F.col("run") - 1).alias("run"), F.col("ts").alias("end"))
    closed = starts.join(ends, [*keys, "run"]).groupBy(*keys).agg(
        F.count("*").alias("outages"), F.sum(F.col("end") - F.col("start")).alias("downtime")
    )
    return base.join(closed, keys, "left").select(
        *keys, "total_probes", "down_probes",
        (F.col("total_probes") - F.col("down_probes")).alias("up_probes"),
        ((F.col("total_probes") - F.col("down_probes")) / F.col("total_probes") * 100).alias("uptime_pct"),
        F.coalesce("avg_latency", F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce("max_latency", F.lit(0.0)).alias("max_latency_ms"),
        F.coalesce("outages", F.lit(0)).alias("outages"),
        F.coalesce("downtime", F.lit(0)).alias("downtime"),
    )


def network_report(hops: DataFrame, keys: Sequence[str], width: float = 1.0) -> DataFrame:
    """Gateway and external averages and exact p95 jitter with the verdict."""
    keys = list(keys)
    base = hops.groupBy(*keys).agg(
        _mean("avg_ms", F.col("hop") == "gateway").alias("gw_avg"),
        F.max(F.when(F.col("hop") == "gateway", F.col("avg_ms"))).alias("gw_max"),
        _mean("avg_ms", F.col("hop") == "external").alias("ext_avg"),
        F.max(F.when(F.col("hop") == "external", F.col("avg_ms"))).alias("ext_max"),
    )
    p95 = nth_value(hops, [*keys, "hop"], "jitter_ms", 0.95, width)
    p95 = p95.groupBy(*keys).agg(
        F.max(F.when(F.col("hop") == "gateway", F.col("jitter_ms"))).alias("gw_p95_jitter"),
        F.max(F.when(F.col("hop") == "external", F.col("jitter_ms"))).alias("ext_p95_jitter"),
    )
    out = base.join(p95, keys, "left").fillna(0.0)
    verdict = (
        F.when(F.col("gw_p95_jitter") > 30, "wifi bufferbloat")
        .when((F.col("ext_p95_jitter") > 50) & (F.col("gw_p95_jitter") < 10), "isp jitter")
        .otherwise("healthy")
    )
    return out.withColumn("verdict", verdict)


def path_bottleneck(hops: DataFrame) -> DataFrame:
    """Per sample (host, ts) the hop with the highest jitter and the verdict.

    ``hops(host, ts, hop_no, hop, avg_ms, max_ms, loss_pct)``; hop 0 is the
    gateway, hop 2 the external target.
    """
    w = Window.partitionBy("host", "ts").orderBy("hop_no")  # a path has a handful of hops
    prev = F.lag("avg_ms").over(w)
    h = hops.select(
        "*",
        (F.col("max_ms") - F.col("avg_ms")).alias("jitter_ms"),
        F.when(prev > 0, F.col("avg_ms") - prev).otherwise(F.col("avg_ms")).alias("hop_latency_ms"),
    )

    def at(no: int, col: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("hop_no") == no, F.col(col))), F.lit(0.0))

    worst = F.min_by(
        "hop", F.when(F.col("jitter_ms") > 0, F.struct((-F.col("jitter_ms")).alias("neg"), "hop_no"))
    )
    out = h.groupBy("host", "ts").agg(
        worst.alias("bottleneck"), F.max("hop_latency_ms").alias("max_hop_latency_ms"),
        at(0, "loss_pct").alias("gl"), at(0, "jitter_ms").alias("gj"),
        at(2, "loss_pct").alias("el"), at(2, "jitter_ms").alias("ej"),
    )
    c = F.col
    verdict = (
        F.when(c("gl") > 10, "wifi loss").when(c("gj") > 30, "wifi bufferbloat")
        .when((c("el") > 10) & (c("gl") == 0), "isp loss")
        .when((c("ej") > 50) & (c("gj") < 10), "isp jitter").otherwise("healthy")
    )
    severity = F.when(verdict.isin("wifi loss", "isp loss"), "critical").when(
        verdict == "healthy", "info"
    ).otherwise("warning")
    return out.select(
        "host", "ts", F.coalesce("bottleneck", F.lit("")).alias("bottleneck"),
        "max_hop_latency_ms", verdict.alias("verdict"), severity.alias("severity"),
    )


PUBLIC_RESOLVERS = ("1.1.1.1", "8.8.8.8", "9.9.9.9")


def dns_comparison(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fastest own resolver against the fastest public one; both slow = not resolving."""
    public = F.col("resolver").isin(*PUBLIC_RESOLVERS)
    own = F.when(~public, F.struct("response_ms", "resolver"))
    out = checks.groupBy(*keys).agg(
        F.min(own).alias("own"), F.min(F.when(public, F.col("response_ms"))).alias("public_ms")
    )
    own_slow = F.coalesce(F.col("own.response_ms") > 200, F.lit(False))
    public_slow = F.coalesce(F.col("public_ms") > 200, F.lit(True))
    return out.select(
        *keys, F.col("own.resolver").alias("own_resolver"), F.col("own.response_ms").alias("own_ms"),
        "public_ms", (~(own_slow & public_slow)).alias("resolving"),
    )


def link_quality(samples: DataFrame) -> DataFrame:
    """Findings ``(host, ts, key, severity)`` of one wide link sample per row."""
    c = F.col
    lost = lambda v: F.when(v >= 40, "critical").otherwise("warning")
    first = (
        F.when(c("gw_loss") > 0, F.struct(F.lit("gateway_packet_loss").alias("key"), lost(c("gw_loss")).alias("severity")))
        .when(c("ext_loss") > 0, F.struct(F.lit("upstream_packet_loss").alias("key"), lost(c("ext_loss")).alias("severity")))
        .when(c("gw_max_ms") > 50, F.struct(F.lit("gateway_high_jitter").alias("key"), F.lit("warning").alias("severity")))
    )

    def leveled(key: str, level: Column) -> Column:
        return F.when(level.isNotNull(), F.struct(F.lit(key).alias("key"), level.alias("severity")))

    dns = F.when(c("dns_failures") >= 2, "critical").when(c("dns_failures") > 0, "warning")
    found = F.array_compact(
        F.array(
            first,
            leveled("wifi_channel_congested", _levels(c("channel_busy_pct"), (80, "critical"), (50, "warning"))),
            leveled("dns_resolution_failing", dns),
            leveled("iface_errors", _levels(c("iface_errors"), (10000, "critical"), (100, "warning"))),
        )
    )
    return samples.select("host", "ts", F.inline(found))
