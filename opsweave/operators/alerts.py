"""Alert rules over inventory, host tables, logs and processes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.functions.text import any_of

# Alerts and findings: (alert_id, severity, title, detail).


def _alert(df: DataFrame, key: Column, severity: Column | str, title: Column, detail: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(key.alias("alert_id"), level.alias("severity"), title.alias("title"), detail.alias("detail"))


def _joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def crashloop_alerts(pods: DataFrame, causes: DataFrame, buckets: DataFrame) -> DataFrame:
    """CrashLoopBackOff pods with their nearest state change and most frequent error.

    ``pods(cluster, namespace, name, status, restart_count)``, ``causes(namespace, pod,
    change_type, resource_name, delta_seconds)``, ``buckets(namespace, pod, severity,
    count, template_text, template_hash)``.
    """
    bad = pods.where("status = 'CrashLoopBackOff'")
    first = causes.groupBy("namespace", F.col("pod").alias("name")).agg(
        F.min(F.struct(F.abs("delta_seconds").alias("d"), "resource_name", "change_type")).alias("cause")
    )
    worst = buckets.where(F.col("severity").isin("ERROR", "FATAL")).groupBy(
        "namespace", F.col("pod").alias("name")
    ).agg(F.min(F.struct((-F.col("count")).alias("neg"), "template_hash", "template_text")).alias("e"))
    out = bad.join(first, ["namespace", "name"], "left").join(worst, ["namespace", "name"], "left")
    detail = F.concat_ws(
        "; ",
        _joined(F.col("restart_count"), " restarts"),
        _joined("after ", F.col("cause.change_type"), " of ", F.col("cause.resource_name")),
        _joined("top error (x", -F.col("e.neg"), "): ", F.substring("e.template_text", 1, 100)),
    )
    key = _joined("crashloop:", F.col("cluster"), ":", F.col("namespace"), ":", F.col("name"))
    return _alert(out, key, "critical", _joined("CrashLoopBackOff: ", F.col("namespace"), "/", F.col("name")), detail)


def failed_pod_alerts(pods: DataFrame, reads: DataFrame) -> DataFrame:
    """Failed pods: info when the same owner has a running pod, else a warning with
    the configs the pod reads."""
    failed = pods.where("status = 'Failed'")
    healthy = pods.where("status = 'Running' and owner_name <> ''").select(
        "namespace", "owner_name", F.lit(True).alias("_ok")
    ).distinct()
    deps = reads.select("namespace", F.col("pod").alias("name"), _joined(F.col("kind"), ": ", F.col("target")).alias("d"))
    listed = deps.groupBy("namespace", "name").agg(F.array_join(F.array_sort(F.collect_set("d")), ", ").alias("deps"))
    out = failed.join(healthy, ["namespace", "owner_name"], "left").join(listed, ["namespace", "name"], "left")
    ok = F.coalesce("_ok", F.lit(False))
    detail = F.when(ok, "its owner has another running pod").otherwise(
        F.coalesce(_joined("depends on ", F.col("deps")), F.lit("reads no config"))
    )
    key = _joined("failed:", F.col("cluster"), ":", F.col("namespace"), ":", F.col("name"))
    level = F.when(ok, "info").otherwise("warning")
    return _alert(out, key, level, _joined("Failed pod ", F.col("namespace"), "/", F.col("name")), detail)


def disk_alerts(disks: DataFrame) -> DataFrame:
    p = F.col("percent")
    level = F.when(p > 95, "emergency").when(p > 90, "critical").otherwise("warning")
    key = _joined("disk:", F.col("hostname"), ":", F.col("mountpoint"))
    return _alert(
        disks.where(p > 85), key, level, _joined("Disk ", F.format_string("%.0f", p.cast("double")), "% full: ", F.col("mountpoint")), F.col("hostname")
    )


def unit_alerts(units: DataFrame) -> DataFrame:
    bad = units.where("active_state = 'failed'")
    key = _joined("systemd:", F.col("hostname"), ":", F.col("name"))
    return _alert(bad, key, "warning", _joined("Unit down: ", F.col("name")), F.col("hostname"))


def wifi_alerts(wifi: DataFrame) -> DataFrame:
    bad = wifi.where("discarded > 5000")
    key = _joined("wifi:", F.col("hostname"), ":", F.col("interface"))
    return _alert(bad, key, "warning", _joined("Wireless drops: ", F.col("discarded")), F.col("hostname"))


def kernel_alerts(events: DataFrame) -> DataFrame:
    bad = events.where(F.upper("severity").isin("CRITICAL", "HIGH")).select("hostname", "probe", "comm").distinct()
    key = _joined("security:", F.col("hostname"), ":", F.col("probe"), ":", F.col("comm"))
    return _alert(bad, key, "critical", _joined("Security: suspicious ", F.col("probe"), " on ", F.col("hostname")), F.col("comm"))


def host_thresholds(hosts: DataFrame) -> DataFrame:
    """Memory 85/95 %, disk 85/95 % and load above twice the cores."""
    c = F.col
    rows = F.array_compact(
        F.array(
            F.when(c("memory_percent") >= 95, F.struct(F.lit("memory_critical").alias("key"), F.lit("critical").alias("severity")))
            .when(c("memory_percent") >= 85, F.struct(F.lit("memory_high").alias("key"), F.lit("warning").alias("severity"))),
            F.when(c("disk_percent") >= 95, F.struct(F.lit("disk_critical").alias("key"), F.lit("critical").alias("severity")))
            .when(c("disk_percent") >= 85, F.struct(F.lit("disk_high").alias("key"), F.lit("warning").alias("severity"))),
            F.when((c("cores") > 0) & (c("load_1m") > c("cores") * 2), F.struct(F.lit("load_high").alias("key"), F.lit("warning").alias("severity"))),
        )
    )
    return hosts.select("hostname", F.inline(rows))


def bad_pods(pods: DataFrame) -> DataFrame:
    """Waiting for an image or crashing, or more than ten restarts."""
    waiting = F.col("status").isin("CrashLoopBackOff", "ErrImagePull", "ImagePullBackOff")
    status = F.when(waiting, F.col("status")).when(
        F.col("restart_count") > 10, _joined(F.col("restart_count"), " restarts")
    )
    out = pods.withColumn("_s", status).where("_s is not null")
    key = _joined("pod_", F.col("namespace"), "_", F.col("name"))
    return _alert(out, key, "critical", _joined("Pod ", F.col("namespace"), "/", F.col("name"), ": ", F.col("_s")), F.col("_s"))


# Cluster event reasons.
EVENT_REASONS = (
    "FailedScheduling", "FailedMount", "FailedAttachVolume", "BackOff", "Unhealthy",
    "FailedCreate", "EvictionThresholdMet", "OOMKilling", "NodeNotReady", "NetworkNotReady",
)
CRITICAL_REASONS = ("OOMKilling", "EvictionThresholdMet", "NodeNotReady")


def warning_events(events: DataFrame) -> DataFrame:
    """Repeated cluster events of the ten reasons."""
    bad = events.where(F.col("reason").isin(*EVENT_REASONS) & (F.col("count") > 1))
    level = F.when(F.col("reason").isin(*CRITICAL_REASONS), "critical").otherwise("warning")
    key = _joined("k8s_event_", F.col("namespace"), "_", F.col("object"), "_", F.col("reason"))
    return _alert(bad, key, level, F.col("reason"), _joined(F.col("count"), "x"))


# Words of failing services.
SERVICE_WORDS = (
    "deadline exceeded", "timed out", "i/o timeout", "connection reset", "connection refused",
    "unreachable", "failed", "error", "panic", "map response long-poll timed out",
    "no route to host",
)


def journal_errors(lines: DataFrame, seconds: int = 120) -> DataFrame:
    """Error lines per host, unit and two-minute window; above ten critical."""
    per = lines.groupBy("hostname", "unit", (F.floor(F.col("ts") / seconds) * seconds).alias("window")).agg(
        F.count("*").alias("n")
    )
    return per.withColumn("severity", F.when(F.col("n") > 10, "critical").otherwise("warning"))


def service_failures(lines: DataFrame, seconds: int = 120) -> DataFrame:
    """Failure-pattern lines per service and window: above three warning, above ten critical."""
    bad = lines.where(any_of(F.lower("line"), SERVICE_WORDS))
    per = bad.groupBy("hostname", "unit", (F.floor(F.col("ts") / seconds) * seconds).alias("window")).agg(
        F.count("*").alias("n")
    )
    n = F.col("n")
    return per.withColumn("severity", F.when(n > 10, "critical").when(n > 3, "warning").otherwise("info"))


def kernel_families(lines: DataFrame) -> DataFrame:
    """Kernel error families per host: USB, I/O, filesystem, OOM."""
    low = F.lower("line")
    # Words per family.
    families = {
        "usb": low.contains("usb") & any_of(low, ("error", "disconnect", "device descriptor read")),
        "io": any_of(low, ("i/o error", "blk_update_request", "buffer i/o error")),
        "fs": any_of(low, ("ext4", "btrfs", "xfs", "remounting filesystem read-only")),
        "oom": any_of(low, ("out of memory", "oom", "killed process")),
    }
    per = lines.groupBy("hostname").agg(*[F.count_if(c).alias(n) for n, c in families.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("family"), F.col(n).alias("n")) for n in families])
    out = per.select("hostname", F.inline(rows)).where("n > 0")
    level = F.when((F.col("family") == "usb") & (F.col("n") <= 10), "warning").otherwise("critical")
    return out.withColumn("severity", level)


def baseline_drift(members: DataFrame) -> DataFrame:
    """Polls whose members differ from the host's first poll.

    ``members(hostname, kind, poll, member)`` with kind ``ssh_keys``, ``cron_jobs`` or
    ``users``; the first poll only stores. Users report new accounts only.
    """
    m = members.distinct()
    scope = ["hostname", "kind"]
    first = m.groupBy(*scope).agg(F.min("poll").alias("_first"))
    base = m.join(first, scope).where("poll = _first").select(*scope, "member", F.lit(1).alias("_b"))
    n_base = base.groupBy(*scope).agg(F.count("*").alias("_nb"))
    later = m.join(first, scope).where("poll > _first").drop("_first")
    per = later.join(base, [*scope, "member"], "left").groupBy(*scope, "poll").agg(
        F.count("*").alias("_n"), F.count("_b").alias("_same")
    )
    out = per.join(n_base, scope).select(
        *scope, "poll", (F.col("_n") - F.col("_same")).alias("added"), (F.col("_nb") - F.col("_same")).alias("removed")
    )
    changed = F.when(F.col("kind") == "users", F.col("added") > 0).otherwise(
        (F.col("added") > 0) | (F.col("removed") > 0)
    )
    level = F.when(F.col("kind") == "cron_jobs", "warning").otherwise("critical")
    return out.where(changed).withColumn("severity", level)


# Signs of unwanted processes and connections.
BAD_NAMES = (
    "xmrig", "minerd", "cpuminer", "cgminer", "bfgminer", "ethminer", "kdevtmpfsi", "kinsing",
    "dbused", "dbus-daemon-",
)
BAD_COMMANDS = (
    "stratum+tcp", "stratum+ssl", "bash -i >& /dev/tcp", "nc -e /bin", "/dev/tcp/",
    "python -c 'import socket",
)
BUSY_TOOLS = ("cc1", "gcc", "rustc", "cargo", "node", "python", "java", "go", "make", "ninja", "nix")
KNOWN_PORTS = (80, 443, 53, 22, 6443, 8443, 5432, 3306, 6379, 8080, 9090, 10250)
KNOWN_CLIENTS = ("kubelet", "containerd", "flannel", "coredns", "cloudflared")


def process_findings(procs: DataFrame) -> DataFrame:
    """One row per sign a process shows: known name, known command, unknown CPU hog."""
    comm, cmd = F.col("comm"), F.col("cmdline")
    signs = [F.when(comm.contains(n), F.struct(F.lit(f"suspicious_process:{n}").alias("sign"), F.lit("critical").alias("severity"))) for n in BAD_NAMES]
    signs += [F.when(cmd.contains(n), F.struct(F.lit(f"suspicious_cmdline:{n[:8]}").alias("sign"), F.lit("critical").alias("severity"))) for n in BAD_COMMANDS]
    hog = (F.col("cpu") > 90) & (comm != "") & ~any_of(comm, BUSY_TOOLS)
    signs.append(F.when(hog, F.struct(F.lit("high_cpu_process").alias("sign"), F.lit("warning").alias("severity"))))
    return procs.select("hostname", "pid", F.inline(F.array_compact(F.array(*signs))))


def outbound_findings(conns: DataFrame) -> DataFrame:
    """Connections to high ports outside the known ones and the known clients."""
    odd = (F.col("port") > 10000) & ~F.col("port").isin(*KNOWN_PORTS) & ~any_of(F.col("process"), KNOWN_CLIENTS)
    return conns.where(odd).withColumn("severity", F.lit("warning"))


def privileged_pods(containers: DataFrame) -> DataFrame:
    """Privileged containers and host access outside kube-system."""
    rows = F.array_compact(
        F.array(
            F.when(F.col("privileged"), F.lit("privileged_pod")),
            F.when(F.col("host_network") | F.col("host_pid"), F.lit("host_access_pod")),
        )
    )
    return containers.where("namespace <> 'kube-system'").select(
        "namespace", "name", F.explode(rows).alias("key"), F.lit("warning").alias("severity")
    ).distinct()


# Finding keys that are noise right after a boot.
BOOT_NOISE = (
    "service_errors_k3s", "ebpf_tcpdrop", "ebpf_tcp_resets", "dmesg_new_errors", "dmesg_network_events",
)


def after_boot(findings: DataFrame, hosts: DataFrame, seconds: int = 600) -> DataFrame:
    """Without the noisy keys of hosts in their first ten minutes."""
    noisy = F.lit(False)
    for k in BOOT_NOISE:
        noisy = noisy | F.col("key").startswith(k)
    fresh = hosts.where(F.col("uptime_seconds") < seconds).select("hostname", F.lit(True).alias("_boot"))
    out = findings.join(fresh, "hostname", "left")
    return out.where(~(F.coalesce("_boot", F.lit(False)) & noisy)).drop("_boot")
