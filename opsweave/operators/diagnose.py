"""Diagnosis: known patterns, context, errors to functions, scoring."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsweave.functions.ordered import top_k
from opsweave.functions.sizes import broadcast_if_small, shuffled
from opsweave.functions.text import any_of, contains_join
from opsweave.session import cut_lineage, freed_shuffles

# Known patterns (id, category, severity 0 info .. 3 critical, keywords).
PATTERNS = (
    ("dns-upstream-timeout", "dns", 3, ("i/o timeout", "read udp", "plugin/errors", "coredns")),
    ("dns-resolution-failed", "dns", 2, ("lookup", "on 10.43.0.10:53", "read udp", "connection refused")),
    ("connection-refused", "network", 2, ("connect: connection refused", "dial tcp")),
    ("tls-handshake-timeout", "network", 2, ("TLS handshake timeout", "net/http")),
    ("dhcp-dad-conflict", "network", 1, ("DAD detected", "dhcpcd")),
    ("oom-killed", "memory", 3, ("OOMKilled", "oom-kill", "Out of memory", "invoked oom-killer")),
    ("disk-full", "disk", 3, ("No space left on device", "ENOSPC", "disk full")),
    ("missing-api-key", "config", 2, ("No API key found", "API key", "auth", "ANTHROPIC_API_KEY", "OPENAI_API_KEY")),
    ("eaddrinuse", "config", 2, ("EADDRINUSE", "address already in use")),
    ("leader-election-lost", "network", 2, ("leader election lost", "error retrieving resource lock", "lease")),
    ("database-connection-failed", "database", 2, ("unable to refresh database connection pool", "no usable database connection", "ECONNREFUSED", "connect ECONNREFUSED")),
    ("crash-loop-backoff", "crash", 3, ("CrashLoopBackOff", "Back-off restarting failed container")),
    ("permission-denied", "security", 2, ("permission denied", "EACCES", "Forbidden", "RBAC")),
    ("cloudflare-tunnel-disconnect", "network", 1, ("connection with edge closed", "cloudflared", "Unable to reach the origin")),
    ("nix-gc-failed", "disk", 1, ("nix-gc.service", "removeOldGenerations")),
    ("pod-pending-unschedulable", "performance", 1, ("Unschedulable", "Insufficient cpu", "Insufficient memory", "didn't match Pod's node affinity")),
    ("resource-limits-missing", "performance", 1, ("no resource limits", "LimitRange", "requests.cpu: 0", "requests.memory: 0")),
    ("image-pull-backoff", "security", 2, ("ImagePullBackOff", "ErrImagePull", "unauthorized", "authentication required")),
    ("privileged-container", "security", 1, ("privileged: true", "SYS_ADMIN", "hostPID: true", "hostNetwork: true")),
    ("exposed-secret-in-env", "security", 3, ("password", "secret", "token", "api_key", "API_KEY", "SECRET_KEY", "PRIVATE_KEY")),
    ("rate-limited-429", "performance", 1, ("429", "Too Many Requests", "rate limit", "throttl", "Retry-After", "quota exceeded")),
    ("api-server-throttled", "performance", 1, ("Throttling request", "too many requests", "client-side throttling", "request throttled")),
    ("brute-force-auth", "security", 3, ("authentication failed", "invalid password", "login failed", "unauthorized", "403 Forbidden", "brute force", "too many authentication failures")),
    ("connection-flood", "security", 3, ("SYN flood", "too many open files", "EMFILE", "ENFILE", "socket: too many open files", "accept4: too many open files")),
    ("unusual-process", "security", 1, ("cryptominer", "xmrig", "kdevtmpfsi", "kinsing", "suspicious process", "reverse shell")),
    ("cert-expiring", "certificate", 1, ("certificate expired", "x509: certificate has expired", "certificate is not yet valid", "tls: bad certificate")),
    ("wifi-high-packet-discard", "network", 1, ("WiFi", "discarding", "packets", "2.4GHz", "interference")),
    ("wifi-weak-signal", "network", 1, ("signal", "dBm", "weak", "wifi", "-80", "-85", "-90")),
    ("wifi-power-save", "performance", 1, ("power_save", "powersave", "Power Management:on")),
)
# What to do first, per category.
ADVICE = {
    "dns": "compare the cluster resolver with a public one, then look at its upstream",
    "network": "check that the peer listens and that the route to it is stable",
    "memory": "raise the limit or find the process that grows",
    "disk": "free space on the fullest mount, then rotate logs and prune images",
    "certificate": "renew the certificate and check the clock",
    "database": "check that the database is up and its pool is not exhausted",
    "config": "compare the running configuration with the expected one",
    "permission": "check the role bindings of the account",
    "crash": "read the previous container's log and the change before the first crash",
    "performance": "compare requests with limits and back off clients",
    "security": "rotate what was exposed and review who used it",
}


def pattern_matches(text: Column) -> Column:
    """All matching patterns, most severe first: array of (neg severity, ord, pattern, category).

    The text is lower-cased once (it is bound to a lambda variable), and a keyword is a plain search.
    """

    def found(low: Column) -> Column:
        rows = [
            F.when(
                reduce(or_, [low.contains(k.lower()) for k in words]),
                F.struct(
                    F.lit(-sev).alias("neg"), F.lit(i).alias("ord"), F.lit(pid).alias("pattern"),
                    F.lit(cat).alias("category"),
                ),
            )
            for i, (pid, cat, sev, words) in enumerate(PATTERNS)
        ]
        return F.array_sort(F.array_compact(F.array(*rows)))

    hits = F.get(F.transform(F.array(F.lower(text)), found), F.lit(0))
    return F.when(F.size(hits) > 0, hits)


def first_pattern(text: Column) -> Column:
    return F.get(pattern_matches(text), F.lit(0))


def severity_label(neg: Column) -> Column:
    return F.when(neg == -3, "critical").when(neg == -2, "error").when(neg == -1, "warning").otherwise("info")


def diagnose_events(events: DataFrame) -> DataFrame:
    """``events(template_text, count, severity)`` -> one row per pattern, its most
    frequent template and the number of templates."""
    hit = events.withColumn("_p", first_pattern(F.col("template_text"))).where("_p is not null")
    per = hit.groupBy("_p.pattern", "_p.category", "_p.neg").agg(
        F.min(F.struct((-F.col("count")).alias("neg"), "template_text", "severity")).alias("b"),
        F.count("*").alias("templates"),
    )
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    return per.select(
        "pattern", "category", severity_label(F.col("neg")).alias("pattern_severity"),
        (-F.col("b.neg")).alias("occurrences"), F.col("b.template_text").alias("template_text"),
        F.col("b.severity").alias("log_severity"), "templates", advice[F.col("category")].alias("advice"),
    )


def diagnose_report(sources: dict[str, DataFrame]) -> DataFrame:
    """The diagnosis of every source (host, kernel, each cluster) with its name."""
    parts = [diagnose_events(df).withColumn("source", F.lit(n)) for n, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


# --- context-aware advice ---------------------------------------------------------------


def wifi_advice(hosts: DataFrame) -> DataFrame:
    """``hosts(hostname, band, channel, has_5ghz, has_ethernet)``."""
    band, ch = F.col("band"), F.coalesce(F.col("channel").cast("string"), F.lit("unknown"))
    low = band.contains("2.4") | band.isin("bg", "bgn")
    high = band.contains("5") | band.isin("a", "ac", "ax")
    main = (
        F.when(low & F.col("has_5ghz"), F.concat(F.lit("on 2.4 GHz channel "), ch, F.lit(": switch to the 5 GHz network")))
        .when(low, F.concat(F.lit("on 2.4 GHz channel "), ch, F.lit(": use the least busy of channels 1, 6, 11")))
        .when(high, F.lit("on 5 GHz: signal may be short-ranged, move closer or add a repeater"))
        .when(band.isNotNull(), F.concat(F.lit("band "), band, F.lit(": check signal quality")))
        .otherwise("band unknown: check by hand")
    )
    return hosts.select(
        "hostname", F.concat(main, F.when(F.col("has_ethernet"), "; ethernet is connected, prefer it").otherwise("")).alias("advice")
    )


def disk_advice(disks: DataFrame) -> DataFrame:
    p = F.col("percent")
    level = F.when(p > 90, "nearly full: free space now").when(p > 80, "approaching full: find the largest folders").otherwise("healthy")
    return disks.select("hostname", "mountpoint", "percent", level.alias("advice"))


def dns_advice(comparison: DataFrame, keys: list[str]) -> DataFrame:
    """On rows of ``dns_comparison``."""
    own, pub = F.col("own_ms"), F.col("public_ms")
    text = (
        F.when((own > 200) & (pub < 100), "own resolver is the bottleneck: use a faster one")
        .when((own > 200) & (pub > 200), "both resolvers are slow: network issue")
        .when(own < 100, "own resolver is healthy")
        .otherwise("not enough data: compare by hand")
    )
    return comparison.select(*keys, text.alias("advice"))


def crashloop_advice(pods: DataFrame, causes: DataFrame, k: int = 5) -> DataFrame:
    """Crashing pods with up to five correlated causes; four and more at once in a
    cluster point at a shared cause."""
    bad = pods.where("status = 'CrashLoopBackOff'")
    c = causes.select("namespace", F.col("pod").alias("name"), F.concat_ws(" ", "change_type", "resource_name").alias("cause")).distinct()
    few = top_k(c, ["namespace", "name"], [F.col("cause")], k).groupBy("namespace", "name").agg(
        F.array_join(F.array_sort(F.collect_list("cause")), "; ").alias("causes")
    )
    n = bad.groupBy("cluster").agg(F.count("*").alias("_n"))
    out = bad.join(n, "cluster").join(few, ["namespace", "name"], "left")
    return out.select(
        "cluster", "namespace", "name", "restart_count", F.coalesce("causes", F.lit("")).alias("causes"),
        (F.col("_n") > 3).alias("shared_cause_likely"),
    )


# Command safety.
BLOCKED_COMMANDS = (
    "delete namespace", "delete cluster", "delete node", "delete pv ", "delete pvc ", "drain ",
    "cordon ", "scale --replicas=0", "helm uninstall", "helm delete", "terraform destroy",
    "rm -rf", "dd if=", "mkfs", "fdisk", "DROP DATABASE", "DROP TABLE", "TRUNCATE",
    "--force --grace-period=0", "reset --hard", "push --force",
)
SAFE_COMMANDS = (
    "kubectl delete pod", "kubectl rollout restart", "kubectl scale", "kubectl edit configmap",
    "kubectl apply -f", "kubectl create secret", "kubectl patch", "systemctl restart",
    "systemctl start", "nmcli connection modify", "nmcli connection up",
    "nixos-rebuild switch", "nix-collect-garbage",
)


def command_safety(command: Column) -> Column:
    low = F.lower(command)
    return (
        F.when(any_of(low, [c.lower() for c in BLOCKED_COMMANDS]), "blocked")
        .when(any_of(low, [c.lower() for c in SAFE_COMMANDS]), "safe")
        .otherwise("needs_review")
    )


# Error categories.
INFRASTRUCTURE_WORDS = (
    "redis", "connection", "timeout", "dns", "certificate", "tls", "ssl", "port", "network",
    "socket", "refused", "unreachable", "oom", "memory", "disk", "cpu", "rate limit", "429",
    "503", "502", "healthcheck", "readiness", "liveness", "pod", "container", "k8s",
    "kubernetes", "deploy", "api endpoint", "polling", "etimedout", "econnrefused",
    "econnreset", "accessdenied",
)
CONFIGURATION_WORDS = (
    "config", "environment", "env var", "secret", "credential", "permission", "forbidden",
    "401", "403", "cors", "missing key", "not found in config", "unauthorized", "hmac",
    "signature mismatch", "signing",
)


def error_category(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(any_of(low, INFRASTRUCTURE_WORDS), "infrastructure")
        .when(any_of(low, CONFIGURATION_WORDS), "configuration")
        .otherwise("application")
    )


# --- errors to functions ----------------------------------------------------------------

# Words that are no function names.
NO_NAMES = (
    "split", "map", "filter", "forEach", "find", "reduce", "push", "null", "undefined", "true",
    "false", "this", "self", "none", "Error", "TypeError", "ReferenceError", "SyntaxError",
    "info", "warn", "error", "debug", "test", "data", "result", "SUBSCRIBE", "UNSUBSCRIBE",
    "PING", "QUIT", "RESET", "AUTO", "VOCATOR", "FRONTEND", "BACKEND",
)
NO_WORDS = (
    "TypeError", "Error", "Failed", "Request", "String", "Invalid", "Cannot", "Undefined",
    "Function", "Object", "Promise", "Module", "SUBSCRIBE", "UNSUBSCRIBE", "allowed",
    "context", "execute", "applications", "endpoint",
)
NO_KEYWORDS = (
    "typeerror", "error", "cannot", "read", "properties", "undefined", "null", "from", "when",
    "that", "this", "with", "function", "method", "class", "object", "string", "number",
    "server", "client", "backend", "frontend", "service", "crashes", "crash", "fails",
    "failing", "throws", "throwing", "causes", "causing", "sends", "using", "async", "handler",
    "route", "during", "startup", "calling", "where", "whose", "reading", "send", "stream",
    "reply", "request", "response", "data", "input", "output", "file", "path", "name", "type",
    "value", "unhandled", "exception", "promise", "rejection", "lifecycle",
)
GENERIC_NAMES = (
    "get", "set", "constructor", "handler", "run", "init", "start", "stop", "create", "update",
    "delete", "remove", "find", "next", "done", "callback", "apply", "call", "bind",
    "toString", "valueOf", "default", "export", "module", "require", "import",
)
# Patterns that name a function in an error text, with rank and shortest length.
EXPLICIT = (
    (1, r"(?U)\[(\w+)\]", 4),
    (2, r"(?U)(\w+)\s+is not a function", 4),
    (2, r"(?U)Cannot read propert\w+ of (\w+)", 4),
    (2, r"(?U)at\s+(\w+)\s+\(", 4),
    (2, r"(?U)in\s+'(\w+)\s*\(", 4),
    (2, r"(?U)in\s+(\w+)\s+\(", 4),
    (3, r"(?U)[Tt]he\s+(\w+(?:[A-Z]\w+)+)\s+(?:service|function|method|class|module|component)", 1),
)
INDEXED = (
    (4, r"(?U)\b([a-z]+(?:[A-Z][a-z]+)+)\b", 7),
    (5, r"(?U)\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b", 7),
)


def decoded(text: Column) -> Column:
    """HTML entities and escaped line breaks of chat exports undone."""
    for mark, plain in (
        ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&#39;", "'"), ("&quot;", '"'),
        ("\\n", " "), ("\\r", ""),
    ):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def _found(errors: DataFrame, rules) -> DataFrame:
    """Names captured by the patterns: (error_id, name, step, pos)."""
    out = None
    for step, pattern, least in rules:
        one = errors.select(
            "error_id", F.lit(step).alias("step"), F.posexplode(F.regexp_extract_all("text", F.lit(pattern), 1)).alias("pos", "name")
        ).where((F.octet_length("name") >= least) & ~F.col("name").isin(*NO_NAMES))
        out = one if out is None else out.unionByName(one)
    return out


def _whole_word(text: Column, name: Column) -> Column:
    """Whether the first place of ``name`` in ``text`` is a whole word (null if absent)."""
    at = F.instr(text, name)
    before = F.substring(text, at - 1, F.lit(1))
    after = F.substring(text, at + F.length(name), F.lit(1))
    alone = ((at == 1) | ~before.rlike("^[a-zA-Z0-9]$")) & ~after.rlike("^[a-zA-Z0-9]$")
    return F.when(at > 0, alone)


def candidate_functions(errors: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions an error text points at, in order of trust: ``(error_id, name, step, rank)``.

    ``errors(error_id, text)``, ``functions(name, file, body)``. Step 0 are functions
    of files named in the text (only when no strong candidate exists), 1-3 names the
    text marks itself, 4-6 names known from the index, 7 and 8 keyword fallbacks.
    """
    # every stage is used more than once, so it is written down instead of planned again
    e = errors.select("error_id", decoded(F.col("text")).alias("text")).withColumn("low", F.lower("text"))
    e, names = cut_lineage(e), cut_lineage(functions.select("name").distinct())
    explicit = _found(e, EXPLICIT)
    indexed = _found(e, INDEXED).join(names, "name", "left_semi")
    long_names = names.where(F.octet_length("name") > 5).withColumn("_l", F.lower("name"))
    inside = contains_join(e, "low", long_names, "_l")
    inside = inside.where(_whole_word(F.col("low"), F.col("_l"))).select(
        "error_id", F.lit(6).alias("step"), F.lit(0).alias("pos"), "name"
    )
    direct = cut_lineage(explicit.unionByName(indexed).unionByName(inside))

    none = e.join(direct.select("error_id").distinct(), "error_id", "left_anti")
    words = none.select(
        "error_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"([A-Z][a-zA-Z]{5,}|[a-z][a-z_]{5,}[a-z])"), 1)).alias("pos", "word")
    ).where(~F.col("word").isin(*NO_WORDS))
    words = cut_lineage(words.withColumn("_w", F.lower("word")))
    vocab = words.select("_w").distinct()
    by_name = contains_join(names.withColumn("_l", F.lower("name")), "_l", vocab, "_w").select("_w", "name")
    by_name = top_k(by_name.distinct(), ["_w"], [F.col("name")], 3)
    bodies = functions.select("name", F.lower("body").alias("_b"))
    by_body = contains_join(bodies, "_b", vocab, "_w").select("_w", "name").distinct()
    by_body = top_k(by_body, ["_w"], [F.col("name")], 3)
    hits = cut_lineage(
        words.join(by_name, "_w").select("error_id", "pos", "name", F.lit(7).alias("step")).unionByName(
            words.join(by_body, "_w").select("error_id", "pos", "name", F.lit(8).alias("step"))
        )
    )
    # the first word with a hit may use bodies when no name matches; later words use names only
    first = hits.groupBy("error_id").agg(F.min(F.struct("pos", "step")).alias("f"))
    used = hits.join(first, "error_id").where("step = 7 or (pos = f.pos and f.step = 8)")
    once = cut_lineage(used.groupBy("error_id", "name").agg(F.min(F.struct("pos", "step")).alias("p")))
    per_word = once.groupBy("error_id", F.col("p.pos").alias("pos")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("error_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    full = per_word.withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0))).where("_before < 3")
    fallback = once.select("error_id", F.col("p.pos").alias("pos"), F.col("p.step").alias("step"), "name").join(
        full.select("error_id", "pos"), ["error_id", "pos"], "left_semi"
    )
    found = direct.unionByName(fallback.select("error_id", "step", "pos", "name"))
    found = cut_lineage(found.groupBy("error_id", "name").agg(F.min(F.struct("step", "pos")).alias("b")))

    strong_rows = found.join(names, "name", "left_semi").join(e.select("error_id", "low"), "error_id")
    whole = _whole_word(F.col("low"), F.lower("name"))
    strong = strong_rows.where(
        ~F.col("name").isin(*GENERIC_NAMES) & (F.octet_length("name") > 3)
        & F.coalesce(whole, F.octet_length("name") > 8)
    ).select("error_id").distinct()
    weak = e.join(strong, "error_id", "left_anti")
    keys = weak.select(
        "error_id", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(r"(?U)\b([a-zA-Z]{4,})\b"), 1))).alias("_k")
    ).where(~F.col("_k").isin(*NO_KEYWORDS))
    keys = cut_lineage(keys)
    files = functions.where(~F.col("file").contains("test") & ~F.col("file").contains("__mock")).select(
        "name", "file", F.lower("file").alias("_f")
    ).distinct()
    in_path = contains_join(files, "_f", keys.select("_k").distinct(), "_k").select("_k", "name", "file")
    in_path = top_k(in_path, ["_k"], [F.col("file"), F.col("name")], 5)
    boosted = (
        keys.join(in_path, "_k").where(~F.col("name").isin(*GENERIC_NAMES) & (F.octet_length("name") > 3))
        .select("error_id", "name").distinct().join(found.select("error_id", "name"), ["error_id", "name"], "left_anti")
        .select("error_id", "name", F.struct(F.lit(0).alias("step"), F.lit(0).alias("pos")).alias("b"))
    )
    every = boosted.unionByName(found)
    order = Window.partitionBy("error_id").orderBy("b.step", "b.pos", "name")
    return every.select("error_id", "name", F.col("b.step").alias("step"), F.row_number().over(order).alias("rank"))


# Words of validating code.
VALIDATION_MARKS = ("validate", "Validate", "Schema")


def upstream_trace(targets: DataFrame, functions: DataFrame, calls: DataFrame, imports: DataFrame, uses: DataFrame) -> DataFrame:
    """Files that feed each target function and whether they validate.

    ``targets(id)``, ``calls(src, dst)``, ``imports(importer, name)`` and
    ``uses(file)`` (files with a USES_VALIDATION function). A file without
    validation outside ``src/`` is a root-cause candidate. Imports are computed once; targets are shuffled, as
    they may be all functions.
    """
    with freed_shuffles(imports.sparkSession):
        imports = cut_lineage(imports.select("importer", "name"))
    f = shuffled(functions.select("id", "name", "file"))
    t = targets.select("id").distinct().join(f, "id")
    callers = calls.join(shuffled(t.select(F.col("id").alias("dst"))), "dst").join(
        f.select(F.col("id").alias("src"), F.col("file").alias("upstream")), "src"
    ).select(F.col("dst").alias("id"), "upstream")
    importers = imports.join(shuffled(t.select("id", "name")), "name").select("id", F.col("importer").alias("upstream"))
    up = callers.unionByName(importers).distinct()
    by_import = imports.where(any_of(F.col("name"), VALIDATION_MARKS)).select(F.col("importer").alias("upstream")).distinct()
    by_use = uses.select(F.col("file").alias("upstream")).distinct()
    marked = up.join(broadcast_if_small(by_import.withColumn("_i", F.lit(True))), "upstream", "left").join(
        broadcast_if_small(by_use.withColumn("_u", F.lit(True))), "upstream", "left"
    )
    ok = F.coalesce("_i", F.lit(False)) | F.coalesce("_u", F.lit(False))
    return marked.select(
        "id", "upstream", ok.alias("validated"),
        (~F.coalesce("_i", F.lit(False)) & ~F.col("upstream").startswith("src/")).alias("root_cause"),
    )


def confidence(counts: DataFrame) -> DataFrame:
    """``counts(source, n)`` -> share of sources with data and its label."""
    out = counts.agg(F.count("*").alias("total"), F.count_if(F.col("n") > 0).alias("available"))
    pct = F.floor(F.col("available") / F.col("total") * 100)
    label = F.when(pct >= 80, "HIGH").when(pct >= 50, "MEDIUM").otherwise("LOW")
    return out.select("total", "available", pct.alias("percent"), label.alias("label"))


# Tools to look for in code and chat.
CODE_TOOLS = (
    ("datadog", "Datadog"), ("sentry", "Sentry"), ("@prisma", "Database queries"),
    ("prometheus", "Prometheus"), ("grafana", "Grafana"), ("pagerduty", "PagerDuty"),
    ("cloudwatch", "AWS CloudWatch"), ("newrelic", "New Relic"),
)
CHAT_TOOLS = (
    ("datadog", "Datadog"), ("grafana", "Grafana"), ("pagerduty", "PagerDuty"),
    ("cloudwatch", "CloudWatch"), ("new relic", "New Relic"), ("kibana", "Kibana/ELK"),
    ("splunk", "Splunk"), ("opsgenie", "OpsGenie"),
)


def blind_spots(bodies: DataFrame, chat: DataFrame, connected: DataFrame) -> DataFrame:
    """Tools named in code or chat without data: ``(tool, place, n)``; chat adds only
    tools the code does not name. ``bodies(body)``, ``chat(text)``, ``connected(tool)``."""

    def counted(df: DataFrame, col: str, tools, place: str) -> DataFrame:
        per = df.agg(*[F.count_if(F.lower(col).contains(w)).alias(f"c{i}") for i, (w, _) in enumerate(tools)])
        rows = F.array(*[F.struct(F.lit(t).alias("tool"), F.col(f"c{i}").alias("n")) for i, (_, t) in enumerate(tools)])
        return per.select(F.inline(rows)).where("n > 0").select("tool", F.lit(place).alias("place"), "n")

    code = counted(bodies, "body", CODE_TOOLS, "code").join(connected, "tool", "left_anti")
    said = counted(chat, "text", CHAT_TOOLS, "chat").join(connected, "tool", "left_anti")
    return code.unionByName(said.join(code.select("tool"), "tool", "left_anti"))


def people_with_context(targets: DataFrame, modified: DataFrame, activity: DataFrame, k: int = 3) -> DataFrame:
    """The last commits of each target with a note on inactive authors.

    ``activity(author, active, suggested)``.
    """
    mine = modified.withColumnRenamed("fn", "id").join(targets.select("id").distinct(), "id", "left_semi")
    last = top_k(mine, ["id"], [F.desc("date"), F.desc("commit")], k)
    note = F.when(F.coalesce("active", F.lit(True)), "").when(
        F.coalesce("suggested", F.lit("")) != "", F.concat(F.lit("no recent activity, try "), F.col("suggested"))
    ).otherwise("no recent activity")
    return last.join(activity, "author", "left").select("id", "commit", "author", note.alias("note"))


def test_coverage(files: DataFrame) -> DataFrame:
    """Source files and whether a test file's path contains their stem.

    The needles are the stems; a test path looks up its own substrings.
    """
    is_test = any_of(F.col("file"), (".test.", ".spec.", "__test__", "__tests__"))
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.(tsx|ts|js|py)", "")
    sources = files.where(~is_test).select("file", stem.alias("stem"))
    tests = files.where(is_test).select(F.col("file").alias("test_file"))
    hit = contains_join(tests, "test_file", sources.select("stem").where("stem <> ''").distinct(), "stem", min_length=1)
    covered = hit.select("stem").distinct().withColumn("_t", F.lit(True))
    return sources.join(covered, "stem", "left").select("file", "stem", F.coalesce("_t", F.lit(False)).alias("covered"))


# --- scoring ------------------------------------------------------------------------------


def score_diagnoses(cases: DataFrame) -> DataFrame:
    """``cases(case_id, diagnosis, root_cause_file, must_mention, category)`` -> points and grade."""
    d, low = F.col("diagnosis"), F.lower("diagnosis")
    file = F.coalesce("root_cause_file", F.lit(""))
    parts = F.filter(F.split(file, "/"), lambda p: F.length(p) > 3)
    file_points = (
        F.when(file == "", 0).when(d.contains(file), 3)
        .when(F.exists(parts, lambda p: d.contains(p)), 1).otherwise(0)
    )
    n = F.size("must_mention")
    hits = F.size(F.filter("must_mention", lambda k: low.contains(F.lower(k))))
    keyword_points = F.when(n > 0, F.bround(hits / n * 4)).otherwise(0).cast("int")
    category_points = F.when((F.col("category") != "") & low.contains(F.lower("category")), 2).otherwise(0)
    ends = F.when(d.contains("CONCLUSION") | d.contains("ROOT CAUSE"), 1).otherwise(0)
    s = F.col("score")
    grade = F.when(s >= 8, "CORRECT").when(s >= 5, "PARTIAL").when(s >= 3, "DIRECTION").otherwise("WRONG")
    scored = cases.withColumn("score", (file_points + keyword_points + category_points + ends).cast("int"))
    return scored.withColumn("grade", grade)


def accuracy(scored: DataFrame, by: str | None = None) -> DataFrame:
    """Whole percents of strict, useful and category accuracy and the Wilson bounds of strict."""
    g = F.col("grade")
    keys = [by] if by else []
    out = scored.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count_if(g == "CORRECT").alias("_c"),
        F.count_if(g.isin("CORRECT", "PARTIAL")).alias("_u"),
        F.count_if(g.isin("CORRECT", "PARTIAL", "DIRECTION")).alias("_d"),
    )
    n, z = F.col("cases"), 1.96
    p = F.col("_c") / n
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    down = 1 + z * z / n
    return out.select(
        *keys, "cases",
        *[F.floor(F.col(c) * 100 / n).alias(name) for c, name in (("_c", "strict"), ("_u", "useful"), ("_d", "category_accuracy"))],
        ((p + z * z / (2 * n) - half) / down).alias("wilson_low"),
        ((p + z * z / (2 * n) + half) / down).alias("wilson_high"),
    )
