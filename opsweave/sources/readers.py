"""File sources: code index, audit logs, cluster objects, commit logs, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsweave.operators.inventory import POD_SCHEMA
from opsweave.sources.growing import blocks

ENTITY = (
    "struct<kind: string, name: string, file: string, line: int, end_line: int, body: string, "
    "params: array<string>, import_source: string, import_names: array<string>>"
)
CODE_INDEX = (
    f"repo string, files int, entities array<{ENTITY}>, "
    "call_sites array<struct<caller_file: string, caller_name: string, callee_name: string>>"
)
AUDIT = "ts string, tool string, action string, reason string, detail string"
TOOL_CALLS = "ts string, tool string, duration_ms long, tokens long, ok boolean"
MCP_CALLS = "ts string, mcp_server string, tool_name string, arguments_hash string"
PROBES = (
    "timestamp long, target string, host string, loss_pct double, avg_ms double, max_ms double, "
    "jitter_ms double, reachable boolean"
)
PATHS = (
    "timestamp long, signal_dbm long, path array<struct<hop: string, host: string, "
    "latency_avg_ms: double, latency_max_ms: double, jitter_ms: double, loss_pct: double>>"
)
CHAT = (
    "channel_id string, channel_name string, messages array<struct<ts: string, text: string, "
    "user: string, thread_ts: string, reply_count: int>>"
)
NAMED = "struct<name: string>"
PERSON = "struct<displayName: string>"
TICKETS = (
    f"key string, fields struct<summary: string, status: struct<name: string, statusCategory: {NAMED}>, "
    f"assignee: {PERSON}, reporter: {PERSON}, priority: {NAMED}, issuetype: {NAMED}, created: string, "
    f"updated: string, resolution: {NAMED}, parent: struct<key: string>>"
)
FRAMES = "array<struct<inApp: boolean, function: string, filename: string, lineNo: int>>"
ISSUES = (
    "id string, title string, count string, level string, project struct<slug: string>, "
    "firstSeen string, lastSeen string, shortId string, entries array<struct<type: string, "
    f"data: struct<values: array<struct<type: string, value: string, stacktrace: struct<frames: {FRAMES}>>>>>>"
)
PULLS = (
    "number long, title string, state string, author struct<login: string>, createdAt string, "
    "mergedAt string, closedAt string, headRefName string, url string"
)


def parsed(texts: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON texts, one object each, as typed columns; bad texts are skipped."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = texts.select(F.from_json(value, f"{schema}, _bad string", options).alias("j"))
    return rows.where("j is not null and j._bad is null").select("j.*").drop("_bad")


def code_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, call_sites) of code index documents."""
    return code_index_rows(spark.read.schema(CODE_INDEX).json(path, multiLine=True))


def code_index_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    return raw.select("repo", F.inline("entities")), raw.select("repo", F.inline("call_sites"))


def jsonl(spark: SparkSession, path: str, schema: str, since: str | None = None) -> DataFrame:
    """A JSON-lines log; bad lines are skipped. ``since`` filters on an RFC 3339 ``ts``."""
    return timed_rows(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path), since)


def timed_rows(raw: DataFrame, since: str | None = None) -> DataFrame:
    df = raw.withColumn("ts", F.try_to_timestamp("ts"))
    return df if since is None else df.where(F.col("ts") >= F.lit(since).cast("timestamp"))


def rejected(texts: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """The rows whose text ``parsed`` skips, as they are: the side output for bad lines."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    j = F.from_json(value, f"{schema}, _bad string", options)
    return texts.where(j.isNull() | j["_bad"].isNotNull())


def jsonl_stream(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON-lines files that grow: (rows with ``event_time`` from ``ts``, bad lines with their place)."""
    lines = blocks(spark, path, stream=True)
    return parsed(lines, schema).withColumn("event_time", F.try_to_timestamp("ts")), rejected(lines, schema)


def commit_stream(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(commits, file_changes) of log texts that grow; a commit comes once the next one has begun."""
    return commit_rows(blocks(spark, path, start="COMMIT_START", stream=True))


def cluster_pods(spark: SparkSession, path: str) -> DataFrame:
    """Raw pod objects of a cluster dump ``{"items": [...]}``."""
    raw = spark.read.schema(f"items array<struct<{_as_fields(POD_SCHEMA)}>>").json(path, multiLine=True)
    return raw.select(F.inline("items"))


def _as_fields(ddl: str) -> str:
    """Top-level ``name type`` pairs of a schema text as ``name: type`` struct fields."""
    out = ddl.strip()
    for name in ("metadata", "spec", "status"):
        out = out.replace(f"{name} struct<", f"{name}: struct<", 1)
    return out


def commit_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(commits, file_changes) of a log text: blocks start with ``COMMIT_START``, then
    hash, author, email, date, subject and ``M/A/D/R<tab>path`` lines."""
    return commit_rows(spark.read.option("lineSep", "COMMIT_START\n").text(path))


def commit_rows(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from one text block ``value`` per commit."""
    blocks = blocks.where(F.trim("value") != "")
    part = F.split("value", "\n")
    rows = blocks.select(
        F.get(part, F.lit(0)).alias("hash"), F.get(part, F.lit(1)).alias("author"),
        F.get(part, F.lit(2)).alias("email"), F.try_to_timestamp(F.get(part, F.lit(3))).alias("date"),
        F.get(part, F.lit(4)).alias("message"),
        F.filter(
            F.transform(F.slice(part, 6, F.greatest(F.size(part), F.lit(1))), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")),
            lambda x: x.rlike(r"^[MADR]\S*\s+\S"),
        ).alias("lines"),
    ).where("hash <> ''")
    commits = rows.select("hash", "author", "email", "date", "message", F.size("lines").alias("files_changed"))
    each = rows.select("hash", F.explode("lines").alias("line"))
    changes = each.select(
        "hash", F.substring("line", 1, 1).alias("change"),
        F.regexp_replace("line", r"^.\s*", "").alias("path"),
    )
    return commits, changes


def chat_export(spark: SparkSession, path: str) -> DataFrame:
    """Messages of channel exports; empty ones are skipped, text is kept whole."""
    return chat_rows(spark.read.schema(CHAT).json(path, multiLine=True))


def chat_rows(raw: DataFrame) -> DataFrame:
    m = raw.select("channel_id", F.col("channel_name").alias("channel"), F.inline("messages"))
    return m.where("ts <> '' and text <> ''").withColumns(
        {"ts_key": F.col("ts"), "ts": F.col("ts").try_cast("double"), "reply_count": F.coalesce("reply_count", F.lit(0))}
    )


def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def ticket_export(spark: SparkSession, path: str) -> DataFrame:
    return ticket_rows(spark.read.schema(TICKETS).json(path))


def ticket_rows(raw: DataFrame) -> DataFrame:
    f = "fields."
    return raw.where("key <> ''").select(
        "key", _text(f + "summary").alias("summary"), _text(f + "status.name").alias("status"),
        _text(f + "status.statusCategory.name").alias("status_category"),
        _text(f + "assignee.displayName").alias("assignee"), _text(f + "reporter.displayName").alias("reporter"),
        _text(f + "priority.name").alias("priority"), _text(f + "issuetype.name").alias("type"),
        _text(f + "created").alias("created"), _text(f + "updated").alias("updated"),
        _text(f + "resolution.name").alias("resolution"), _text(f + "parent.key").alias("parent"),
    )


def issue_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(issues, in-app frames) of error-tracker exports."""
    return issue_rows(spark.read.schema(ISSUES).json(path))


def issue_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    raw = raw.where("id <> ''")
    issues = raw.select(
        F.col("id").alias("issue_id"), _text("title").alias("title"),
        F.coalesce(F.col("count").try_cast("long"), F.lit(0)).alias("count"),
        F.coalesce("level", F.lit("error")).alias("level"), _text("project.slug").alias("project"),
        F.substring("firstSeen", 1, 19).alias("first_seen"), F.substring("lastSeen", 1, 19).alias("last_seen"),
        _text("shortId").alias("short_id"),
    )
    values = raw.select(F.col("id").alias("issue_id"), F.inline("entries")).where("type = 'exception'").select(
        "issue_id", F.explode("data.values").alias("v")
    )
    frames = values.select(
        "issue_id", F.col("v.type").alias("exception_type"), F.col("v.value").alias("exception_value"),
        F.inline("v.stacktrace.frames"),
    )
    kept = frames.where("inApp and function <> ''").select(
        "issue_id", "exception_type", "exception_value", "function", _text("filename").alias("filename"),
        F.coalesce("lineNo", F.lit(0)).alias("line"),
    )
    return issues, kept


def pull_requests(spark: SparkSession, path: str, repo: str) -> DataFrame:
    return pull_rows(spark.read.schema(PULLS).json(path), repo)


def pull_rows(raw: DataFrame, repo: str) -> DataFrame:
    return raw.where("number <> 0").select(
        F.lit(repo).alias("repo"), "number", _text("title").alias("title"), _text("state").alias("state"),
        _text("author.login").alias("author"), _text("headRefName").alias("branch"),
        *[F.try_to_timestamp(F.nullif(F.col(c), F.lit(""))).alias(n) for c, n in
          (("createdAt", "created"), ("mergedAt", "merged"), ("closedAt", "closed"))],
        _text("url").alias("url"),
    )


def documents(spark: SparkSession, path: str, pattern: str = "*.{md,astro}") -> DataFrame:
    """Whole files with their path, one row each."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return df.select(F.input_file_name().alias("file"), F.col("value").alias("content"))


def billing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def probe_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBES).option("mode", "DROPMALFORMED").json(path)


def network_paths(spark: SparkSession, path: str) -> DataFrame:
    """One row per hop of every path sample."""
    return path_rows(spark.read.schema(PATHS).option("mode", "DROPMALFORMED").json(path))


def path_rows(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("timestamp").alias("ts"), "signal_dbm", F.posexplode("path").alias("hop_no", "h")).select(
        "ts", "signal_dbm", "hop_no", "h.hop", "h.host", F.col("h.latency_avg_ms").alias("avg_ms"),
        F.col("h.latency_max_ms").alias("max_ms"), "h.jitter_ms", "h.loss_pct",
    )
