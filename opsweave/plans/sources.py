"""Source readers on texts that are built from the given tables, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.plans.codegraph import SQL_FN, sql_calls
from opsweave.plans.policy import SQL_EVENTS
from opsweave.plans.registry import query
from opsweave.sources import readers as R
from opsweave.sources import tables as T


def code_index(spark, sf):
    """One index document per function: itself and, if it calls any, its smallest callee's call site."""
    f = T.functions(spark, sf)
    callee = f.select(F.col("id").alias("dst"), F.col("name").alias("callee_name"))
    first = T.call_pairs(spark, sf).groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("dst")).join(callee, "dst")
    d = f.join(first, "id", "left")
    entity = F.struct(F.lit("function").alias("kind"), "name", "file", "line", F.array(F.lit("a"), F.lit("b")).alias("params"))
    site = F.struct(F.col("file").alias("caller_file"), F.col("name").alias("caller_name"), "callee_name")
    sites = F.when(F.col("callee_name").isNotNull(), F.array(site)).otherwise(F.array().cast("array<struct<caller_file:string,caller_name:string,callee_name:string>>"))
    text = F.to_json(F.struct(F.lit("shop").alias("repo"), F.lit(1).alias("files"), F.array(entity).alias("entities"), sites.alias("call_sites")))
    broken = F.when(F.col("id") % 9 == 0, F.substring(text, 1, 20)).otherwise(text)
    return R.code_index_rows(R.parsed(d.select(broken.alias("value")), R.CODE_INDEX))


@query("read_code_entities", "SRC1", f"WITH {SQL_FN} SELECT 'shop' AS repo, 'function' AS kind, name, file, line, 'a,b' AS params FROM fn WHERE id % 9 <> 0")
def code_entities(spark, sf):
    return code_index(spark, sf)[0].select("repo", "kind", "name", "file", "line", F.array_join("params", ",").alias("params"))


@query(
    "read_call_sites",
    "SRC1",
    f"""WITH {SQL_FN}, {sql_calls()}, c AS (SELECT src, min(dst) AS dst FROM calls GROUP BY 1)
    SELECT 'shop' AS repo, a.file AS caller_file, a.name AS caller_name, b.name AS callee_name FROM c JOIN fn a ON a.id = src JOIN fn b ON b.id = dst WHERE a.id % 9 <> 0""",
)
def call_sites(spark, sf):
    return code_index(spark, sf)[1]


@query(
    "read_audit_lines",
    "SRC2",
    f"""WITH {SQL_EVENTS} SELECT event_type AS tool, count(*) AS n, sum(octet_length(encode('u' || user_id)))::BIGINT AS size FROM ev
    WHERE event_id % 10 <> 0 AND t >= 1705000000 GROUP BY 1""",
)
def audit_lines(spark, sf):
    e = T.events(spark, sf)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = F.to_json(F.struct(stamp.alias("ts"), F.col("event_type").alias("tool"), F.concat(F.lit("u"), F.col("user_id")).alias("detail")))
    broken = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), line)).otherwise(line)
    rows = R.timed_rows(R.parsed(e.select(broken.alias("value")), R.AUDIT), "2024-01-11T19:06:40Z")
    return rows.groupBy("tool").agg(F.count("*").alias("n"), F.sum(F.octet_length("detail")).alias("size"))


def commit_texts(spark, sf):
    """One log block per order: five header lines, then a line per item."""
    li = T.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("M\tsrc/p"), F.col("l_partkey"), F.lit("_"), F.col("l_linenumber")))), "\n").alias("files")
    )  # an order has few items
    o = T.load(spark, sf, "orders").join(li, "o_orderkey", "left").fillna("", ["files"])
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return o.select(F.concat_ws("\n", F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), F.col("o_custkey")), F.lit("x@y.z"), day, F.col("o_orderpriority"), F.lit("not a file line"), F.col("files")).alias("value"))


@query(
    "read_commits",
    "SRC4",
    """WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey::VARCHAR AS hash, 'c' || o_custkey AS author, 'x@y.z' AS email, epoch(o_orderdate)::BIGINT AS date, o_orderpriority AS message, coalesce(n, 0)::INTEGER AS files_changed
    FROM orders LEFT JOIN n ON k = o_orderkey""",
)
def commits(spark, sf):
    return R.commit_rows(commit_texts(spark, sf))[0].withColumn("date", F.unix_timestamp("date"))


@query("read_commit_files", "SRC4", "SELECT l_orderkey::VARCHAR AS hash, 'M' AS change, 'src/p' || l_partkey || '_' || l_linenumber AS path FROM lineitem")
def commit_files(spark, sf):
    return R.commit_rows(commit_texts(spark, sf))[1]


@query(
    "read_chat_messages",
    "SRC5",
    """SELECT 'C' || conv_id AS channel_id, 'chan-' || conv_id AS channel, turn::DOUBLE AS ts, text, role AS "user", (turn % 3)::INTEGER AS reply_count
    FROM conversations WHERE text <> ''""",
)
def chat_messages(spark, sf):
    c = T.load(spark, sf, "conversations")
    message = F.struct(F.col("turn").cast("string").alias("ts"), "text", F.col("role").alias("user"), F.when(F.col("turn") % 3 > 0, (F.col("turn") % 3).cast("int")).alias("reply_count"))
    k = F.col("conv_id").cast("string")
    text = F.to_json(F.struct(F.concat(F.lit("C"), k).alias("channel_id"), F.concat(F.lit("chan-"), k).alias("channel_name"), F.array(message).alias("messages")))
    return R.chat_rows(R.parsed(c.select(text.alias("value")), R.CHAT)).select("channel_id", "channel", "ts", "text", "user", "reply_count")


@query(
    "read_tickets",
    "SRC6",
    """SELECT 'SHOP-' || c_custkey AS key, c_name AS summary, c_mktsegment AS status, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'P' || c_nationkey END AS assignee,
    CASE WHEN c_custkey % 3 = 0 THEN 'SHOP-' || c_custkey // 3 ELSE '' END AS parent FROM customer""",
)
def tickets(spark, sf):
    c, k = T.load(spark, sf, "customer"), F.col("c_custkey")
    fields = F.struct(
        F.col("c_name").alias("summary"), F.struct(F.col("c_mktsegment").alias("name")).alias("status"),
        F.when(k % 4 != 0, F.struct(F.concat(F.lit("P"), F.col("c_nationkey")).alias("displayName"))).alias("assignee"),
        F.when(k % 3 == 0, F.struct(F.concat(F.lit("SHOP-"), F.floor(k / 3)).alias("key"))).alias("parent"),
    )
    text = F.to_json(F.struct(F.concat(F.lit("SHOP-"), k).alias("key"), fields.alias("fields")))
    return R.ticket_rows(R.parsed(c.select(text.alias("value")), R.TICKETS)).select("key", "summary", "status", "assignee", "parent")


def issue_texts(spark, sf):
    o, k = T.load(spark, sf, "orders"), F.col("o_orderkey")
    frames = F.array(
        F.struct((k % 2 == 0).alias("inApp"), F.concat(F.lit("fn_"), F.col("o_custkey")).alias("function"), F.lit("a.py").alias("filename"), (k % 50).cast("int").alias("lineNo")),
        F.struct(F.lit(True).alias("inApp"), F.lit("").alias("function"), F.lit("b.py").alias("filename"), F.lit(1).alias("lineNo")),
    )
    value = F.struct(F.lit("TypeError").alias("type"), F.col("o_orderpriority").alias("value"), F.struct(frames.alias("frames")).alias("stacktrace"))
    entry = F.struct(F.when(k % 5 == 0, "message").otherwise("exception").alias("type"), F.struct(F.array(value).alias("values")).alias("data"))
    text = F.to_json(F.struct(
        k.cast("string").alias("id"), F.col("o_orderpriority").alias("title"), F.when(k % 7 == 0, "many").otherwise((k % 90).cast("string")).alias("count"),
        F.array(entry).alias("entries"),
    ))
    return R.issue_rows(R.parsed(o.select(text.alias("value")), R.ISSUES))


@query("read_issues", "SRC7", "SELECT o_orderkey::VARCHAR AS issue_id, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 90 END AS count, 'error' AS level FROM orders")
def issues(spark, sf):
    return issue_texts(spark, sf)[0].select("issue_id", "count", "level")


@query(
    "read_issue_frames",
    "SRC7",
    """SELECT o_orderkey::VARCHAR AS issue_id, 'TypeError' AS exception_type, o_orderpriority AS exception_value, 'fn_' || o_custkey AS function, 'a.py' AS filename, (o_orderkey % 50)::INTEGER AS line
    FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0""",
)
def issue_frames(spark, sf):
    return issue_texts(spark, sf)[1]


@query(
    "read_pull_requests",
    "SRC8",
    """SELECT o_orderkey AS number, o_orderpriority AS title, o_orderstatus AS state, 'c' || o_custkey AS author, epoch(o_orderdate)::BIGINT AS created,
    coalesce(CASE WHEN o_orderstatus = 'F' THEN epoch(o_orderdate)::BIGINT END, -1) AS merged FROM orders WHERE o_orderkey <> 0""",
)
def pull_requests(spark, sf):
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.to_json(F.struct(
        F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("state"),
        F.struct(F.concat(F.lit("c"), F.col("o_custkey")).alias("login")).alias("author"), day.alias("createdAt"),
        F.when(F.col("o_orderstatus") == "F", day).otherwise("").alias("mergedAt"),
    ))
    p = R.pull_rows(R.parsed(T.load(spark, sf, "orders").select(text.alias("value")), R.PULLS), "shop")
    return p.select("number", "title", "state", "author", F.unix_timestamp("created").alias("created"), F.coalesce(F.unix_timestamp("merged"), F.lit(-1)).alias("merged"))


@query(
    "read_probe_history",
    "SRC11",
    f"""WITH {SQL_EVENTS} SELECT event_type AS target, count(*) AS n, count(*) FILTER (k >= 5) AS reachable, max(k)::DOUBLE AS loss FROM ev WHERE event_id % 11 <> 0 GROUP BY 1""",
)
def probe_history(spark, sf):
    e = T.events(spark, sf)
    text = F.to_json(F.struct(F.col("t").cast("long").alias("timestamp"), F.col("event_type").alias("target"), F.col("k").cast("double").alias("loss_pct"), (F.col("k") >= 5).alias("reachable")))
    broken = F.when(F.col("event_id") % 11 == 0, F.lit("not json")).otherwise(text)
    rows = R.parsed(e.select(broken.alias("value")), R.PROBES)
    return rows.groupBy("target").agg(F.count("*").alias("n"), F.count_if("reachable").alias("reachable"), F.max("loss_pct").alias("loss"))
