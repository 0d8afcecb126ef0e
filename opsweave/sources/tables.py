"""Plain tables and the mapping of the star-schema tables to domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsweave.functions.sizes import shuffled


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with an instant ``ts``, epoch seconds ``t`` and the number ``k`` of the props."""
    e = load(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        "event_id",
        ts.alias("ts"),
        (F.unix_micros(ts) / F.lit(1_000_000)).alias("t"),
        "user_id",
        "event_type",
        "value",
        "props",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def action_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agent-action events: the event type is the tool, type and props the command."""
    e = events(spark, sf_dir)
    return e.select(
        "event_id",
        "ts",
        "t",
        F.col("user_id").alias("session"),
        F.col("event_type").alias("tool"),
        F.concat_ws(" ", "event_type", "props").alias("command"),
        F.col("value").alias("amount"),
        "k",
        F.date_format("ts", "EEEE").alias("day_of_week"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines: every line of every document; namespace = lang, pod = source."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.col("lang").alias("namespace"),
        F.col("source").alias("pod"),
        F.col("doc_id").alias("doc_id"),
        F.posexplode(F.split("text", "\n")).alias("pos", "line"),
    ).withColumn("ts", F.col("doc_id") * 60 + F.least(F.col("pos"), F.lit(59)))


def call_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct caller/callee pairs: the part on line n calls the part on line n + 1
    of the same order. Lines are dealt out once, for their distinct rows and for the join."""
    li = load(spark, sf_dir, "lineitem")
    a = li.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("src"))
    b = li.select(
        "l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_partkey").alias("dst")
    )
    place = ["l_orderkey", "n"]
    pairs = a.repartition(*place).distinct().join(b.repartition(*place).distinct().hint("merge"), place)
    return pairs.where(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions of the code graph: a part is a function, its brand and size the file."""
    p = load(spark, sf_dir, "part")
    return shuffled(p).select(
        F.col("p_partkey").alias("id"),
        F.concat_ws("_", F.regexp_replace("p_name", " ", "_"), F.col("p_partkey")).alias("name"),
        F.concat(
            F.lit("src/"), F.regexp_replace("p_brand", "#", "/"), F.lit("/m"),
            F.col("p_size").cast("string"), F.lit(".py"),
        ).alias("file"),
        F.col("p_size").alias("line"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits: order = commit, customer = author, priority and status = message."""
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("commit"),
        F.col("o_custkey").alias("author"),
        F.col("o_orderdate").cast("timestamp").alias("date"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("message"),
    )


def modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function changes ``(commit, fn, author, date, message)``: the parts of an order."""
    li = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("fn")
    )
    return li.distinct().join(commits(spark, sf_dir), "commit")


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File changes ``(commit, file, change, author, date, message)``; return flag = change."""
    li = load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("id"),
        F.col("l_returnflag").alias("flag"),
    )
    change = F.when(F.col("flag") == "R", "D").when(F.col("flag") == "A", "A").otherwise("M")
    files = li.join(functions(spark, sf_dir).select("id", "file"), "id")
    per = files.groupBy("commit", "file").agg(F.min(change).alias("change"))
    return per.join(commits(spark, sf_dir), "commit")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: a conversation is a channel, a turn a message, the role the user."""
    c = load(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("channel"),
        F.col("turn").alias("ts"),
        F.col("role").alias("user"),
        "text",
    )


def pod_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log line per event; namespace and pod follow from the user."""
    e = events(spark, sf_dir)
    s = {c: F.col(c).cast("string") for c in ("event_id", "user_id", "k", "value")}
    md = F.md5(s["event_id"])
    uuid = F.concat_ws(
        "-", *[F.substring(md, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    lit = F.lit
    line = (
        F.when(
            F.col("event_type") == "error",
            F.concat(lit("ERROR request "), uuid, lit(" from 10.0."), s["user_id"], lit("."), s["k"],
                     lit(":80 failed")),
        )
        .when(
            F.col("event_type") == "click",
            F.concat(lit("WARN slow click 0xab"), s["k"], lit(" of svc-"), s["k"], lit(" took "), s["event_id"]),
        )
        .when(
            F.col("event_type") == "purchase",
            F.concat(lit("gateway of svc-"), s["k"], lit(": connection refused, order "), s["event_id"]),
        )
        .when(F.col("event_type") == "view", F.concat(lit("DEBUG healthz ok, error count "), s["k"]))
        .when(F.col("k") < 50, F.concat(lit("FATAL cannot create user-"), s["user_id"]))
        .otherwise(F.concat(lit("signup done "), s["k"]))
    )
    return e.select(
        F.concat(lit("ns"), (F.col("user_id") % 10).cast("string")).alias("namespace"),
        F.concat(lit("pod-"), s["user_id"]).alias("pod"),
        F.col("t").alias("ts"),
        "event_id",
        line.alias("line"),
    )


def journal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-format journal lines of the pod lines; host = namespace, unit = pod."""
    p = pod_log_lines(spark, sf_dir)
    stamp = F.date_format(F.timestamp_seconds("ts"), "MMM dd HH:mm:ss")
    unit = F.concat(F.col("pod"), F.lit("["), F.col("event_id").cast("string"), F.lit("]:"))
    return p.select(
        F.col("namespace").alias("hostname"), "ts", F.col("event_id").alias("line_id"),
        F.concat_ws(" ", stamp, unit, "line").alias("line"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a host line; hostname = source."""
    d = load(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("hostname"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")
    ).withColumn("ts", F.col("doc_id").cast("double"))
