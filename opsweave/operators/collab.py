"""Chat, tickets, pull requests, issues and the personal radar."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.functions.ordered import top_k
from opsweave.functions.text import any_of, contains_join

# Words of symptoms, resolutions, commands and ops channels.
SYMPTOMS = (
    "502", "503", "500", "timeout", "slow", "down", "broken", "crash", "oom", "oomkill",
    "oomkilled", "restart", "crashloop", "unhealthy", "degraded", "latency", "error rate",
    "connection refused", "unreachable", "disk full", "memory", "cpu spike", "can't connect",
    "not responding",
)
RESOLUTIONS = (
    "fixed", "resolved", "deployed", "rolled back", "rollback", "reverted", "merged", "patched",
    "restarted", "recovered", "back to normal", "all clear", "issue resolved", "root cause",
)
COMMANDS = (
    "kubectl", "helm", "terraform", "docker", "k9s", "argocd", "aws ", "gcloud", "az ", "flux",
    "kustomize",
)
OPS_CHANNELS = ("ops", "infra", "alert", "incident", "oncall", "sre", "deploy", "prod")


def with_flags(messages: DataFrame) -> DataFrame:
    low = F.lower("text")
    return messages.withColumns(
        {
            "has_symptom": any_of(low, SYMPTOMS),
            "is_resolution": any_of(low, RESOLUTIONS),
            "has_command": any_of(low, COMMANDS),
        }
    )


def is_ops_channel(name: Column) -> Column:
    return any_of(F.lower(name), OPS_CHANNELS)


def thread_edges(messages: DataFrame) -> DataFrame:
    """Replies with their thread, and parents that have replies."""
    own = F.col("thread_ts") == F.col("ts")
    role = F.when(~own, "reply").when(own & (F.col("reply_count") > 0), "parent")
    return messages.select("ts", "thread_ts", role.alias("role")).where("role is not null")


def service_mentions(messages: DataFrame, services: DataFrame) -> DataFrame:
    """Messages that contain a known service name, ignoring case."""
    texts = messages.withColumn("_low", F.lower("text"))
    names = services.select(F.lower("name").alias("service")).where("service <> ''").distinct()
    return contains_join(texts, "_low", names, "service", min_length=1).drop("_low").distinct()


def user_activity(messages: DataFrame, now: float, days: int = 45) -> DataFrame:
    per = messages.groupBy("user").agg(F.max("ts").alias("last_active"))
    return per.withColumn("active", F.col("last_active") >= now - days * 86400)


def last_commits(commits: DataFrame) -> DataFrame:
    return commits.groupBy("author").agg(F.max("date").alias("last_commit"))


def suggested_contacts(mentions: DataFrame, activity: DataFrame) -> DataFrame:
    """For inactive users the active user with most shared service messages.

    Messages are counted per (user, service) before users meet.
    """
    per = mentions.groupBy("user", "service").agg(F.count("*").alias("n")).join(activity, "user")
    gone = per.where(~F.col("active")).select("user", "service", F.col("n").alias("_own"))
    here = per.where("active").select(F.col("user").alias("contact"), "service", "n")
    shared = gone.join(here, "service").groupBy("user", "contact").agg(F.sum(F.col("_own") * F.col("n")).alias("shared"))
    return shared.groupBy("user").agg(
        F.min(F.struct((-F.col("shared")).alias("neg"), "contact")).alias("b")
    ).select("user", F.col("b.contact").alias("suggested"), (-F.col("b.neg")).alias("shared"))


TICKET = r"\b([A-Z][A-Z0-9]*-\d+)\b"


def ticket_links(texts: DataFrame, key: str, tickets: DataFrame) -> DataFrame:
    """Rows whose text names an existing ticket key (as a whole word)."""
    found = texts.select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TICKET), 1))).alias("ticket"))
    return found.join(tickets.select(F.col("key").alias("ticket")), "ticket", "left_semi")


def parent_tickets(tickets: DataFrame) -> DataFrame:
    known = tickets.select(F.col("key").alias("parent"))
    return tickets.where("parent <> ''").select("key", "parent").join(known, "parent", "left_semi")


def pr_commits(prs: DataFrame, commits: DataFrame) -> DataFrame:
    """Commits that name ``#<number>`` of an existing PR."""
    found = commits.select(
        "commit", F.explode(F.array_distinct(F.regexp_extract_all("message", F.lit(r"#(\d+)"), 1))).alias("_n")
    ).select("commit", F.col("_n").cast("long").alias("number"))
    return found.join(prs.select("number").distinct(), "number", "left_semi")


def issue_functions(frames: DataFrame, functions: DataFrame) -> DataFrame:
    """Issue -> function by frame name (more than three characters)."""
    f = frames.where(F.octet_length("function") > 3).select("issue_id", F.col("function").alias("name")).distinct()
    return f.join(functions.select("id", "name"), "name").select("issue_id", "id")


def issue_messages(issues: DataFrame, messages: DataFrame) -> DataFrame:
    """Issue -> messages of the error channel that contain the first 50 characters of
    its title (longer than ten)."""
    titles = issues.where(F.octet_length("title") > 10).select("issue_id", F.lower(F.substring("title", 1, 50)).alias("_title"))
    texts = messages.where("channel = 'prod-errors'").select("msg_id", F.lower("text").alias("_low"))
    return contains_join(texts, "_low", titles, "_title").select("issue_id", "msg_id").distinct()


def resolve_identities(asked: DataFrame, users: DataFrame, authors: DataFrame) -> DataFrame:
    """Per asked text the first chat user (name or real name) and git author (name or
    email) that contains it."""
    q = asked.select(F.lower("who").alias("who")).distinct()

    def found(df: DataFrame, cols: Sequence[str], pick: str, label: str) -> DataFrame:
        out = None
        for c in cols:
            texts = df.select(F.col(pick).alias(label), F.lower(c).alias("_t"))
            hit = contains_join(texts, "_t", q, "who", min_length=1).select("who", label)
            out = hit if out is None else out.unionByName(hit)
        return out.groupBy("who").agg(F.min(label).alias(label))

    a = found(users, ["name", "real_name"], "user_id", "user_id")
    b = found(authors, ["name", "email"], "name", "git_author")
    return q.join(a, "who", "left").join(b, "who", "left").where("user_id is not null or git_author is not null")


def owned_services(modified_files: DataFrame) -> DataFrame:
    """``(author, file)`` -> service names: file stems of more than three characters."""
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.(ts|js|tsx|py)", "")
    return modified_files.select("author", stem.alias("service")).where(F.octet_length("service") > 3).distinct()




def radar(
    users: DataFrame, messages: DataFrame, owned: DataFrame, issues: DataFrame, tickets: DataFrame, since: float
) -> DataFrame:
    """What every user needs to know, most urgent first.

    ``users(user_id, user_name)``, ``messages(msg_id, ts, user, user_name, channel, text,
    has_symptom, reply_count)``, ``owned(user_id, service)``, ``issues(title, count, level,
    file, function)``, ``tickets(key, assignee)``. Each check keeps its own number of
    newest rows per user, service or ticket.
    """
    m = messages.where(F.col("ts") >= since)
    newest = [F.desc("ts"), F.col("msg_id")]
    question = F.col("text").contains("?")
    cols = ["user_id", "urgency", "category", "about", "channel", "msg_id"]

    tagged = m.withColumn("user_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"<@(\w+)>"), 1))))
    direct = tagged.where("user <> user_id and reply_count = 0").join(users.select("user_id"), "user_id", "left_semi")
    direct = top_k(direct, ["user_id"], newest, 20).select(
        "user_id", F.when(question, "critical").otherwise("high").alias("urgency"),
        F.when(question, "unanswered_question").otherwise("direct_mention").alias("category"),
        F.lit("").alias("about"), "channel", "msg_id",
    )

    asked = m.where(question & (F.col("reply_count") == 0)).withColumn("_low", F.lower("text"))
    names = users.where("user_name <> ''").select("user_id", F.col("user_name").alias("_name"), F.lower("user_name").alias("_nl"))
    named = contains_join(asked, "_low", names, "_nl", min_length=1).where("user_name <> _name")
    named = top_k(named, ["user_id"], newest, 10).select(
        "user_id", F.lit("critical").alias("urgency"), F.lit("unanswered_question").alias("category"),
        F.lit("name").alias("about"), "channel", "msg_id",
    )

    owned = owned.select("user_id", "service").distinct()
    big = owned.where(F.octet_length("service") >= 5).select(F.lower("service").alias("_s"), "service").distinct()
    said = contains_join(m.withColumn("_low", F.lower("text")), "_low", big, "_s").drop("_low", "_s").distinct()
    mine = said.join(owned, "service").where("user <> user_id")
    code = top_k(mine.where("has_symptom"), ["user_id", "service"], newest, 5).select(
        "user_id", F.lit("high").alias("urgency"), F.lit("your_code_discussed").alias("category"),
        F.col("service").alias("about"), "channel", "msg_id",
    )

    files = issues.where("level = 'error'").withColumn("_f", F.lower("file"))
    svc = owned.select("service", F.lower("service").alias("_s")).distinct()
    hit = contains_join(files, "_f", svc, "_s", min_length=1).select("service", "title", "count", "function").distinct()
    hit = top_k(hit, ["service"], [F.desc("count"), F.col("title"), F.col("function")], 3)
    errors = hit.join(owned, "service").select(
        "user_id", F.when(F.col("count") > 10, "critical").otherwise("high").alias("urgency"),
        F.lit("your_service_down").alias("category"), F.concat_ws(" ", "service", "title").alias("about"),
        F.lit("issues").alias("channel"), F.lit(None).cast("long").alias("msg_id"),
    )

    assigned = users.where("user_name <> ''").select("user_id", F.lower("user_name").alias("_nl"))
    held = contains_join(tickets.withColumn("_a", F.lower("assignee")), "_a", assigned, "_nl", min_length=1)
    held = held.select("user_id", F.col("key").alias("ticket")).distinct()
    talk = ticket_links(m, "msg_id", tickets).join(m, "msg_id").join(held, "ticket").where("user <> user_id")
    talk = top_k(talk, ["user_id", "ticket"], newest, 3).select(
        "user_id", F.lit("medium").alias("urgency"), F.lit("ticket_discussion").alias("category"),
        F.col("ticket").alias("about"), "channel", "msg_id",
    )

    near = mine.where(F.col("has_symptom") | question).where(
        ~F.col("text").contains(F.concat(F.lit("<@"), "user_id", F.lit(">")))
    )
    near = top_k(near, ["user_id", "service"], newest, 5)
    usual = messages.select(F.col("user").alias("user_id"), "channel", F.lit(True).alias("_here")).distinct()
    domain = near.join(usual, ["user_id", "channel"], "left").where(
        F.col("_here").isNull() | any_of(F.lower("text"), ("error", "broken"))
    ).select(
        "user_id", F.lit("medium").alias("urgency"), F.lit("domain_relevant").alias("category"),
        F.col("service").alias("about"), "channel", "msg_id",
    )

    out = direct
    for part in (named, code, errors, talk, domain):
        out = out.unionByName(part)
    return out.select(*cols)


def digest(items: DataFrame, k: int) -> DataFrame:
    """The ``k`` most urgent items per user."""
    rank = F.when(F.col("urgency") == "critical", 0).when(F.col("urgency") == "high", 1).otherwise(2)
    order = [rank, F.col("category"), F.col("about"), F.col("msg_id")]
    return top_k(items, ["user_id"], order, k)
