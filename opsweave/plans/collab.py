"""Collaboration and cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.operators import collab as C
from opsweave.operators import cost as K
from opsweave.plans.codegraph import SQL_CHANGES, SQL_FN
from opsweave.plans.policy import SQL_EVENTS
from opsweave.plans.registry import query
from opsweave.sources import tables as T


def chat(spark, sf):
    """Messages of the conversations, with people, services, tickets and symptoms worked in."""
    c = T.load(spark, sf, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    s = lambda x: x.cast("string")
    text = F.concat(
        F.col("text"),
        F.when(turn % 3 == 0, F.concat(F.lit(" <@U"), s((conv + 1) % 40), F.lit(">"))).otherwise(""),
        F.lit(" svc-"), s(conv % 9), F.lit("-api"),
        F.when(turn % 4 == 1, " timeout").when(turn % 4 == 2, " deployed by kubectl").otherwise(""),
        F.when(turn % 2 == 0, "?").otherwise(""),
        F.lit(" SHOP-"), s(conv % 30), F.lit(" person"), s(conv % 11),
    )
    last = c.groupBy("conv_id").agg(F.max("turn").alias("last"))
    user = (conv * 7 + turn) % 40
    return c.join(last, "conv_id").select(
        (conv * 1000 + turn).alias("msg_id"), (conv * 86400 + turn * 60).cast("double").alias("ts"),
        F.concat(F.lit("U"), s(user)).alias("user"), F.concat(F.lit("person"), s(user % 11)).alias("user_name"),
        F.when(conv % 4 == 0, "prod-errors").otherwise(F.concat(F.lit("team-"), s(conv % 5))).alias("channel"),
        text.alias("text"), (F.col("last") - turn).alias("reply_count"), (conv * 86400).cast("double").alias("thread_ts"),
    )


SQL_CHAT = """msg AS (SELECT conv_id * 1000 + turn AS msg_id, (conv_id * 86400 + turn * 60)::DOUBLE AS ts, 'U' || (conv_id * 7 + turn) % 40 AS "user", 'person' || ((conv_id * 7 + turn) % 40) % 11 AS user_name,
    CASE WHEN conv_id % 4 = 0 THEN 'prod-errors' ELSE 'team-' || conv_id % 5 END AS channel,
    text || CASE WHEN turn % 3 = 0 THEN ' <@U' || (conv_id + 1) % 40 || '>' ELSE '' END || ' svc-' || conv_id % 9 || '-api' || CASE turn % 4 WHEN 1 THEN ' timeout' WHEN 2 THEN ' deployed by kubectl' ELSE '' END || CASE WHEN turn % 2 = 0 THEN '?' ELSE '' END
      || ' SHOP-' || conv_id % 30 || ' person' || conv_id % 11 AS text,
    max(turn) OVER (PARTITION BY conv_id) - turn AS reply_count, (conv_id * 86400)::DOUBLE AS thread_ts FROM conversations),
  sym AS (SELECT *, regexp_matches(lower(text), '502|503|500|timeout|slow|down|broken|crash|oom|restart|unhealthy|degraded|latency|error rate|connection refused|unreachable|disk full|memory|cpu spike|can''t connect|not responding') AS has_symptom FROM msg)"""


@query(
    "chat_flags",
    "COL1",
    f"""WITH {SQL_CHAT} SELECT msg_id, has_symptom, regexp_matches(lower(text), 'fixed|resolved|deployed|rolled back|rollback|reverted|merged|patched|restarted|recovered|back to normal|all clear|root cause') AS is_resolution,
    regexp_matches(lower(text), 'kubectl|helm|terraform|docker|k9s|argocd|aws |gcloud|az |flux|kustomize') AS has_command, contains(channel, 'prod') AS ops FROM sym""",
)
def flags(spark, sf):
    m = C.with_flags(chat(spark, sf))
    return m.select("msg_id", "has_symptom", "is_resolution", "has_command", C.is_ops_channel(F.col("channel")).alias("ops"))


@query(
    "chat_threads",
    "COL2",
    f"WITH {SQL_CHAT} SELECT CASE WHEN ts <> thread_ts THEN 'reply' ELSE 'parent' END AS role, count(*) AS n FROM msg WHERE ts <> thread_ts OR reply_count > 0 GROUP BY 1",
)
def threads(spark, sf):
    return C.thread_edges(chat(spark, sf)).groupBy("role").agg(F.count("*").alias("n"))


def services(spark, sf):
    n = T.load(spark, sf, "nation")
    return n.select(F.concat(F.lit("SVC-"), F.col("n_nationkey").cast("string"), F.lit("-api")).alias("name"))


SQL_SAID = f"""{SQL_CHAT}, sv AS (SELECT 'svc-' || n_nationkey || '-api' AS service FROM nation), said AS (SELECT sym.*, service FROM sym JOIN sv ON contains(lower(text), service))"""


@query("chat_service_mentions", "COL3 REL5", f"WITH {SQL_SAID} SELECT msg_id, service FROM said")
def service_mentions(spark, sf):
    return C.service_mentions(chat(spark, sf), services(spark, sf)).select("msg_id", "service")


NOW = 86400.0 * 100


@query("chat_user_activity", "COL4", f"""WITH {SQL_CHAT} SELECT "user", max(ts) AS last_active, max(ts) >= {NOW} - 45 * 86400 AS active FROM msg GROUP BY 1""")
def user_activity(spark, sf):
    return C.user_activity(chat(spark, sf), NOW)


@query(
    "chat_last_commits",
    "COL4",
    "SELECT o_custkey AS author, epoch(max(o_orderdate))::BIGINT AS last_commit FROM orders GROUP BY 1",
)
def last_commits(spark, sf):
    return C.last_commits(T.commits(spark, sf)).withColumn("last_commit", F.unix_timestamp("last_commit"))


@query(
    "chat_suggested_contacts",
    "COL5",
    f"""WITH {SQL_SAID}, a AS (SELECT "user", max(ts) >= {NOW} - 10 * 86400 AS active FROM msg GROUP BY 1), p AS (SELECT "user", service, count(*) AS n FROM said GROUP BY ALL),
    s AS (SELECT x."user", y."user" AS contact, sum(x.n * y.n)::BIGINT AS shared FROM p x JOIN a ax ON ax."user" = x."user" AND NOT ax.active JOIN p y ON y.service = x.service JOIN a ay ON ay."user" = y."user" AND ay.active GROUP BY ALL)
    SELECT "user", arg_min(contact, (-shared, contact)) AS suggested, max(shared) AS shared FROM s GROUP BY 1""",
)
def suggested_contacts(spark, sf):
    m = chat(spark, sf)
    return C.suggested_contacts(C.service_mentions(m, services(spark, sf)), C.user_activity(m, NOW, days=10))


def tickets(spark, sf):
    c = T.load(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("SHOP-"), k.cast("string")).alias("key"), F.concat(F.lit("Person"), (k % 13).cast("string")).alias("assignee"),
        F.when(k % 3 == 0, F.concat(F.lit("SHOP-"), (k * 2).cast("string"))).otherwise("").alias("parent"),
    )


SQL_TICKETS = """tk AS (SELECT 'SHOP-' || c_custkey AS key, 'Person' || c_custkey % 13 AS assignee, CASE WHEN c_custkey % 3 = 0 THEN 'SHOP-' || c_custkey * 2 ELSE '' END AS parent FROM customer)"""


@query(
    "ticket_links",
    "COL6",
    f"""WITH {SQL_CHAT}, {SQL_TICKETS}, f AS (SELECT DISTINCT msg_id, unnest(regexp_extract_all(text, '\\b([A-Z][A-Z0-9]*-\\d+)\\b', 1)) AS ticket FROM msg) SELECT msg_id, ticket FROM f WHERE ticket IN (SELECT key FROM tk)""",
)
def ticket_links(spark, sf):
    return C.ticket_links(chat(spark, sf), "msg_id", tickets(spark, sf))


@query("ticket_parents", "COL6", f"WITH {SQL_TICKETS} SELECT key, parent FROM tk WHERE parent <> '' AND parent IN (SELECT key FROM tk)")
def ticket_parents(spark, sf):
    return C.parent_tickets(tickets(spark, sf))


@query(
    "pr_commits",
    "COL7",
    """SELECT o_orderkey AS commit, o_custkey AS number FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""",
)
def pr_commits(spark, sf):
    commits = T.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("commit"),
        F.concat(F.lit("Merge pull request #"), F.col("o_custkey").cast("string"), F.lit(" from x")).alias("message"),
    )
    prs = T.load(spark, sf, "customer").select(F.col("c_custkey").alias("number"))
    return C.pr_commits(prs, commits)


@query(
    "issue_functions",
    "COL8",
    f"""WITH {SQL_FN} SELECT DISTINCT o_orderkey % 500 AS issue_id, fn.id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN fn ON fn.id = l_partkey""",
)
def issue_functions(spark, sf):
    li = T.load(spark, sf, "lineitem")
    f = T.functions(spark, sf)
    frames = li.select((F.col("l_orderkey") % 500).alias("issue_id"), F.col("l_partkey").alias("id")).join(f.select("id", "name"), "id")
    return C.issue_functions(frames.select("issue_id", F.col("name").alias("function")), f)


def issues(spark, sf):
    e = T.events(spark, sf).where("event_type = 'error'")
    return e.groupBy((F.col("user_id") % 40).alias("issue_id")).agg(F.count("*").alias("count")).select(
        "issue_id", "count", F.concat(F.lit("Svc-"), (F.col("issue_id") % 9).cast("string"), F.lit("-API Timeout")).alias("title"),
        F.lit("error").alias("level"), F.concat(F.lit("src/stem"), F.col("issue_id").cast("string"), F.lit(".py")).alias("file"),
        F.concat(F.lit("fn"), F.col("issue_id").cast("string")).alias("function"),
    )


@query(
    "issue_messages",
    "COL8",
    f"""WITH {SQL_CHAT}, {SQL_EVENTS}, i AS (SELECT DISTINCT user_id % 40 AS issue_id, 'svc-' || (user_id % 40) % 9 || '-api timeout' AS t FROM ev WHERE event_type = 'error')
    SELECT issue_id, msg_id FROM i JOIN msg ON channel = 'prod-errors' AND contains(lower(text), t)""",
)
def issue_messages(spark, sf):
    return C.issue_messages(issues(spark, sf), chat(spark, sf))


@query(
    "chat_identities",
    "COL9",
    f"""WITH {SQL_CHAT}, q AS (SELECT DISTINCT 'person' || n_nationkey AS who FROM nation), a AS (SELECT c_name AS name, lower('Person' || c_custkey || '@x.org') AS email FROM customer),
    x AS (SELECT who, min("user") AS user_id FROM q JOIN msg ON contains(user_name, who) GROUP BY 1), y AS (SELECT who, min(name) AS git_author FROM q JOIN a ON contains(lower(name), who) OR contains(email, who) GROUP BY 1)
    SELECT who, coalesce(user_id, '') AS user_id, coalesce(git_author, '') AS git_author FROM q LEFT JOIN x USING (who) LEFT JOIN y USING (who) WHERE user_id IS NOT NULL OR git_author IS NOT NULL""",
)
def identities(spark, sf):
    asked = T.load(spark, sf, "nation").select(F.concat(F.lit("Person"), F.col("n_nationkey").cast("string")).alias("who"))
    users = chat(spark, sf).select(F.col("user").alias("user_id"), F.col("user_name").alias("name"), F.col("user_name").alias("real_name")).distinct()
    authors = T.load(spark, sf, "customer").select(
        F.col("c_name").alias("name"), F.concat(F.lit("Person"), F.col("c_custkey").cast("string"), F.lit("@x.org")).alias("email")
    )
    return C.resolve_identities(asked, users, authors).fillna("", ["user_id", "git_author"])


SQL_RADAR = f"""{SQL_SAID}, {SQL_TICKETS}, {SQL_EVENTS}, us AS (SELECT DISTINCT "user" AS user_id, user_name FROM msg), m AS (SELECT * FROM sym WHERE ts >= 864000),
  ow AS (SELECT user_id, 'Svc-' || substr(user_id, 2)::INT % 9 || '-api' AS service FROM us UNION SELECT user_id, 'stem' || substr(user_id, 2) FROM us),
  iss AS (SELECT user_id % 40 AS i, count(*) AS count FROM ev WHERE event_type = 'error' GROUP BY 1),
  r1 AS (SELECT u.user_id, CASE WHEN contains(text, '?') THEN 'critical' ELSE 'high' END AS urgency, CASE WHEN contains(text, '?') THEN 'unanswered_question' ELSE 'direct_mention' END AS category, '' AS about, channel, msg_id FROM m JOIN us u ON contains(text, '<@' || u.user_id || '>') WHERE "user" <> u.user_id AND reply_count = 0
     QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY ts DESC, msg_id) <= 20),
  r2 AS (SELECT u.user_id, 'critical', 'unanswered_question', 'name', channel, msg_id FROM m JOIN us u ON contains(lower(text), lower(u.user_name)) WHERE contains(text, '?') AND reply_count = 0 AND m.user_name <> u.user_name QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY ts DESC, msg_id) <= 10),
  mine AS (SELECT m.*, ow.user_id, ow.service FROM m JOIN ow ON length(ow.service) >= 5 AND contains(lower(text), lower(ow.service)) WHERE "user" <> ow.user_id),
  r3 AS (SELECT user_id, 'high', 'your_code_discussed', service, channel, msg_id FROM mine WHERE has_symptom QUALIFY row_number() OVER (PARTITION BY user_id, service ORDER BY ts DESC, msg_id) <= 5),
  h AS (SELECT DISTINCT service, 'Svc-' || i % 9 || '-API Timeout' AS title, count, 'fn' || i AS fn FROM iss JOIN (SELECT DISTINCT service FROM ow) ON contains('src/stem' || i || '.py', lower(service)) QUALIFY row_number() OVER (PARTITION BY service ORDER BY count DESC, title, fn) <= 3),
  r4 AS (SELECT user_id, CASE WHEN count > 10 THEN 'critical' ELSE 'high' END, 'your_service_down', service || ' ' || title, 'issues', NULL::BIGINT FROM h JOIN ow USING (service)),
  held AS (SELECT DISTINCT user_id, key AS ticket FROM us JOIN tk ON contains(lower(assignee), lower(user_name))),
  tl AS (SELECT DISTINCT msg_id, unnest(regexp_extract_all(text, '\\b([A-Z][A-Z0-9]*-\\d+)\\b', 1)) AS ticket FROM m),
  r5 AS (SELECT user_id, 'medium', 'ticket_discussion', ticket, channel, msg_id FROM tl JOIN m USING (msg_id) JOIN held USING (ticket) WHERE "user" <> user_id QUALIFY row_number() OVER (PARTITION BY user_id, ticket ORDER BY ts DESC, msg_id) <= 3),
  near AS (SELECT * FROM mine WHERE (has_symptom OR contains(text, '?')) AND NOT contains(text, '<@' || user_id || '>') QUALIFY row_number() OVER (PARTITION BY user_id, service ORDER BY ts DESC, msg_id) <= 5),
  r6 AS (SELECT user_id, 'medium', 'domain_relevant', service, channel, msg_id FROM near WHERE regexp_matches(lower(text), 'error|broken') OR NOT EXISTS (SELECT 1 FROM msg WHERE msg."user" = near.user_id AND msg.channel = near.channel)),
  radar AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4 UNION ALL SELECT * FROM r5 UNION ALL SELECT * FROM r6)"""


def radar_items(spark, sf):
    m = C.with_flags(chat(spark, sf))
    users = m.select(F.col("user").alias("user_id"), "user_name").distinct()
    n = F.expr("substring(user_id, 2)")
    owned = users.select("user_id", F.concat(F.lit("Svc-"), (n.cast("int") % 9).cast("string"), F.lit("-api")).alias("service")).unionByName(
        users.select("user_id", F.concat(F.lit("stem"), n).alias("service"))
    )
    return C.radar(users, m, owned, issues(spark, sf), tickets(spark, sf), 864000.0)


@query("chat_radar", "COL10", f"WITH {SQL_RADAR} SELECT user_id, urgency, category, about, channel, coalesce(msg_id, -1) AS msg_id FROM radar")
def radar(spark, sf):
    return radar_items(spark, sf).fillna(-1, ["msg_id"])


@query(
    "chat_radar_digest",
    "COL10",
    f"""WITH {SQL_RADAR} SELECT user_id, urgency, category, about FROM radar
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE urgency WHEN 'critical' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, category, about, msg_id NULLS FIRST) <= 5""",
)
def radar_digest(spark, sf):
    return C.digest(radar_items(spark, sf), 5).select("user_id", "urgency", "category", "about")


@query(
    "owned_services",
    "COL11",
    f"""WITH {SQL_CHANGES} SELECT DISTINCT author, regexp_replace(split_part(replace(file, '/m', '/module'), '/', -1), '\\.(ts|js|tsx|py)', '') AS service FROM chg""",
)
def owned_services(spark, sf):
    c = T.file_changes(spark, sf).select("author", F.replace(F.col("file"), F.lit("/m"), F.lit("/module")).alias("file"))
    return C.owned_services(c)


# --- cost -----------------------------------------------------------------------------------


def billing(spark, sf):
    p = T.load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("service"), F.col("p_brand").alias("sku"))
    li = T.load(spark, sf, "lineitem").select("l_partkey", F.col("l_shipdate").alias("usage_ts"), "l_extendedprice", "l_quantity", "l_returnflag")
    return li.join(p, "l_partkey").select(
        F.lit("gcp").alias("provider"), F.lit("main").alias("project"), "service", "sku", "usage_ts",
        F.col("l_extendedprice").alias("cost"), F.lit("USD").alias("currency"), F.col("l_quantity").alias("usage_amount"),
        F.col("l_returnflag").alias("unit"),
    )


SQL_BILL = "b AS (SELECT p_type AS service, p_brand AS sku, l_shipdate::DATE AS day, CAST(l_extendedprice AS DECIMAL(28,6)) AS cost, CAST(l_quantity AS DECIMAL(28,6)) AS amount, l_returnflag AS unit FROM lineitem JOIN part ON p_partkey = l_partkey)"
TODAY = "2000-06-30"


@query(
    "cost_by_service",
    "CST1",
    f"WITH {SQL_BILL} SELECT service, 'USD' AS currency, round(sum(cost), 2)::DOUBLE AS cost FROM b WHERE day >= DATE '{TODAY}' - 30 GROUP BY 1 HAVING sum(cost) > 0.01",
)
def service_costs(spark, sf):
    return K.service_costs(billing(spark, sf), TODAY)


@query("cost_daily_trend", "CST2", f"WITH {SQL_BILL} SELECT service, strftime(day, '%Y-%m-%d') AS day, round(sum(cost), 2)::DOUBLE AS cost FROM b WHERE day >= DATE '{TODAY}' - 7 GROUP BY service, b.day")
def daily_trend(spark, sf):
    return K.daily_trend(billing(spark, sf), TODAY).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "cost_by_sku",
    "CST3",
    f"WITH {SQL_BILL} SELECT sku, unit, round(sum(cost), 2)::DOUBLE AS cost, round(sum(amount), 2)::DOUBLE AS usage_amount FROM b WHERE day >= DATE '{TODAY}' - 30 AND service = 'ECONOMY' GROUP BY 1, 2 HAVING sum(cost) > 0.01",
)
def sku_costs(spark, sf):
    return K.sku_costs(billing(spark, sf), "ECONOMY", TODAY)


@query(
    "cost_monthly_nested",
    "CST4",
    "SELECT c_mktsegment AS service, count(*) AS n, round(sum(CAST(c_acctbal AS DECIMAL(18,2))), 2)::DOUBLE AS cost FROM customer WHERE c_acctbal >= 0.01 GROUP BY 1",
)
def monthly_costs(spark, sf):
    text = F.format_string(
        '{"ResultsByTime":[{"Groups":[{"Keys":["%s"],"Metrics":{"UnblendedCost":{"Amount":"%s"}}}]},{"Groups":[]}]}',
        "c_mktsegment", F.col("c_acctbal").cast("string"),
    )
    c = T.load(spark, sf, "customer").select(F.from_json(text, K.MONTHLY_SCHEMA).alias("r")).select("r.*")
    per = K.monthly_costs(c).groupBy("service")
    return per.agg(F.count("*").alias("n"), F.sum(F.col("cost").cast("decimal(18,2)")).cast("double").alias("cost"))


@query(
    "cost_expensive",
    "CST5 REL12",
    f"WITH {SQL_BILL} SELECT service, 'USD' AS currency, round(sum(cost), 2)::DOUBLE AS cost FROM b WHERE day >= DATE '{TODAY}' - 30 GROUP BY 1 HAVING sum(cost) > 3000000",
)
def expensive(spark, sf):
    return K.expensive(K.service_costs(billing(spark, sf), TODAY), 3_000_000)


@query(
    "cost_estimates",
    "CST6",
    """WITH r AS (SELECT s_suppkey AS name, CASE s_suppkey % 3 WHEN 0 THEN 'cluster' WHEN 1 THEN 'database' ELSE 'vm' END AS kind, CASE s_suppkey % 5 WHEN 0 THEN 'e2-standard-16' WHEN 1 THEN 'db-f1-micro' WHEN 2 THEN 'n2-standard-4' WHEN 3 THEN 'db-custom-2-7680' ELSE 'odd' END AS m, s_nationkey AS nodes FROM supplier)
    SELECT name, kind, round(CASE kind WHEN 'database' THEN CASE m WHEN 'db-f1-micro' THEN 7.67 WHEN 'db-custom-2-7680' THEN 102.2 ELSE 30 END
      ELSE CASE m WHEN 'e2-standard-16' THEN 391.31 WHEN 'n2-standard-4' THEN 142.8 WHEN 'db-f1-micro' THEN 3.88 ELSE 50 END * CASE kind WHEN 'cluster' THEN nodes ELSE 1 END END::DOUBLE, 2) AS cost FROM r""",
)
def estimates(spark, sf):
    s = F.col("s_suppkey")
    r = T.load(spark, sf, "supplier").select(
        s.alias("name"), F.when(s % 3 == 0, "cluster").when(s % 3 == 1, "database").otherwise("vm").alias("kind"),
        F.when(s % 5 == 0, "e2-standard-16").when(s % 5 == 1, "db-f1-micro").when(s % 5 == 2, "n2-standard-4")
        .when(s % 5 == 3, "db-custom-2-7680").otherwise("odd").alias("machine_type"),
        F.col("s_nationkey").alias("nodes"),
    )
    return K.estimated_costs(r).select("name", "kind", "cost")
