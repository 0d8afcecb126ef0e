"""Policy queries over the action events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from opsweave.operators import policy as P
from opsweave.operators import policy_state as S
from opsweave.operators.rules import compare, if_else, load_rules, ruleset
from opsweave.plans.registry import query
from opsweave.sources import tables as T

RULES = load_rules(
    [
        "# comments are skipped",
        "when tool eq 'error' and command contains '\"K\": 9' then block",
        "when tool eq 'purchase' and amount gt 150 then require_approval",
        "when tool in 'signup,invite' and k lt 10 or day_of_week eq 'Sunday' then ask 'Weekend or early signup'",
        "when command matches 'view .*: [0-9]}' then suggest 'Use a wider view'",
        "when not tool starts_with 'c' and amount lte 2.5 then rewrite 'noop'",
        "when tool eq 'click' and amount gte 100 then rewrite",
        "when tool eq 'click' then log",
    ]
)

SQL_EVENTS = """
  ev AS (SELECT event_id, epoch(ts) AS t, ts, user_id, event_type, value,
                CAST(json_extract(props, '$.k') AS BIGINT) AS k,
                event_type || ' ' || props AS command, dayname(ts) AS dow FROM events)"""

SQL_VERDICT = f"""{SQL_EVENTS},
  verdict AS (SELECT *, CASE
     WHEN event_type = 'error' AND contains(lower(command), '"k": 9') THEN 1
     WHEN event_type = 'purchase' AND value > 150 THEN 2
     WHEN (contains('signup,invite', event_type) AND k < 10) OR dow = 'Sunday' THEN 3
     WHEN regexp_matches(command, 'view .*: [0-9]}}', 'i') THEN 4
     WHEN NOT starts_with(event_type, 'c') AND value <= 2.5 THEN 5
     WHEN event_type = 'click' AND value >= 100 THEN 6 END AS rule_no FROM ev)"""
SQL_ACTION = (
    "CASE rule_no WHEN 1 THEN 'block' WHEN 2 THEN 'require_approval' WHEN 3 THEN 'ask' "
    "WHEN 4 THEN 'suggest' WHEN 5 THEN 'rewrite' WHEN 6 THEN 'block' END"
)


def checked(spark, sf):
    return P.guard_check(T.action_events(spark, sf), RULES)


@query(
    "policy_verdict_counts",
    "POL7 POL9 POL1-4",
    f"""WITH {SQL_VERDICT}
    SELECT coalesce(rule_no, 0) AS rule_no, coalesce({SQL_ACTION}, 'allow') AS action_taken,
           count(*) AS n, round(sum(CAST(value AS DECIMAL(18,2))), 2)::DOUBLE AS amount
    FROM verdict GROUP BY ALL""",
)
def verdict_counts(spark, sf):
    return (
        checked(spark, sf)
        .groupBy(
            F.coalesce("rule_no", F.lit(0)).alias("rule_no"),
            F.coalesce("action_taken", F.lit("allow")).alias("action_taken"),
        )
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"),
        )
    )


@query(
    "policy_verdicts",
    "POL7 POL32",
    f"""WITH {SQL_VERDICT}
    SELECT event_id, coalesce(rule_no, 0) AS rule_no, rule_no IS NULL AS allowed,
           coalesce(rule_no IN (1, 2, 6), false) AS blocked,
           coalesce(CASE rule_no WHEN 3 THEN 'Weekend or early signup' WHEN 4 THEN 'Use a wider view'
                    WHEN 5 THEN 'noop' END, '') AS suggestion,
           CASE WHEN rule_no = 5 THEN 'noop' ELSE command END AS command
    FROM verdict""",
)
def verdicts(spark, sf):
    c = checked(spark, sf)
    return c.select(
        "event_id", F.coalesce("rule_no", F.lit(0)).alias("rule_no"), "allowed", "blocked",
        F.coalesce("suggestion", F.lit("")).alias("suggestion"),
        F.when(F.col("action_taken") == "rewrite", F.col("suggestion"))
        .otherwise(F.col("command")).alias("command"),
    )


@query(
    "policy_outputs",
    "POL32",
    f"""WITH {SQL_VERDICT}
    SELECT 'allowed' AS output, count(*) AS n, count(DISTINCT command) AS commands FROM verdict WHERE rule_no IS NULL
    UNION ALL SELECT 'blocked', count(*), count(DISTINCT command) FROM verdict WHERE rule_no IN (1, 2, 6)
    UNION ALL SELECT 'rewritten', count(*), CAST(count(*) > 0 AS BIGINT) FROM verdict WHERE rule_no = 5""",
)
def outputs(spark, sf):
    parts = P.split_outputs(checked(spark, sf))
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n"), F.countDistinct("command").alias("commands"))
        one = one.select(F.lit(name).alias("output"), "n", "commands")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "policy_all_matches",
    "POL8",
    f"""WITH {SQL_EVENTS}, hits AS (
     SELECT event_id, 1 AS rule_no FROM ev WHERE event_type = 'error' AND contains(lower(command), '"k": 9')
     UNION ALL SELECT event_id, 2 FROM ev WHERE event_type = 'purchase' AND value > 150
     UNION ALL SELECT event_id, 3 FROM ev WHERE (contains('signup,invite', event_type) AND k < 10) OR dow = 'Sunday'
     UNION ALL SELECT event_id, 4 FROM ev WHERE regexp_matches(command, 'view .*: [0-9]}}', 'i')
     UNION ALL SELECT event_id, 5 FROM ev WHERE NOT starts_with(event_type, 'c') AND value <= 2.5
     UNION ALL SELECT event_id, 6 FROM ev WHERE event_type = 'click' AND value >= 100),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY rule_no) AS rn FROM hits)
    SELECT rule_no, rn > 1 AS shadowed, count(*) AS n FROM ranked GROUP BY ALL""",
)
def all_matches(spark, sf):
    hits = P.all_matches(T.action_events(spark, sf), RULES)
    return hits.groupBy("rule_no", "shadowed").agg(F.count("*").alias("n"))


@query(
    "policy_operator_truth",
    "POL1-6",
    f"""WITH {SQL_EVENTS}
    SELECT event_type, count(*) FILTER (k = 7) AS eq, count(*) FILTER (k <> 7) AS neq,
      count(*) FILTER (value > 50) AS gt, count(*) FILTER (value <= 50) AS lte,
      count(*) FILTER (contains(lower(command), 'k": 1')) AS has,
      count(*) FILTER (NOT contains(lower(command), 'k": 1')) AS has_not,
      count(*) FILTER (ends_with(command, '9}}')) AS ends,
      count(*) FILTER (regexp_matches(command, '(^C|5}})', 'i')) AS re,
      count(*) FILTER (event_type IN ('view', 'click')) AS in_list,
      0::BIGINT AS missing_text, count(*) AS missing_negated, count(*) AS missing_as_text
    FROM ev GROUP BY event_type""",
)
def operator_truth(spark, sf):
    e = T.action_events(spark, sf)

    def n(field, op, value, **kw):
        return F.count_if(compare(e, field, op, value, **kw))

    return e.groupBy(F.col("tool").alias("event_type")).agg(
        n("k", "eq", 7).alias("eq"), n("k", "neq", 7).alias("neq"),
        n("amount", "gt", 50).alias("gt"), n("amount", "lte", "50").alias("lte"),
        n("command", "contains", 'K": 1').alias("has"),
        n("command", "not_contains", 'k": 1').alias("has_not"),
        n("command", "ends_with", "9}").alias("ends"),
        n("command", "matches", "(^C|5})").alias("re"),
        n("tool", "in", ["view", "click"]).alias("in_list"),
        n("environment", "contains", "none").alias("missing_text"),
        n("environment", "not_in", "production").alias("missing_negated"),
        n("environment", "contains", "none", dialect="none_text").alias("missing_as_text"),
    )


PRESETS = load_rules([*P.spend_limit(150), *P.BUSINESS_HOURS])


@query(
    "policy_presets",
    "POL10",
    f"""WITH {SQL_EVENTS}
    SELECT CASE WHEN value > 150 THEN 'require_approval' WHEN dow IN ('Saturday', 'Sunday') THEN 'block'
                ELSE 'allow' END AS verdict, count(*) AS n FROM ev GROUP BY ALL""",
)
def presets(spark, sf):
    c = P.guard_check(T.action_events(spark, sf), PRESETS)
    return c.groupBy(F.coalesce("action_taken", F.lit("allow")).alias("verdict")).agg(
        F.count("*").alias("n")
    )


def rule_rows(spark, sf):
    """A rules table derived from the parts: profile = brand, one rule per part type and size."""
    p = T.load(spark, sf, "part")
    return p.select(
        F.col("p_brand").alias("profile"),
        F.col("p_partkey").alias("ord"),
        F.concat_ws(
            "", F.lit("when tool eq '"), "p_type", F.lit("' and size gt "), "p_size", F.lit(" then block")
        ).alias("dsl"),
    )


SQL_RULES = """rules AS (SELECT p_brand AS profile, p_partkey AS ord,
   'when tool eq ''' || p_type || ''' and size gt ' || p_size || ' then block' AS dsl FROM part)"""


@query(
    "policy_profile_stack",
    "POL11",
    f"""WITH {SQL_RULES}, picked AS (
      SELECT *, CASE profile WHEN 'Brand#7' THEN 1 WHEN 'Brand#2' THEN 2 WHEN 'Brand#11' THEN 3 END AS place
      FROM rules WHERE profile IN ('Brand#7', 'Brand#2', 'Brand#11')),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY dsl ORDER BY place, ord) AS rn FROM picked)
    SELECT dsl, profile, place, ord FROM firsts WHERE rn = 1""",
)
def profile_stack(spark, sf):
    return P.stack_profiles(rule_rows(spark, sf), "Brand#7+Brand#2+Brand#11")


@query(
    "policy_enforced_overlay",
    "POL12",
    f"""WITH {SQL_RULES}, own AS (SELECT min(ord) AS ord, dsl FROM rules GROUP BY dsl),
    disabled AS (SELECT DISTINCT dsl FROM rules WHERE profile IN ('Brand#2', 'Brand#3')),
    policy AS (SELECT min(ord) AS ord, dsl FROM rules WHERE profile = 'Brand#3' GROUP BY dsl)
    SELECT 0 AS layer, ord, dsl, true AS enforced FROM policy
    UNION ALL SELECT 1, ord, dsl, false FROM own
    WHERE dsl NOT IN (SELECT dsl FROM policy) AND dsl NOT IN (SELECT dsl FROM disabled)""",
)
def enforced_overlay(spark, sf):
    r = rule_rows(spark, sf)
    own = r.groupBy("dsl").agg(F.min("ord").alias("ord"))
    disabled = r.where(F.col("profile").isin("Brand#2", "Brand#3")).select("dsl").distinct()
    policy = r.where("profile = 'Brand#3'").groupBy("dsl").agg(F.min("ord").alias("ord"))
    return P.effective_rules(own, disabled, policy)


def asks_and_approvals(spark, sf):
    """Asks: error events, rule = k // 20. Approvals: purchases with the same rule number."""
    e = T.events(spark, sf).withColumn("rule", F.floor(F.col("k") / 20).cast("long"))
    base = e.select("event_id", F.col("user_id").alias("session"), "rule", "t", "event_type")
    asks = base.where("event_type = 'error'").drop("event_type")
    return asks, base.where("event_type = 'purchase'").select("session", "rule", "t")


@query(
    "policy_session_approvals",
    "POL13",
    f"""WITH {SQL_EVENTS}, asks AS (SELECT event_id, user_id, k // 20 AS rule, t FROM ev WHERE event_type = 'error'),
    appr AS (SELECT user_id, k // 20 AS rule, t FROM ev WHERE event_type = 'purchase')
    SELECT event_id, user_id AS session, rule, EXISTS (SELECT 1 FROM appr b WHERE b.user_id = a.user_id
       AND b.rule = a.rule AND b.t <= a.t AND b.t >= a.t - 28800) AS approved FROM asks a""",
)
def session_approvals(spark, sf):
    asks, approvals = asks_and_approvals(spark, sf)
    return S.with_approval(asks, approvals).drop("t")


@query(
    "policy_pending_asks",
    "POL14",
    f"""WITH {SQL_EVENTS}, log AS (SELECT event_id, user_id AS session, t, k // 20 AS rule,
      CASE event_type WHEN 'error' THEN 'ask' ELSE 'tool_ok' END AS kind FROM ev),
    prev AS (SELECT *, lag(kind) OVER w AS pk, lag(rule) OVER w AS pr, lag(t) OVER w AS pt
             FROM log WINDOW w AS (PARTITION BY rule ORDER BY t, event_id))
    SELECT rule AS session, event_id, pr AS rule FROM prev
    WHERE kind = 'tool_ok' AND pk = 'ask' AND floor(t - pt) < 60""",
)
def pending_asks(spark, sf):
    e = T.events(spark, sf)
    rule = F.floor(F.col("k") / 20).cast("long")
    log = e.select(
        "event_id", rule.alias("session"), "t", rule.alias("rule"),
        F.when(F.col("event_type") == "error", "ask").otherwise("tool_ok").alias("kind"),
    )
    return S.granted_approvals(log).drop("t")


@query(
    "policy_cooloff",
    "POL15",
    f"""WITH {SQL_VERDICT}, b AS (SELECT event_id, rule_no AS rule, epoch_us(ts) AS us FROM verdict WHERE rule_no IS NOT NULL),
    c AS (SELECT *, count(*) OVER (PARTITION BY rule ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND 1 PRECEDING) AS recent_blocks FROM b)
    SELECT event_id, rule, recent_blocks, CASE WHEN recent_blocks >= 3 THEN 'ask' ELSE 'block' END AS action_taken FROM c""",
)
def cooloff(spark, sf):
    blocks = checked(spark, sf).where("rule_no is not null").select(
        "event_id", F.col("rule_no").alias("rule"), "t", F.lit("block").alias("action_taken")
    )
    return S.with_cooloff(blocks).drop("t")


@query(
    "policy_pauses",
    "POL16",
    f"""WITH {SQL_EVENTS}, p AS (SELECT user_id, t AS s, t + k * 3600 AS e FROM ev WHERE event_type = 'signup')
    SELECT event_id FROM ev a WHERE event_type <> 'signup'
      AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = a.user_id AND a.t >= p.s AND a.t <= p.e)""",
)
def pauses(spark, sf):
    e = T.events(spark, sf)
    made = e.where("event_type = 'signup'").select(
        "user_id", F.col("t").alias("start_t"), (F.col("t") + F.col("k") * 3600).alias("expiry_t")
    )
    rest = e.where("event_type <> 'signup'").select("event_id", "user_id", "t")
    return S.outside_pauses(rest, made, ["user_id"]).select("event_id")


@query(
    "policy_event_class",
    "POL17",
    """WITH r AS (SELECT text AS rule FROM documents),
    c AS (SELECT CASE
      WHEN contains(rule, 'rm -rf /') OR contains(rule, 'mkfs') OR contains(rule, 'dd if=') THEN 'data_destruction critical'
      WHEN contains(rule, 'DROP DATABASE') OR contains(rule, 'DROP TABLE') THEN 'data_loss critical'
      WHEN contains(rule, 'kubectl delete pvc') OR contains(rule, 'kubectl delete namespace') OR contains(rule, 'terraform destroy') THEN 'infrastructure high'
      WHEN contains(rule, 'git push --force') OR contains(rule, 'git reset --hard') THEN 'code_loss high'
      WHEN contains(rule, '.env') OR contains(rule, 'credentials') OR contains(rule, 'id_rsa') OR contains(rule, '.ssh') THEN 'secret_exposure high'
      WHEN contains(rule, 'chmod 777') OR contains(rule, 'rm -rf .') THEN 'misconfiguration medium'
      WHEN contains(rule, 'npm publish') OR contains(rule, 'docker push') OR contains(rule, 'TRUNCATE') THEN 'publish_risk medium'
      ELSE 'other low' END AS class FROM r)
    SELECT split_part(class, ' ', 1) AS category, split_part(class, ' ', 2) AS severity, count(*) AS n FROM c GROUP BY ALL""",
)
def event_class(spark, sf):
    d = T.load(spark, sf, "documents").select(P.event_class(F.col("text")).alias("c"))
    return d.groupBy("c.category", "c.severity").agg(F.count("*").alias("n"))


@query(
    "policy_command_preview",
    "POL18",
    """WITH s AS (SELECT doc_id, replace(replace(text, '/home/', '/~/'), '/Users/', '/~/') AS x FROM documents)
    SELECT doc_id, CASE WHEN strlen(x) > 100 THEN left(x, 97) || '...' ELSE x END AS preview FROM s""",
)
def preview(spark, sf):
    d = T.load(spark, sf, "documents")
    return d.select("doc_id", P.command_preview(F.col("text")).alias("preview"))


SQL_LOG = f"""{SQL_EVENTS}, log AS (SELECT event_id, t, event_type AS tool, command AS detail,
    CASE WHEN event_type IN ('error', 'click') THEN 'block' ELSE 'allow' END AS action,
    CASE WHEN k < 40 THEN 'guard_rule' WHEN k < 55 THEN 'code_search' WHEN k < 70 THEN 'bash_code_search'
         WHEN k < 90 THEN 'full_file_read' ELSE 'degraded' END AS reason,
    floor(value * 10)::BIGINT AS duration_ms, k AS tokens, event_type <> 'error' AS ok FROM ev)"""


def audit_log(spark, sf):
    e = T.action_events(spark, sf)
    k = F.col("k")
    return e.select(
        "event_id", "t", "ts", "tool", F.col("command").alias("detail"),
        F.when(F.col("tool").isin("error", "click"), "block").otherwise("allow").alias("action"),
        F.when(k < 40, "guard_rule").when(k < 55, "code_search").when(k < 70, "bash_code_search")
        .when(k < 90, "full_file_read").otherwise("degraded").alias("reason"),
        F.floor(F.col("amount") * 10).alias("duration_ms"), k.alias("tokens"),
        (F.col("tool") != "error").alias("ok"),
    )


@query(
    "policy_guard_stats",
    "POL19",
    f"""WITH {SQL_LOG} SELECT count(*) AS total,
    count(*) FILTER (action = 'block' AND reason = 'guard_rule') AS blocked_by_rule,
    count(*) FILTER (action = 'allow') AS allowed FROM log""",
)
def guard_stats(spark, sf):
    return P.guard_stats(audit_log(spark, sf))


@query(
    "policy_recent_blocks",
    "POL19",
    f"""WITH {SQL_LOG} SELECT event_id, tool, detail FROM log
    WHERE action = 'block' AND reason = 'guard_rule' ORDER BY t DESC, event_id DESC LIMIT 5""",
)
def recent_blocks(spark, sf):
    return P.recent_blocks(audit_log(spark, sf)).select("event_id", "tool", "detail")


@query(
    "policy_last_block",
    "POL20",
    f"""WITH {SQL_LOG}, b AS (SELECT * FROM log WHERE action = 'block' ORDER BY t DESC, event_id DESC LIMIT 1)
    SELECT tool, detail, action, floor((1706745600 - t) / 86400)::BIGINT || 'd ago' AS ago FROM b""",
)
def last_block(spark, sf):
    return P.last_block(audit_log(spark, sf), 1706745600.0).drop("t")


SQL_USAGE = f"""{SQL_LOG}, u AS (SELECT
    count(*) FILTER (action = 'block' AND reason IN ('code_search', 'bash_code_search')) AS searches,
    count(*) FILTER (action = 'block' AND reason = 'full_file_read') AS reads,
    count(*) FILTER (action = 'block') AS blocks, count(*) FILTER (action = 'allow') AS allows,
    count(*) FILTER (reason = 'degraded') AS degraded FROM log),
  usage AS (SELECT *, reads * 3950 + searches * 1200 AS tokens_saved, searches * 3 + reads * 4 AS seconds_saved FROM u)"""


@query("policy_usage_stats", "POL21", f"WITH {SQL_USAGE} SELECT * FROM usage")
def usage_stats(spark, sf):
    return P.usage_stats(audit_log(spark, sf))


@query(
    "policy_saved_cost",
    "POL23",
    f"""WITH {SQL_USAGE} SELECT model, round(tokens_saved * price / 1000000, 4) AS saved FROM usage,
    (VALUES ('Claude Opus 4', 15.0::DOUBLE), ('Claude Sonnet 4', 3.0), ('Claude Haiku 3.5', 0.8),
            ('GPT-4o', 2.5), ('GPT-4.1', 2.0), ('Gemini 2.5 Pro', 1.25)) m(model, price)""",
)
def saved_cost(spark, sf):
    cost = P.saved_cost(P.usage_stats(audit_log(spark, sf)))
    return cost.select("model", F.round("saved", 4).alias("saved"))


@query(
    "policy_tool_totals",
    "POL22",
    f"""WITH {SQL_LOG} SELECT count(*) AS calls, count(*) FILTER (ok) AS successes,
    count(*) FILTER (ok) * 100 // count(*) AS success_pct,
    (sum(duration_ms) FILTER (ok) // count(*) FILTER (ok))::BIGINT AS avg_ms, (sum(tokens) FILTER (ok))::BIGINT AS tokens FROM log""",
)
def tool_totals(spark, sf):
    return P.tool_call_totals(audit_log(spark, sf))


@query(
    "policy_top_tools",
    "POL22",
    f"""WITH {SQL_LOG} SELECT tool, count(*) AS calls, (sum(duration_ms) // count(*))::BIGINT AS avg_ms
    FROM log WHERE ok GROUP BY tool ORDER BY calls DESC, tool LIMIT 8""",
)
def top_tools(spark, sf):
    return P.top_tools(audit_log(spark, sf))


def mcp_calls(spark, sf):
    e = T.action_events(spark, sf)
    name = F.concat(F.lit("mcp__srv"), F.col("session").cast("string"), F.lit("__"), F.col("tool"))
    return P.call_audit(e.select("event_id", "t", name.alias("tool_name"), F.col("command").alias("arguments")))


@query(
    "policy_call_audit",
    "POL24",
    f"""WITH {SQL_EVENTS} SELECT 'srv' || user_id AS server, event_type AS tool, count(*) AS calls,
    count(DISTINCT left(sha256(command), 16)) AS argument_sets, min(left(sha256(command), 16)) AS first_hash
    FROM ev GROUP BY ALL""",
)
def call_audit(spark, sf):
    return mcp_calls(spark, sf).groupBy("server", "tool").agg(
        F.count("*").alias("calls"),
        F.countDistinct("arguments_hash").alias("argument_sets"),
        F.min("arguments_hash").alias("first_hash"),
    )


@query(
    "policy_top_called_tools",
    "POL33",
    f"""WITH {SQL_EVENTS} SELECT 'mcp__srv' || user_id || '__' || event_type AS tool_name, count(*) AS calls
    FROM ev GROUP BY ALL ORDER BY calls DESC, tool_name LIMIT 10""",
)
def top_called_tools(spark, sf):
    return P.call_counts(mcp_calls(spark, sf), "tool_name", 10)


@query(
    "policy_busy_hours",
    "POL33",
    f"""WITH {SQL_EVENTS}, h AS (SELECT floor(t / 3600)::BIGINT AS hour, count(*) AS calls FROM ev GROUP BY 1),
    a AS (SELECT avg(calls) AS average, count(*) AS hours FROM h)
    SELECT hour, calls, round(average, 6) AS average, round(calls / average, 6) AS ratio
    FROM h, a WHERE hours >= 2 AND calls > 2 * average""",
)
def busy_hours(spark, sf):
    hours = P.busy_hours(T.events(spark, sf), 0.0)
    return hours.select("hour", "calls", F.round("average", 6).alias("average"), F.round("ratio", 6).alias("ratio"))


@query(
    "policy_compliance",
    "POL25",
    """WITH r AS (SELECT o_custkey AS member, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS version FROM orders GROUP BY 1)
    SELECT c_custkey AS member, coalesce(version, '') AS version, coalesce(version = '1-URGENT', false) AS compliant
    FROM customer LEFT JOIN r ON member = c_custkey""",
)
def compliance(spark, sf):
    o = T.load(spark, sf, "orders")
    reports = o.select(
        F.col("o_custkey").alias("member"), F.col("o_orderdate").alias("t"),
        F.col("o_orderkey").alias("report_id"), F.col("o_orderpriority").alias("version"),
    )
    members = T.load(spark, sf, "customer").select(F.col("c_custkey").alias("member"))
    out = P.compliance(members, reports, "1-URGENT")
    return out.withColumn("version", F.coalesce("version", F.lit("")))


def diffs(spark, sf):
    """Edits: the document text is the diff, lang/source/id the path."""
    d = T.load(spark, sf, "documents")
    path = F.concat_ws("/", "lang", "source", F.concat("doc_id", F.lit(".txt")))
    return d.select("doc_id", path.alias("file_path"), F.col("text").alias("diff"), F.lit("edit").alias("action"))


@query(
    "policy_risk_enrichment",
    "POL26 POL27 POL28",
    r"""WITH d AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS x,
      regexp_matches(text, 'payment|billing|auth|migration|secret|credential|password|token|crypt', 'i') AS risky FROM documents),
    n AS (SELECT *, CASE WHEN x = '' THEN 0 ELSE length(x) - length(replace(x, chr(10), ''))
                    + CASE WHEN ends_with(x, chr(10)) THEN 0 ELSE 1 END END AS change_size FROM d)
    SELECT doc_id, change_size::INTEGER AS change_size, CASE WHEN risky THEN 'high' ELSE 'low' END AS file_risk,
      CASE WHEN risky THEN 2 WHEN change_size > 50 THEN 4 ELSE 0 END AS rule_no FROM n""",
)
def risk_enrichment(spark, sf):
    rules = load_rules(
        ["when blast_radius gt 30 then require_approval", P.RISK_AWARE_SAFETY[1],
         P.RISK_AWARE_SAFETY[2], "when change_size gt 50 then ask 'Large change'"]
    )
    edits = diffs(spark, sf).withColumn("path", F.col("diff")).drop("file_path")
    c = P.guard_check(edits, rules, P.DEFAULT_SOURCES)
    return c.select("doc_id", "change_size", "file_risk", F.coalesce("rule_no", F.lit(0)).alias("rule_no"))


@query(
    "policy_codebase_suggestion",
    "POL29",
    r"""WITH f AS (SELECT p_partkey AS line, replace(p_name, ' ', '_') || '_' || p_partkey AS name,
        'src/' || replace(p_brand, '#', '/') || '/m' || p_size || '.py' AS file FROM part),
    fp AS (SELECT DISTINCT name, file, line, unnest(string_split(lower(name), '_')) AS part FROM f),
    a AS (SELECT DISTINCT p_name || '_' || p_type AS action FROM part),
    ap AS (SELECT DISTINCT action, unnest(regexp_split_to_array(lower(action), '[_\-\s]+')) AS part FROM a),
    s AS (SELECT action, name, file, line, count(*) AS shared FROM ap JOIN fp USING (part) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY shared DESC, file, line, name) AS rn FROM s)
    SELECT action, name, shared, 'See ' || name || ' in ' || file || ':' || line
       || ' before writing a new one' AS suggestion FROM r WHERE rn = 1""",
)
def codebase_suggestion(spark, sf):
    f = T.functions(spark, sf)
    entities = f.select(F.lit("function").alias("kind"), "name", "file", F.col("id").alias("line"))
    p = T.load(spark, sf, "part")
    actions = p.select(F.concat_ws("_", "p_name", "p_type").alias("action"))
    return P.codebase_suggestion(actions, entities)


MACHINE = S.Machine(
    name="customer",
    initial="new",
    states={"new": "initial", "active": "active", "engaged": "active", "held": "active", "done": "terminal"},
    transitions={
        ("new", "signup"): "active",
        ("active", "click"): "engaged",
        ("engaged", "purchase"): "done",
        ("held", "signup"): "active",
        ("engaged", "view"): "active",
    },
    fallbacks={"error": "held"},
    reset_event="signup",
    reset_to="active",
    timeouts=(("active", 1.0, "nudge"), ("active", 24.0, "expire"), ("held", 12.0, "release"), ("engaged", 2.0, "remind")),
)

SQL_FSM = f"""{SQL_EVENTS}, tr(f, e, d) AS (VALUES ('new', 'signup', 'active'), ('active', 'click', 'engaged'),
      ('engaged', 'purchase', 'done'), ('held', 'signup', 'active'), ('engaged', 'view', 'active')),
  q AS (SELECT user_id, event_id, t, event_type AS e, value > 5 AS ok,
        row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM ev),
  r AS (SELECT user_id, 0::BIGINT AS rn, -1::BIGINT AS event_id, '' AS from_state, '' AS event, NULL::VARCHAR AS to_state,
           false AS guard_blocked, NULL::VARCHAR AS error, 'new' AS state, 0::DOUBLE AS t FROM (SELECT DISTINCT user_id FROM q)
    UNION ALL
    SELECT user_id, rn, event_id, from_state, event, to_state, guard_blocked, error, coalesce(to_state, from_state), t FROM (
    SELECT q.user_id, q.rn, q.event_id, r.state AS from_state, q.e AS event, q.t,
      CASE WHEN r.state = 'done' THEN CASE WHEN q.e = 'signup' THEN 'active' END
           WHEN tr.d IS NOT NULL THEN CASE WHEN q.ok THEN tr.d END
           WHEN q.e = 'error' THEN 'held' END AS to_state,
      r.state <> 'done' AND tr.d IS NOT NULL AND NOT q.ok AS guard_blocked,
      CASE WHEN r.state = 'done' AND q.e <> 'signup' THEN 'Terminal state: done'
           WHEN r.state <> 'done' AND tr.d IS NULL AND q.e <> 'error' THEN 'No transition from ' || r.state || ' on ' || q.e END AS error
    FROM r JOIN q ON q.user_id = r.user_id AND q.rn = r.rn + 1 LEFT JOIN tr ON tr.f = r.state AND tr.e = q.e))"""


def fsm_events(spark, sf):
    e = T.events(spark, sf)
    return e.select(
        F.col("user_id").alias("instance"), "t", "event_id", F.col("event_type").alias("event"),
        (F.col("value") > 5).alias("guard_ok"),
    )


@query(
    "policy_fsm_replay",
    "POL30",
    f"""WITH RECURSIVE {SQL_FSM} SELECT user_id AS instance, event_id, from_state, event,
    coalesce(to_state, '') AS to_state, to_state IS NOT NULL AS success, guard_blocked, coalesce(error, '') AS error
    FROM r WHERE rn > 0""",
)
def fsm_replay(spark, sf):
    return S.replay(fsm_events(spark, sf), MACHINE).fillna("", ["to_state", "error"])


@query(
    "policy_fsm_timeouts",
    "POL31",
    f"""WITH RECURSIVE {SQL_FSM}, last AS (SELECT user_id, state, t FROM r
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1),
    lim(state, hours, event) AS (VALUES ('active', 1.0::DOUBLE, 'nudge'), ('active', 24.0, 'expire'), ('held', 12.0, 'release'), ('engaged', 2.0, 'remind'))
    SELECT user_id AS instance, state, arg_max(event, hours) AS event, max(hours) AS hours
    FROM last JOIN lim USING (state) WHERE (1706659200 - t) / 3600 >= hours GROUP BY ALL""",
)
def fsm_timeouts(spark, sf):
    e = fsm_events(spark, sf)
    states = S.final_states(e, S.replay(e, MACHINE))
    return S.due_timeouts(states, MACHINE, 1706659200.0)


@query(
    "policy_unary_truth",
    "POL5 POL6",
    f"""WITH {SQL_EVENTS}, u AS (SELECT event_type, k % 3 = 0 AS flag, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'false' ELSE 'true' END AS word, value FROM ev)
    SELECT event_type, count(*) FILTER (flag) AS yes, count(*) FILTER (NOT flag) AS no, count(*) FILTER (word = 'true') AS word_yes, count(*) FILTER (coalesce(word, '') IN ('false', '')) AS word_no,
      count(*) FILTER (coalesce(word, '') = '') AS empty, count(*) FILTER (coalesce(word, '') <> '') AS filled,
      sum(CASE WHEN flag AND value > 50 THEN 2 WHEN value > 100 THEN 1 ELSE 0 END)::BIGINT AS points, count(*) FILTER (CASE WHEN flag THEN 'x' ELSE word END = 'x') AS branch
    FROM u GROUP BY 1""",
)
def unary_truth(spark, sf):
    k = F.col("k")
    word = F.when(k % 4 == 1, "").when(k % 4 == 2, "false").when(k % 4 == 3, "true")
    e = T.events(spark, sf).select("event_type", (k % 3 == 0).alias("flag"), word.alias("word"), "value")

    def n(field, op):
        return F.count_if(compare(e, field, op))

    points = F.coalesce(ruleset((F.col("flag") & (F.col("value") > 50), F.lit(2)), (F.col("value") > 100, F.lit(1))), F.lit(0))
    return e.groupBy("event_type").agg(
        n("flag", "is_true").alias("yes"), n("flag", "is_false").alias("no"), n("word", "is_true").alias("word_yes"),
        n("word", "is_false").alias("word_no"), n("word", "is_empty").alias("empty"), n("word", "is_not_empty").alias("filled"),
        F.sum(points).alias("points"), F.count_if(if_else(F.col("flag"), F.lit("x"), F.col("word")) == "x").alias("branch"),
    )


@query(
    "policy_rules_from_table",
    "POL9",
    f"""WITH {SQL_EVENTS}, r AS (SELECT n_nationkey AS ord, n_nationkey * 4 AS bound FROM nation),
    f AS (SELECT event_id, min(ord) AS ord FROM ev JOIN r ON k = bound AND value > ord GROUP BY 1)
    SELECT 'when k eq ' || f.ord * 4 || ' and amount gt ' || f.ord || ' then ' || CASE WHEN f.ord % 2 = 0 THEN 'block' ELSE 'ask' END AS rule, count(*) AS n FROM f GROUP BY 1""",
)
def rules_from_table(spark, sf):
    """Rule texts are read from a table: one per nation."""
    i = F.col("n_nationkey")
    dsl = F.concat(F.lit("when k eq "), i * 4, F.lit(" and amount gt "), i, F.lit(" then "), F.when(i % 2 == 0, "block").otherwise("ask"))
    rules = P.collect_rules(T.load(spark, sf, "nation").select(i.alias("ord"), dsl.alias("dsl")))
    c = P.guard_check(T.action_events(spark, sf), rules).where("rule is not null")
    return c.groupBy("rule").agg(F.count("*").alias("n"))


@query(
    "policy_compliance_summary",
    "POL25",
    """WITH r AS (SELECT o_custkey AS member, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS version FROM orders GROUP BY 1)
    SELECT count(*) AS total, count(*) FILTER (coalesce(version = '1-URGENT', false)) AS compliant, count(*) FILTER (NOT coalesce(version = '1-URGENT', false)) AS non_compliant
    FROM customer LEFT JOIN r ON member = c_custkey""",
)
def compliance_totals(spark, sf):
    return P.compliance_summary(compliance(spark, sf))


@query(
    "policy_table_source",
    "POL28",
    f"""WITH {SQL_EVENTS}, n AS (SELECT o_custkey AS session, count(*) AS blast_radius FROM orders GROUP BY 1)
    SELECT coalesce(blast_radius, 0) > 12 AS risky, count(*) AS n FROM ev LEFT JOIN n ON session = user_id GROUP BY 1""",
)
def table_source(spark, sf):
    """A risk source that comes from a table: open orders of the session's customer."""
    n = T.load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("session")).agg(F.count("*").alias("blast_radius"))
    e = P.attach_policy_dimension(T.action_events(spark, sf), n, "session")
    c = P.guard_check(e, load_rules(["when blast_radius gt 12 then require_approval"]))
    return c.groupBy(F.col("rule").isNotNull().alias("risky")).agg(F.count("*").alias("n"))
