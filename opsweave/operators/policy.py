"""Policy evaluation over action events: verdicts, rule tables, risk enrichment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsweave.functions.sizes import broadcast_if_small
from opsweave.operators.rules import BLOCKING, Rule, condition, load_rules

Source = Callable[[DataFrame], "Column | DataFrame"]

# Preset rules.
PRODUCTION_SAFETY = (
    "when action contains 'delete' and environment eq 'production' then block",
    "when action contains 'terminate' and environment eq 'production' then block",
    "when action contains 'drop' and environment eq 'production' then block",
    "when action contains 'remove' and environment eq 'production' then block",
)
BUSINESS_HOURS = (
    "when day_of_week eq 'Saturday' then block",
    "when day_of_week eq 'Sunday' then block",
)
DEPLOY_SAFETY = (
    "when action contains 'deploy' and risk_score gt 0.7 and day_of_week eq 'Friday' then block",
    "when action contains 'deploy' and test_pass_rate lt 100 then block",
    "when skip_final_snapshot is_true then block",
)
RISK_AWARE_SAFETY = (
    "when blast_radius gt 30 then require_approval",
    "when file_risk eq 'high' and action contains 'edit' then ask 'This file is high-risk'",
    "when caller_count gt 20 then suggest "
    "'This function has many callers -- test carefully'",
    "when change_size gt 500 then ask 'Large change -- review before proceeding'",
)
# Path patterns of high-risk files.
HIGH_RISK_PATHS = (
    "payment", "billing", "auth", "migration", "secret",
    "credential", "password", "token", "crypt",
)


def spend_limit(maximum: float = 100) -> tuple[str, ...]:
    return tuple(
        f"when {field} gt {maximum} then require_approval" for field in ("amount", "spend", "cost")
    )


# --- risk sources -----------------------------------------------------------------


def _given(df: DataFrame, *names: str) -> Column:
    """First non-empty of the named columns that exist, else the empty text."""
    cols = [F.when(df[n].cast("string") != "", df[n].cast("string")) for n in names if n in df.columns]
    return F.coalesce(*cols, F.lit(""))


def file_risk(df: DataFrame) -> Column:
    path = _given(df, "file", "file_path", "path")
    return F.when(path.rlike("(?i)" + "|".join(HIGH_RISK_PATHS)), "high").otherwise("low")


def change_size(df: DataFrame) -> Column:
    """Lines of the diff; a trailing line break does not start another line."""
    text = _given(df, "diff", "change")
    lines = F.array(F.split(text, r"\r\n|[\n\x0B\f\r\x1c\x1d\x1e\x85\u2028\u2029]"))
    open_end = F.transform(
        lines, lambda x: F.size(x) - F.when(F.element_at(x, -1) == "", 1).otherwise(0)
    )  # the lambda variable keeps the split from being evaluated twice
    return F.get(open_end, F.lit(0))


DEFAULT_SOURCES: dict[str, Source] = {"file_risk": file_risk, "change_size": change_size}


def enrich(df: DataFrame, rules: Sequence[Rule], sources: dict[str, Source] | None = None) -> DataFrame:
    """Add only the risk columns the rules mention and the events do not carry.

    A source is a function of the events that returns a Column, or a whole frame
    with the named column added (for sources that need a join).
    """
    wanted = set().union(*[r.fields for r in rules]) if rules else set()
    for name, make in (sources if sources is not None else DEFAULT_SOURCES).items():
        if name in wanted and name not in df.columns:
            made = make(df)
            df = made if isinstance(made, DataFrame) else df.withColumn(name, made)
    return df


def tokens(col: Column) -> Column:
    """Lower-case name parts, split at ``_``, ``-`` and blanks."""
    return F.filter(F.split(F.lower(col), r"[_\-\s]+"), lambda x: x != "")


def codebase_suggestion(actions: DataFrame, entities: DataFrame) -> DataFrame:
    """Per distinct action text the function sharing most name parts.

    ``actions(action)``, ``entities(kind, name, file, line)``. Ties go to the
    smallest (file, line, name). Functions that hold the same of the words asked for
    share as many with every action, so only the smallest of each such set, and each
    set of an action's words once, meet; repeated rows of a function count as often.
    """
    names = entities.where((F.col("kind") == "function") & (F.col("name") != ""))
    camel = F.regexp_replace("name", "([a-z])([A-Z])", "$1_$2")
    parts = names.groupBy("name", "file", "line").agg(F.count("*").alias("times")).select(
        "name", "file", "line", "times", F.explode(F.array_union(tokens(F.col("name")), tokens(camel))).alias("part"),
    )
    asked = actions.select("action").distinct()
    word_sets = asked.select("action", F.array_sort(F.array_distinct(tokens(F.col("action")))).alias("words"))
    vocabulary = word_sets.select(F.explode("words").alias("part")).distinct()
    held = parts.join(broadcast_if_small(vocabulary), "part").groupBy("name", "file", "line", "times").agg(
        F.array_sort(F.collect_list("part")).alias("held")
    )
    least = held.groupBy("held", "times").agg(F.min(F.struct("file", "line", "name")).alias("f"))
    words = word_sets.select("words").distinct().select("words", F.explode("words").alias("part"))
    met = words.join(least.select("held", "times", "f", F.explode("held").alias("part")), "part")
    counted = met.groupBy("words", "held", "times").agg(F.count("*").alias("n"), F.first("f").alias("f"))
    per_set = counted.groupBy("words").agg(
        F.min(F.struct((-F.col("n") * F.col("times")).alias("neg"), "f.file", "f.line", "f.name")).alias("b")
    )
    best = word_sets.join(per_set, "words").select("action", "b")
    return best.select(
        "action",
        F.col("b.name").alias("name"),
        (-F.col("b.neg")).alias("shared"),
        F.concat(
            F.lit("See "), F.col("b.name"), F.lit(" in "),
            F.col("b.file"), F.lit(":"), F.col("b.line").cast("string"),
            F.lit(" before writing a new one"),
        ).alias("suggestion"),
    )


# --- verdicts ---------------------------------------------------------------------


def _prepared(events: DataFrame, rules: Sequence[Rule], sources, dialect):
    active = [r for r in rules if r.actionable]
    df = enrich(events, active, sources)
    return df, active, [condition(df, r, dialect) for r in active]


def guard_check(
    events: DataFrame,
    rules: Sequence[Rule],
    sources: dict[str, Source] | None = None,
    dialect: str = "null",
) -> DataFrame:
    """First matching rule decides. One projection, no shuffle.

    Adds ``rule_no`` (1-based, null when allowed), ``blocked``, ``allowed``,
    ``rule``, ``action_taken`` and ``suggestion``.
    """
    df, active, conds = _prepared(events, rules, sources, dialect)
    if not active:
        none = F.lit(None).cast("string")
        return df.select(
            "*", F.lit(None).cast("int").alias("rule_no"), F.lit(False).alias("blocked"),
            F.lit(True).alias("allowed"), none.alias("rule"),
            none.alias("action_taken"), none.alias("suggestion"),
        )
    first = F.coalesce(*[F.when(c, F.lit(i + 1)) for i, c in enumerate(conds)])

    def pick(values: list[str | None]) -> Column:
        return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.col("rule_no") - 1)

    hard = F.array(*[F.lit(r.action in BLOCKING) for r in active])
    return df.withColumn("rule_no", first).select(
        "*",
        F.coalesce(F.get(hard, F.col("rule_no") - 1), F.lit(False)).alias("blocked"),
        F.col("rule_no").isNull().alias("allowed"),
        pick([r.text for r in active]).alias("rule"),
        pick([r.action for r in active]).alias("action_taken"),
        pick([r.suggestion for r in active]).alias("suggestion"),
    )


def all_matches(
    events: DataFrame,
    rules: Sequence[Rule],
    sources: dict[str, Source] | None = None,
    dialect: str = "null",
) -> DataFrame:
    """Every rule that fires per event; ``shadowed`` marks all but the first."""
    df, active, conds = _prepared(events, rules, sources, dialect)
    fired = F.array_compact(
        F.array(
            *[
                F.when(c, F.struct(F.lit(i + 1).alias("rule_no"), F.lit(r.text).alias("rule")))
                for i, (r, c) in enumerate(zip(active, conds, strict=True))
            ]
        )
    )
    return df.select("*", F.posexplode(fired).alias("_pos", "_hit")).select(
        *df.columns, "_hit.rule_no", "_hit.rule", (F.col("_pos") > 0).alias("shadowed")
    )


def split_outputs(checked: DataFrame, command: str = "command") -> dict[str, DataFrame]:
    """The three outputs of a guarded stream; a rewrite replaces the command."""
    rewritten = checked.where(F.col("action_taken") == "rewrite")
    return {
        "allowed": checked.where("allowed"),
        "blocked": checked.where("blocked"),
        "rewritten": rewritten.withColumn(command, F.col("suggestion")),
    }


# --- rule tables ------------------------------------------------------------------


def stack_profiles(profiles: DataFrame, stack: str) -> DataFrame:
    """Concatenate the named profiles (``a+b``) of ``profiles(profile, ord, dsl)``;
    a repeated rule keeps its first place."""
    names = stack.split("+")
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("profile"))
    picked = profiles.where(F.col("profile").isin(*names)).withColumn("place", place)
    return picked.groupBy("dsl").agg(F.min(F.struct("place", "ord", "profile")).alias("f")).select(
        "dsl", F.col("f.profile").alias("profile"), F.col("f.place").alias("place"),
        F.col("f.ord").alias("ord"),
    )


def effective_rules(rules: DataFrame, disabled: DataFrame, policy: DataFrame) -> DataFrame:
    """Policy rules first and always; other rules unless disabled. All frames
    carry ``(ord, dsl)``."""
    own = rules.join(policy.select("dsl"), "dsl", "left_anti").join(
        disabled.select("dsl"), "dsl", "left_anti"
    )
    enforced = policy.select(F.lit(0).alias("layer"), "ord", "dsl", F.lit(True).alias("enforced"))
    rest = own.select(F.lit(1).alias("layer"), "ord", "dsl", F.lit(False).alias("enforced"))
    return enforced.unionByName(rest)


def collect_rules(rules: DataFrame, limit: int = 5000) -> list[Rule]:
    """Rule texts of a (checked, small) rules table ``(…, dsl)`` in their order."""
    order = [c for c in ("layer", "place", "ord") if c in rules.columns]
    rows = rules.orderBy(*order).select("dsl").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rules")
    return load_rules(r.dsl for r in rows)


def rules_table(spark: SparkSession, profile: str, texts: Sequence[str]) -> DataFrame:
    rows = [(profile, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "profile string, ord int, dsl string")


# --- text of events -----------------------------------------------------------------


def event_class(rule: Column) -> Column:
    """Struct (category, severity) from the rule text; first match wins."""

    def has(*words: str) -> Column:
        test = rule.contains(words[0])
        for w in words[1:]:
            test = test | rule.contains(w)
        return test

    def made(category: str, severity: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"))

    # Words per category.
    return (
        F.when(has("rm -rf /", "mkfs", "dd if="), made("data_destruction", "critical"))
        .when(has("DROP DATABASE", "DROP TABLE"), made("data_loss", "critical"))
        .when(
            has("kubectl delete pvc", "kubectl delete namespace", "terraform destroy"),
            made("infrastructure", "high"),
        )
        .when(has("git push --force", "git reset --hard"), made("code_loss", "high"))
        .when(has(".env", "credentials", "id_rsa", ".ssh"), made("secret_exposure", "high"))
        .when(has("chmod 777", "rm -rf ."), made("misconfiguration", "medium"))
        .when(has("npm publish", "docker push", "TRUNCATE"), made("publish_risk", "medium"))
        .otherwise(made("other", "low"))
    )


def command_preview(command: Column, home: str | None = None) -> Column:
    """Home folders masked; more than 100 bytes become the first 97 and ``...``."""
    text = command
    for prefix, mask in ((home, "~"), ("/home/", "/~/"), ("/Users/", "/~/")):
        if prefix:
            text = F.replace(text, F.lit(prefix), F.lit(mask))
    cut = F.concat(F.substring(text, 1, 97), F.lit("..."))
    return F.when(F.octet_length(text) > 100, cut).otherwise(text)


def relative_age(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return (
        F.when(s < 0, None)
        .when(s < 60, F.concat(s.cast("string"), F.lit("s ago")))
        .when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m ago")))
        .when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d ago")))
    )


# --- reports over the audit log -----------------------------------------------------


def guard_stats(log: DataFrame) -> DataFrame:
    """Totals of the audit log ``(ts, tool, action, reason, detail)``."""
    blocked = (F.col("action") == "block") & (F.col("reason") == "guard_rule")
    return log.agg(
        F.count("*").alias("total"),
        F.count_if(blocked).alias("blocked_by_rule"),
        F.count_if(F.col("action") == "allow").alias("allowed"),
    )


def recent_blocks(log: DataFrame, k: int = 5) -> DataFrame:
    blocked = (F.col("action") == "block") & (F.col("reason") == "guard_rule")
    return log.where(blocked).orderBy(F.desc("ts"), F.desc("event_id")).limit(k)


def last_block(log: DataFrame, now: float) -> DataFrame:
    """The latest block and how long ago it was, seen from ``now`` (epoch seconds)."""
    row = log.where(F.col("action") == "block").agg(
        F.max_by(F.struct("t", "tool", "detail", "action"), F.struct("t", "event_id")).alias("b")
    )
    return row.select("b.*").withColumn("ago", relative_age(F.lit(now) - F.col("t")))


def usage_stats(log: DataFrame) -> DataFrame:
    """Blocks by reason with the saved tokens and seconds."""
    block = F.col("action") == "block"
    base = log.agg(
        F.count_if(block & F.col("reason").isin("code_search", "bash_code_search")).alias("searches"),
        F.count_if(block & (F.col("reason") == "full_file_read")).alias("reads"),
        F.count_if(block).alias("blocks"),
        F.count_if(F.col("action") == "allow").alias("allows"),
        F.count_if(F.col("reason") == "degraded").alias("degraded"),
    )
    return base.withColumns(
        {
            "tokens_saved": F.col("reads") * 3950 + F.col("searches") * 1200,
            "seconds_saved": F.col("searches") * 3 + F.col("reads") * 4,
        }
    )


# Price per million input tokens.
MODEL_PRICES = (
    ("Claude Opus 4", 15.00),
    ("Claude Sonnet 4", 3.00),
    ("Claude Haiku 3.5", 0.80),
    ("GPT-4o", 2.50),
    ("GPT-4.1", 2.00),
    ("Gemini 2.5 Pro", 1.25),
)


def saved_cost(usage: DataFrame) -> DataFrame:
    prices = F.array(
        *[F.struct(F.lit(m).alias("model"), F.lit(p).alias("price")) for m, p in MODEL_PRICES]
    )
    return usage.select("tokens_saved", F.explode(prices).alias("m")).select(
        "m.model", (F.col("tokens_saved") * F.col("m.price") / 1_000_000).alias("saved")
    )


def tool_call_totals(calls: DataFrame) -> DataFrame:
    """``calls(tool, duration_ms, tokens, ok)``; averages are over successes, floored."""
    ok = F.col("ok")
    t = calls.agg(
        F.count("*").alias("calls"),
        F.count_if(ok).alias("successes"),
        F.sum(F.when(ok, F.col("tokens"))).alias("tokens"),
        F.sum(F.when(ok, F.col("duration_ms"))).alias("ms"),
    )
    return t.select(
        "calls",
        "successes",
        F.floor(F.col("successes") * 100 / F.col("calls")).alias("success_pct"),
        F.coalesce(F.floor(F.col("ms") / F.nullif(F.col("successes"), F.lit(0))), F.lit(0)).alias("avg_ms"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )


def top_tools(calls: DataFrame, k: int = 8) -> DataFrame:
    per = calls.where("ok").groupBy("tool").agg(
        F.count("*").alias("calls"), F.floor(F.sum("duration_ms") / F.count("*")).alias("avg_ms")
    )
    return per.orderBy(F.desc("calls"), "tool").limit(k)


def call_audit(calls: DataFrame) -> DataFrame:
    """Server and tool of ``mcp__<server>__<tool>`` names and a short argument hash."""
    parts = F.split("tool_name", "__", 3)
    return calls.withColumns(
        {
            "server": F.coalesce(F.get(parts, F.lit(1)), F.lit("unknown")),
            "tool": F.coalesce(F.get(parts, F.lit(2)), F.col("tool_name")),
            "arguments_hash": F.substring(F.sha2(F.col("arguments"), 256), 1, 16),
        }
    )


def busy_hours(calls: DataFrame, since: float) -> DataFrame:
    """Hours with more than twice the average of the active hours (two or more)."""
    hours = (
        calls.where(F.col("t") >= since)
        .groupBy(F.floor(F.col("t") / 3600).cast("long").alias("hour"))
        .agg(F.count("*").alias("calls"))
    )
    avg = hours.agg(F.avg("calls").alias("average"), F.count("*").alias("hours"))
    return (
        hours.crossJoin(F.broadcast(avg))  # one row
        .where((F.col("hours") >= 2) & (F.col("calls") > 2 * F.col("average")))
        .select("hour", "calls", "average", (F.col("calls") / F.col("average")).alias("ratio"))
    )


def call_counts(calls: DataFrame, by: str, k: int | None = None) -> DataFrame:
    counted = calls.groupBy(by).agg(F.count("*").alias("calls"))
    return counted.orderBy(F.desc("calls"), by).limit(k) if k else counted


def compliance(members: DataFrame, reports: DataFrame, version: str) -> DataFrame:
    """Per member the latest reported policy version and whether it is the wanted one."""
    latest = reports.groupBy("member").agg(
        F.max_by("version", F.struct("t", "report_id")).alias("version")
    )
    return members.join(latest, "member", "left").withColumn(
        "compliant", F.coalesce(F.col("version") == version, F.lit(False))
    )


def compliance_summary(status: DataFrame) -> DataFrame:
    return status.agg(
        F.count("*").alias("total"),
        F.count_if("compliant").alias("compliant"),
        F.count_if(~F.col("compliant")).alias("non_compliant"),
    )


def attach_policy_dimension(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Risk sources that come from a table (callers, blast radius) join on ``key``."""
    return events.join(broadcast_if_small(dimension), key, "left")
