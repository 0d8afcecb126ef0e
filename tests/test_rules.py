import pytest
from pyspark.sql import functions as F

from opsweave.operators import policy as P
from opsweave.operators.rules import compare, load_rule, load_rules

RULES = load_rules(
    [
        "when tool eq 'Bash' and command contains 'rm -rf / ' then block",
        "when tool eq 'Bash' and command contains 'rm -rf .' then suggest 'Use git clean -fd'",
        "when tool eq 'Bash' and command contains 'git push --force' then rewrite 'git push --force-with-lease'",
        "when action contains 'drop' and environment eq 'production' then block",
        "when amount gt 100 then require_approval",
        "when skip is_true or not file is_empty and n lte 3 then ask 'left fold'",
    ]
)


def check(spark, **context):
    schema = "tool string, command string, action string, environment string, amount string, skip boolean, file string, n int"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(context.get(n) for n in names)], schema)
    return P.guard_check(df, RULES).first()


@pytest.mark.parametrize(
    "context, action",
    [
        ({"tool": "Bash", "command": "rm -rf / --no-preserve-root"}, "block"),
        ({"tool": "Bash", "command": "rm -rf ."}, "suggest"),
        ({"tool": "Bash", "command": "git push --force origin main"}, "rewrite"),
        ({"tool": "Bash", "command": "git push origin main"}, None),
        ({"action": "DROP_table", "environment": "production"}, "block"),
        ({"amount": "100.5"}, "require_approval"),
        ({"amount": "lots"}, None),
        ({"skip": True, "n": 9}, None),  # (skip or file) and n <= 3
        ({"skip": True, "n": 3}, "ask"),
        ({"file": "a", "n": 1}, "ask"),
    ],
)
def test_first_match(spark, context, action):
    row = check(spark, **context)
    assert row.action_taken == action
    assert row.allowed == (action is None)
    assert row.blocked == (action in ("block", "require_approval"))


def test_rewrite_carries_the_new_command(spark):
    assert check(spark, tool="Bash", command="git push --force").suggestion == "git push --force-with-lease"


def test_loading():
    assert load_rule("# comment") is None
    assert load_rule("// comment") is None
    assert load_rule("") is None
    assert load_rule("nonsense then block") is None
    assert load_rule("when x eq 1 then rewrite").action == "block"
    quoted = load_rule("when x eq 'a and b contains c' then block")
    assert quoted.clauses[0].op == "eq" and quoted.clauses[0].value == "a and b contains c"
    assert load_rule("when x eq '7' then block").clauses[0].value == "7"
    assert load_rule("when x gt 7 then block").clauses[0].value == 7
    assert load_rule("IF x is_empty THEN deny \"because\"").suggestion == "because"


def test_null_semantics_and_bad_regex(spark):
    df = spark.createDataFrame([(None, 0)], "v string, z int")
    false = [("contains", "none"), ("eq", "None"), ("starts_with", ""), ("matches", "."), ("gt", 0), ("is_true", None)]
    true = [("not_contains", "x"), ("neq", "x"), ("not_in", "abc"), ("is_false", None), ("is_empty", None)]
    cols = [compare(df, "v", op, v).alias(f"f{i}") for i, (op, v) in enumerate(false)]
    cols += [compare(df, "v", op, v).alias(f"t{i}") for i, (op, v) in enumerate(true)]
    row = df.select(*cols).first().asDict()
    assert all(v is False for k, v in row.items() if k[0] == "f")
    assert all(v is True for k, v in row.items() if k[0] == "t")
    text = df.select(
        compare(df, "v", "contains", "none", dialect="none_text").alias("a"),
        compare(df, "missing", "eq", "None", dialect="none_text").alias("b"),
        compare(df, "v", "matches", "(unclosed").alias("c"),
    ).first()
    assert (text.a, text.b, text.c) == (True, True, False)


def test_dotted_names_and_typed_text(spark):
    df = spark.sql("select named_struct('email', 'a@b') as contact, map('k', 'v') as m, true as b, 12345678.0D as d")
    row = df.select(
        compare(df, "contact.email", "ends_with", "@b").alias("s"), compare(df, "m.k", "eq", "v").alias("m"),
        compare(df, "b", "eq", "True").alias("b"), compare(df, "d", "eq", "12345678.0").alias("d"),
        compare(df, "contact.nope", "is_empty").alias("n"),
    ).first()
    assert all(row)


def test_many_rules_stay_one_projection(spark):
    rules = load_rules(f"when command contains 'word{i} ' and n lt {i} then block" for i in range(300))
    df = spark.range(50).select(F.concat(F.lit("word"), F.col("id") * 7, F.lit(" x")).alias("command"), F.lit(3).alias("n"))
    out = P.guard_check(df, rules)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.command: r.rule_no for r in out.collect()}
    assert got["word14 x"] == 15 and got["word0 x"] is None and got["word343 x"] is None


def test_enrichment_is_lazy_and_never_overwrites(spark):
    df = spark.createDataFrame([("src/payments/charge.py", "a\nb\n", "high-ish")], "file string, diff string, file_risk string")
    rules = load_rules(["when change_size gt 1 then ask 'x'", "when file_risk eq 'high' then block"])
    out = P.enrich(df, rules, {**P.DEFAULT_SOURCES, "unused": lambda d: 1 / 0})
    row = out.first()
    assert row.change_size == 2 and row.file_risk == "high-ish" and "unused" not in out.columns


def test_file_risk(spark):
    df = spark.createDataFrame([("src/payments/charge.py",), ("src/components/Button.tsx",), (None,)], "file string")
    assert [r.r for r in df.select(P.file_risk(df).alias("r")).collect()] == ["high", "low", "low"]
