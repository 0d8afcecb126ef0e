"""Rule texts to Column predicates.

A rule reads ``when <clause> [and|or <clause> ...] then <action> ['message']``; a
clause is ``[not] <field> [<op> [<value>]]``. Clauses fold from the left without
precedence. Quoted text is one word: it is never split or searched for operators.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Action classes and operator names of the rule language.
BLOCKING = ("block", "block_deploy", "deny", "require_approval")
SOFT = ("suggest", "rewrite", "ask")
UNARY = ("is_true", "is_false", "is_empty", "is_not_empty")
BINARY = (
    "eq", "neq", "gt", "gte", "lt", "lte", "contains", "not_contains",
    "starts_with", "ends_with", "matches", "in", "not_in",
)

_WORD = re.compile(r"'[^']*'|\"[^\"]*\"|\S+")


@dataclass(frozen=True)
class Clause:
    field: str
    op: str = "truthy"
    value: Any = None
    negated: bool = False


@dataclass(frozen=True)
class Rule:
    text: str
    clauses: tuple[Clause, ...]
    joins: tuple[str, ...]
    action: str
    suggestion: str | None

    @property
    def actionable(self) -> bool:
        return self.action in BLOCKING or self.action in SOFT

    @property
    def fields(self) -> frozenset[str]:
        return frozenset(c.field for c in self.clauses)


def _unquote(word: str) -> tuple[str, bool]:
    quoted = len(word) >= 2 and word[0] == word[-1] and word[0] in "'\""
    return (word[1:-1], True) if quoted else (word, False)


def _value(words: list[str]) -> Any:
    if len(words) == 1:
        text, quoted = _unquote(words[0])
        if not quoted:
            for kind in (int, float):
                try:
                    return kind(text)
                except ValueError:
                    pass
        return text
    return " ".join(words)


def _clause(words: list[str]) -> Clause:
    negated = len(words) > 1 and words[0].lower() == "not"
    if negated:
        words = words[1:]
    for i, word in enumerate(words):
        if i and word in UNARY:
            return Clause(" ".join(words[:i]), word, None, negated)
        if i and word in BINARY:
            return Clause(" ".join(words[:i]), word, _value(words[i + 1 :]), negated)
    return Clause(" ".join(words), negated=negated)


def load_rule(text: str) -> Rule | None:
    """One rule, or None for comments, blanks and texts that are not rules."""
    text = text.strip()
    if text.startswith(("#", "//")):
        return None
    words = _WORD.findall(text)
    lowered = [w.lower() for w in words]
    if "then" not in lowered or lowered[0] not in ("when", "if"):
        return None
    cut = lowered.index("then")
    if cut < 2 or cut + 1 >= len(words):
        return None
    groups: list[list[str]] = [[]]
    joins: list[str] = []
    for word, low in zip(words[1:cut], lowered[1:cut], strict=True):
        if low in ("and", "or") and groups[-1]:
            joins.append(low)
            groups.append([])
        else:
            groups[-1].append(word)
    if not groups[-1]:
        return None
    message = ""
    if cut + 2 < len(words):
        body, quoted = _unquote(words[cut + 2])
        message = body if quoted else ""
    action = words[cut + 1].lower()
    if action == "rewrite" and not message:
        action = "block"  # nothing to rewrite to
    return Rule(text, tuple(map(_clause, groups)), tuple(joins), action, message or None)


def load_rules(texts: Iterable[str]) -> list[Rule]:
    return [r for r in map(load_rule, texts) if r is not None]


def resolve(df: DataFrame, name: str) -> tuple[Column, T.DataType | None]:
    """A dotted variable: column, struct field, map entry or variant path."""
    head, *rest = name.split(".")
    if head not in df.columns:
        return F.lit(None).cast("string"), None
    col, kind = df[head], df.schema[head].dataType
    for i, part in enumerate(rest):
        if isinstance(kind, T.StructType) and part in kind.fieldNames():
            col, kind = col[part], kind[part].dataType
        elif isinstance(kind, T.MapType):
            col, kind = col.getItem(part), kind.valueType
        elif isinstance(kind, T.VariantType):
            path = "$." + ".".join(rest[i:])
            return F.try_variant_get(col, path, "string"), T.StringType()
        else:
            return F.lit(None).cast("string"), None
    return col, kind


def _text(col: Column, kind: T.DataType | None) -> Column:
    """The text of a value: booleans capitalised, doubles without exponent."""
    if isinstance(kind, T.BooleanType):
        return F.when(col, "True").when(~col, "False")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = F.regexp_replace(col.cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
        size = F.abs(col)
        wide = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3))
        return F.when(wide, plain).otherwise(col.cast("string"))
    return col.cast("string")


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the regex engine accepts the pattern (asked once, on a literal)."""
    try:
        spark.range(1).select(F.lit("").rlike(f"(?i){pattern}")).collect()
    except (PySparkException, ValueError):
        return False
    return True


def compare(df: DataFrame, field: str, op: str, value: Any = None, dialect: str = "null") -> Column:
    """One comparison as a never-null boolean.

    ``dialect='null'``: a missing value fails every text test and passes the
    negated ones. ``dialect='none_text'``: a missing value is the text ``None``.
    """
    col, kind = resolve(df, field)
    text = _text(col, kind)
    if dialect == "none_text":
        text = F.coalesce(text, F.lit("None"))
    needle = str(value)
    no, yes = F.lit(False), F.lit(True)

    if op == "truthy":
        if isinstance(kind, T.BooleanType):
            return F.coalesce(col, no)
        if isinstance(kind, T.NumericType):
            return F.coalesce(col != 0, no)
        return F.coalesce(col.cast("string") != "", no)
    if op == "eq":
        return F.coalesce(text == needle, no)
    if op == "neq":
        return F.coalesce(text != needle, yes)
    if op in ("gt", "gte", "lt", "lte"):
        try:
            bound = F.lit(float(value))
        except (TypeError, ValueError):
            return no
        number = col.cast("double") if isinstance(kind, T.NumericType) else (
            col.cast("string").try_cast("double")
        )
        test = {
            "gt": number > bound, "gte": number >= bound,
            "lt": number < bound, "lte": number <= bound,
        }[op]
        return F.coalesce(test, no)
    if op == "contains":
        return F.coalesce(F.lower(text).contains(needle.lower()), no)
    if op == "not_contains":
        return F.coalesce(~F.lower(text).contains(needle.lower()), yes)
    if op == "starts_with":
        return F.coalesce(text.startswith(needle), no)
    if op == "ends_with":
        return F.coalesce(text.endswith(needle), no)
    if op == "matches":
        if not valid_pattern(df.sparkSession, needle):
            return no
        return F.coalesce(text.rlike(f"(?i){needle}"), no)
    if op in ("in", "not_in"):
        if isinstance(value, (list, tuple, set, frozenset)):
            hit = col.isin(*value) if value else no
        else:
            hit = F.lit(needle).contains(text)
        hit = F.coalesce(hit, no)
        return hit if op == "in" else ~hit
    if op == "is_true":
        return F.coalesce(col if isinstance(kind, T.BooleanType) else col.cast("string") == "true", no)
    if op == "is_false":
        if isinstance(kind, T.BooleanType):
            return F.coalesce(~col, yes)
        if isinstance(kind, T.NumericType):
            return F.coalesce(col == 0, yes)
        return F.coalesce(col.cast("string").isin("false", ""), yes)
    if op == "is_empty":
        return F.coalesce(col.cast("string") == "", yes)
    if op == "is_not_empty":
        return F.coalesce(col.cast("string") != "", no)
    return no


def condition(df: DataFrame, rule: Rule, dialect: str = "null") -> Column:
    """The rule's condition over the columns of ``df`` (left fold of its clauses)."""
    total: Column | None = None
    for i, c in enumerate(rule.clauses):
        test = compare(df, c.field, c.op, c.value, dialect)
        test = ~test if c.negated else test
        if total is None:
            total = test
        else:
            total = (total & test) if rule.joins[i - 1] == "and" else (total | test)
    return total


def if_else(cond: Column, then: Column, other: Column | None = None) -> Column:
    return F.when(cond, then).otherwise(other if other is not None else F.lit(None))


def ruleset(*branches: tuple[Column, Column]) -> Column:
    """First branch whose condition holds and whose value is not null."""
    return F.coalesce(*[F.when(cond, value) for cond, value in branches])
