"""Secret scan by assignment-aware lexing.

A text is read as source or configuration syntax: ``name = "literal"``, ``name: literal``,
``"name": "literal"``, ``export NAME=literal``, ``name := literal``, ``name = a + "b"``. Each pair of
a name and a literal is kept; a right side that names an earlier constant takes over that
constant's literals. A literal counts as secret when a sensitive target name meets a literal that
looks like a key. Beside that, three plain token patterns (kinds ``assign``, ``access``, ``hex``)
are always reported.

Rows: one output row per input row, in any order. A null or empty text has no spans. Repeated rows
are reported once each. Texts are read whole, whatever their length.
An empty table gives no rows. Columns other than id and text are not read, so any may clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsweave.llm.common import ROWS_PER_BATCH, map_rows

KINDS = ("assign", "access", "hex", "pair", "flow")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as the shorter ones are dropped

#: Weight of a word inside a name: how much it makes the name a sensitive target.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.5, "key": 0.5,
    "private": 0.5, "access": 0.4, "signing": 0.5, "encryption": 0.5, "client": 0.2, "api": 0.4,
    "connection": 0.3, "dsn": 0.7, "salt": 0.5, "cert": 0.3, "pass": 0.7,
}
#: Words of a literal that marks a place to be filled in.
PLACEHOLDERS = ("example", "changeme", "placeholder", "your_", "yourkey", "xxxx", "****", "dummy", "todo")
NEEDED = 1.0  # name weight plus literal weight, at most 1 each
SHORTEST = 8

_LEFT = re.compile(
    r"""(?<![\w.-])["']?([A-Za-z_][\w.-]*+)["']?[\x20\t]*+(?::=|=>|[=:](?![=:/]))[\x20\t]*+""", re.ASCII
)
_PIECE = re.compile(
    r"""(?:(?P<q>["'`])(?P<lit>(?:\\.|(?!(?P=q))[^\\\n])*+)(?P=q)|(?P<name>[A-Za-z_][\w.]*+(?![\w(\[+/=-]))|(?P<bare>[A-Za-z0-9+/_.=!@#$%^&*-]++))"""
    r"""(?P<plus>[\x20\t]*+(?:\+|\.\.)[\x20\t]*+)?""",
    re.ASCII,
)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_weight(name: str) -> float:
    """How sensitive a target name is, from its camel or snake parts: 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name.rsplit(".", 1)[-1])]
    joined = {"".join(parts[i : i + 2]) for i in range(len(parts))} | set(parts)
    return min(1.0, sum(NAME_WEIGHTS.get(p, 0.0) for p in joined))


def literal_weight(value: str) -> float:
    """How much a literal looks like a key: variety of characters and entropy, 0 to 1."""
    if len(value) < SHORTEST or any(p in value.lower() for p in PLACEHOLDERS):
        return 0.0
    if any(c.isspace() for c in value):
        return 0.1
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit))
    return min(1.0, 0.15 * classes + 0.16 * entropy)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the three plain patterns, leftmost and non-overlapping within each kind."""
    found = []
    if any(w in text.lower() for w in _ASSIGN_WORDS):
        found += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [(*m.span(), "hex") for m in _HEX.finditer(text)]


class Value:
    """The right side of an assignment: its own literals' spans, and the constants' values that it took over.

    Values are shared by reference, so that a text of n assignments holds n of them, however often
    one flows into the next."""

    __slots__ = ("own", "taken", "tested")

    def __init__(self, own: list[tuple[int, int]], taken: list[Value]):
        self.own, self.taken = own, list(dict.fromkeys(taken))
        self.tested = 0.0  # the largest name weight that its literals have met


def pairs(text: str) -> Iterator[tuple[str, Value]]:
    """Name and value of every assignment, in text order. A later assignment of a name replaces the
    earlier one."""
    constants: dict[str, Value] = {}
    for left in _LEFT.finditer(text):
        at, own, taken = left.end(), [], []
        while m := _PIECE.match(text, at):
            if m["name"] is not None and m["name"] in constants:
                taken.append(constants[m["name"]])
            elif m["lit"] is not None:
                own.append(m.span("lit"))
            elif (part := "name" if m["name"] is not None else "bare") and m[part]:
                own.append(m.span(part))
            if not m["plus"]:
                break
            at = m.end()
        if own or taken:
            constants[left[1]] = value = Value(own, taken)
            yield left[1], value


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """All spans ``(start, end, kind)`` in code points, by start, then kind as in ``KINDS``.

    ``pair`` and ``flow`` spans cover a literal; those that lie within a plain span are not repeated.
    """
    if not text:
        return []
    found = base_spans(text)
    if "=" in text or ":" in text:
        covered = [(a, b) for a, b, _ in found]
        more: dict[tuple[int, int], str] = {}
        for name, value in pairs(text):
            weight = name_weight(name)
            if weight < 0.5:
                continue
            todo = [value]
            while todo:
                v = todo.pop()
                if v.tested >= weight:  # a lower weight adds nothing
                    continue
                v.tested = weight
                for a, b in v.own:
                    if (
                        (a, b) not in more
                        and weight + literal_weight(text[a:b]) >= NEEDED + 0.5
                        and not any(x <= a and b <= y for x, y in covered)
                    ):
                        more[a, b] = "pair" if v is value else "flow"
                todo += v.taken
        found += [(a, b, kind) for (a, b), kind in more.items()]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(id_col, spans)`` per row; spans: array of (start, end, kind, literal)."""

    def spans_of(row):
        text = row[1] or ""
        yield row[0], [(a, b, kind, text[a:b]) for a, b, kind in find_secrets(text)]

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return map_rows(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")),
        spans_of,
        f"id {kind}, spans array<struct<start:bigint,end:bigint,kind:string,literal:string>>",
    ).withColumnRenamed("id", id_col)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every secret span replaced; overlapping spans become one mark."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if kind == "assign":  # the name stays, its value goes
            a = _ASSIGN.match(text, a).start(2)
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_all(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows with their secrets replaced; ``chars_col``, if there, counts the new text's code points
    in the rows that changed. Every other column stays as it is."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    at, schema = docs.columns.index(text_col), docs.schema
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old, cols = batch.column(at).to_pylist(), list(batch.columns)
            new = [redact(t) for t in old]
            cols[at] = pa.array(new, cols[at].type)
            if chars is not None:
                kept = zip(old, new, cols[chars].to_pylist())
                cols[chars] = pa.array([n if a == b else len(b) for a, b, n in kept], cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the plain spans and all spans as text."""
    plain = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        id_col, count("assign"), count("access"), count("hex"),
        F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        count("pair"), count("flow"),
    )
