"""Merkle manifest of a table: a tree of digests per group, and one over the groups' subroots.

1. *Leaves.* A row's leaf is the SHA-256 of its columns, each ``-`` if null, else byte count, ``:`` and value. Leaves
   of a group are numbered by id (null first), then leaf. The numbers come from a range sort of narrow rows and
   the counts of its ranges, so that a group with most of the rows is spread over all tasks; equal rows are cut by their place in the input.
2. *Levels.* The ``fan_out`` consecutive nodes of a run are siblings. The slot-zero row of each run computes its
   siblings' indices (XOR for a binary tree, slot offsets otherwise) and the level is joined to itself on them: an
   equijoin of unique keys. The slot-zero rows then emit the parents, the digest of all the run's hex digests;
   also where a run has one node only. A group of one node keeps it as its subroot.
3. *Subroots* are numbered by group (null first, by UTF-8 bytes) and form a tree of the same shape, whose top is
   the root.
4. *Proofs* go down again: a run's siblings of each slot are put before the proof of its parent. A row's
   proof is an array with, per level, the digests left and right of its own. A group's own tree and then the tree of subroots are in it, leaf first.

``folded`` computes the root that a leaf and a proof lead to, which is how a manifest is checked: a changed row
no longer leads to the root. Digests travel as 32 bytes and are hashed as lowercase hex text.

Nulls may stand in every column; empty and null text differ (``0:`` and ``-``). Rows with equal ids are ordered by
their leaves, and equal rows get a leaf each. Columns not named are not read, so theirs may clash. A text is
hashed whole, however long. An empty table has no rows. Every level is checkpointed, and so written in the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsweave.session import cut_lineage

FAN_OUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROWS_PER_PARTITION = 500_000
LEVELS_A_PLAN = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "struct<left:binary,right:binary>"


def leaf(fields: Sequence[Column]) -> Column:
    """32 bytes: the digest of the fields' texts with their lengths."""
    each = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.unhex(F.sha2(F.concat(*each), 256))


def hexed(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _digest_of(digests: Column) -> Column:
    return F.unhex(F.sha2(hexed(digests), 256))


def numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Checkpointed ``rows`` with ``part``, their range, and ``at``, their place in the order from 0.

    A range sort, and a running sum over one count per range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, F.col("_row")]
    kept = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    kept = cut_lineage(kept.drop("_row").withColumn("_place", F.monotonically_increasing_id()))  # range << 33 | row
    kept = kept.withColumn("part", F.shiftright("_place", 33))
    counts = kept.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("_before"))
    out = kept.join(F.broadcast(counts), "part")  # one row a range
    return out.withColumn("at", F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_before", "_place")


def _joined(digests: Column) -> Column:
    return F.aggregate(digests, F.lit(b"").cast("binary"), lambda a, h: F.concat(a, h))


def levels(nodes: DataFrame, sizes: DataFrame, fan_out: int) -> tuple[list[DataFrame], DataFrame]:
    """From nodes ``(g, i, h, m)`` (group, index from 0, digest, nodes of the group): the runs ``(g, p, hs, m)``
    of every level, and the tops ``(g, h)``. A group of one node is handed up as it is until all have one.
    sizes: ``m`` of each group."""
    runs: list[DataFrame] = []
    most = sizes.agg(F.max("m")).collect()[0][0] or 0
    height = 0
    while fan_out**height < most:
        height += 1
    left = [F.sum(F.ceil(F.col("m") / fan_out**k)).cast("long") for k in range(height + 1)]
    totals = sizes.agg(*left).collect()[0]
    for level in range(height):
        # the slot-zero node asks for the run by computed index, and what it gets makes the parent
        head = nodes.where(F.col("i") % fan_out == 0).select("g", F.col("i").alias("first"), "m")
        slots = F.sequence(F.lit(0).cast("long"), F.least(F.lit(fan_out).cast("long"), F.col("m") - F.col("first")) - 1)
        asked = head.withColumn("slot", F.explode(slots))
        index = F.col("first").bitwiseXOR(F.col("slot")) if fan_out == 2 else F.col("first") + F.col("slot")
        sibling = asked.withColumn("i", index).join(nodes.select("g", "i", "h"), ["g", "i"])
        run = sibling.groupBy("g", "first").agg(F.array_sort(F.collect_list(F.struct("slot", "h"))).alias("hs"), F.max("m").alias("m"))
        run = run.select("g", F.floor(F.col("first") / fan_out).cast("long").alias("p"), F.col("hs.h").alias("hs"), "m")
        runs.append(cut_lineage(run.coalesce(max(1, -(-totals[level + 1] // ROWS_PER_PARTITION)))))  # narrow rows, ever fewer
        parent = F.when(F.col("m") == 1, F.element_at("hs", 1)).otherwise(_digest_of(_joined(F.col("hs"))))
        nodes = runs[-1].select("g", F.col("p").alias("i"), parent.alias("h"), F.ceil(F.col("m") / fan_out).cast("long").alias("m"))
    return runs, nodes.select("g", "h")


def _step(slot: Column) -> Column:
    """The digests left and right of a slot in the run ``hs``; nothing if the group is one node."""
    left, right = F.slice("hs", F.lit(1), slot), F.slice("hs", slot + 2, F.size("hs"))
    step = F.struct(_joined(left).alias("left"), _joined(right).alias("right"))
    return F.when(F.col("m") > 1, F.array(step)).otherwise(F.array().cast(f"array<{_STEP}>"))


def with_proofs(nodes: DataFrame, runs: list[DataFrame], tops: DataFrame, fan_out: int) -> DataFrame:
    """``nodes`` (with ``g, i``) with the columns of ``tops``: ``g``, ``proof`` and any others; the proofs go on
    from the nodes' own level."""
    up = tops.withColumn("i", F.lit(0).cast("long"))
    if not runs:
        return nodes.join(up.drop("i"), "g")
    slot = F.col("slot")
    for k in reversed(range(1, len(runs))):
        run = runs[k]
        own = run.join(up.withColumnRenamed("i", "p"), ["g", "p"]).withColumn("slot", F.explode(F.sequence(F.lit(0), F.size("hs") - 1)))
        own = own.withColumns({"i": F.col("p") * fan_out + slot, "proof": F.concat(_step(slot), "proof")})
        up = own.select(*up.columns)
        if k % LEVELS_A_PLAN == 0:
            up = cut_lineage(up)  # else one plan holds the joins of all levels
    lowest = runs[0].join(up.withColumnRenamed("i", "p"), ["g", "p"]).withColumnsRenamed({"g": "_g", "p": "_p", "m": "_m"})
    run_of = F.floor(F.col("i") / fan_out).cast("long")
    own = nodes.join(lowest, (nodes["g"] == lowest["_g"]) & (run_of == lowest["_p"])).drop("_g", "_p", "_m")
    return own.withColumn("proof", F.concat(_step(F.pmod("i", F.lit(fan_out)).cast("int")), "proof")).drop("hs")


def manifest(
    rows: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS,
    fan_out: int = FAN_OUT, extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row ``(id, group, leaf, subroot, root, proof)`` per row, and the columns ``extra`` over the rows' own.

    Digests are 32 bytes; ``proof`` is an array of ``(left, right)``, the digests beside the row's own on every
    level from its leaf up.
    """
    if fan_out < 2:
        raise ValueError("at least two nodes in a run")
    extra = extra or {}
    narrow = rows.select(
        F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf([F.col(c) for c in fields]).alias("leaf"),
        *[c.alias(f"x_{name}") for name, c in extra.items()],
    )
    placed = numbered(cut_lineage(narrow), [F.col("group"), F.col("id"), F.col("leaf")])  # texts are hashed once
    pieces = placed.groupBy("part", "group").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups = pieces.groupBy("group").agg(F.min("first").alias("first"), F.sum("n").alias("m"))
    groups = numbered(groups, [F.col("group")]).select(F.col("group").alias("_group"), "first", "m", F.col("at").alias("g"))
    # a row meets its group by range and group, so a large group is no hot key
    of = pieces.select("part", "group").join(groups, F.col("group").eqNullSafe(F.col("_group"))).drop("group")
    of = of.withColumnRenamed("part", "_part")
    both = placed.join(of, (placed["part"] == of["_part"]) & placed["group"].eqNullSafe(of["_group"]))
    kept = [f"x_{name}" for name in extra]
    nodes = cut_lineage(both.select("id", "group", "leaf", *kept, "g", (F.col("at") - F.col("first")).alias("i"), "m"))
    runs, tops = levels(nodes.select("g", "i", F.col("leaf").alias("h"), "m"), groups, fan_out)

    count = groups.count()
    subroots = tops.select(F.lit(0).alias("g"), F.col("g").alias("i"), "h", F.lit(count).cast("long").alias("m"))
    above, root = levels(subroots, subroots.limit(1), fan_out)
    none = F.array().cast(f"array<{_STEP}>")
    roots = root.select("g", F.col("h").alias("root"), none.alias("proof"))
    proven = with_proofs(subroots.select("g", "i", F.col("h").alias("subroot"), "m"), above, roots, fan_out)
    proven = cut_lineage(proven.select(F.col("i").alias("g"), "subroot", "root", "proof"))  # one row a group
    out = with_proofs(nodes, runs, proven, fan_out)
    return out.select(
        "id", "group", "leaf", "subroot", "root", "proof", *[F.col(f"x_{name}").alias(name) for name in extra]
    )


def folded(own: Column, proof: Column) -> Column:
    """The root that a leaf leads to beside the digests of a proof."""
    return F.aggregate(proof, own, lambda h, s: _digest_of(F.concat(s["left"], h, s["right"])))


def proof_digest(proof: Column) -> Column:
    """The proof's digests as hex text, level by level and left to right, hashed."""
    every = F.aggregate(proof, F.lit(b"").cast("binary"), lambda a, s: F.concat(a, s["left"], s["right"]))
    return F.sha2(hexed(every), 256)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The manifest checked against rows whose A-Z are lower-cased where 3 divides the CRC-32 of the decimal id."""
    changed = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 0
    lowered = [F.translate(c, _UPPER, _LOWER) if c == text_col else F.col(c) for c in FIELDS]
    found = manifest(docs, id_col, extra={"tampered": F.when(changed, leaf(lowered))})
    found = found.withColumn("folded", folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return found.select(
        F.col("id").alias(id_col), hexed(F.col("leaf")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"),
        hexed(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


SQL = r"""
with recursive
c as (select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
        case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (select row_number() over () as r, doc_id, lang, text,
        coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as fields,
        xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as crc from documents, c),
l as (select r, doc_id, lang, sha256(fields || coalesce(strlen(text) || ':' || text, '-')) as leaf,
        case when crc % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as now,
        fields from d),
leaves as (select r, doc_id, lang, leaf, sha256(fields || coalesce(strlen(now) || ':' || now, '-')) as changed,
        row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i,
        count(*) over (partition by lang) as m from l),
tree(level, lang, i, h, m) as (select 0, lang, i, leaf, m from leaves
  union all select level + 1, lang, i // 8, sha256(string_agg(h, '' order by i)), (max(m) + 7) // 8
            from tree where m > 1 group by level, lang, i // 8),
sub as (select lang, h, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as m from tree where m = 1),
top(level, i, h, m) as (select 0, i, h, m from sub
  union all select level + 1, i // 8, sha256(string_agg(h, '' order by i)), (max(m) + 7) // 8
            from top where m > 1 group by level, i // 8),
steps as (
  select r, 0 as of_top, t.level, coalesce(string_agg(t.h, '' order by t.i) filter (t.i < x.i // (8 ** t.level)::bigint), '') as lft,
         coalesce(string_agg(t.h, '' order by t.i) filter (t.i > x.i // (8 ** t.level)::bigint), '') as rgt
  from leaves x join tree t on t.lang is not distinct from x.lang and t.m > 1 and t.i // 8 = x.i // (8 ** (t.level + 1))::bigint
  group by all
  union all
  select r, 1, t.level, coalesce(string_agg(t.h, '' order by t.i) filter (t.i < s.i // (8 ** t.level)::bigint), ''),
         coalesce(string_agg(t.h, '' order by t.i) filter (t.i > s.i // (8 ** t.level)::bigint), '')
  from leaves x join sub s on s.lang is not distinct from x.lang
       join top t on t.m > 1 and t.i // 8 = s.i // (8 ** (t.level + 1))::bigint
  group by r, t.level),
path as (select *, row_number() over (partition by r order by of_top, level) as k from steps),
fold(r, k, h) as (select r, 0::bigint, changed from leaves
  union all select f.r, f.k + 1, sha256(lft || f.h || rgt) from fold f join path p on p.r = f.r and p.k = f.k + 1),
ends as (select r, arg_max(h, k) as folded_root from fold group by r),
proof as (select r, sha256(string_agg(lft || rgt, '' order by k)) as proof_sha256 from path group by r)
select x.doc_id, x.leaf, s.h as subroot, t.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, e.folded_root,
       e.folded_root = t.h as verified
from leaves x join sub s on s.lang is not distinct from x.lang join top t on t.m = 1 join ends e using (r) left join proof p using (r)
"""
