"""Mixing sources to target weights by weighted fair queueing.

Every source gets a share of the budget by weight, but never more than ``max_repeats`` times its own
size; what a full source cannot take is shared again by weight among the others. Documents of a
source queue in a shuffled order that depends on their ids alone, and the queue runs through the
source up to ``max_repeats`` times. A copy's virtual finish time is the number of words its source has
served when the copy ends, divided by the source's target. All sources start at virtual time 0 and
meet their targets at time 1, where the budget is spent: copies that end later are cut to the words
served by then. The copies are put in one global order of finish time, added up, and truncated at the
budget.

A null text has size 0 and is never taken; a null source is a source of its own, last in order. Rows
that repeat a document id are served one by one. Equal finish times are ordered by source, pass and
shuffled position. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsweave.llm.common import fresh
from opsweave.session import cut_lineage, freed_shuffles, shared_code

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Ranges of an order are cut into this many, and those again, so that no window holds many rows.
SLOTS = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def shuffled(doc_id: Column) -> Column:
    """A place in [0, 1) that depends on the id alone: 52 bits of its MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10)
    return bits.cast("long") / F.lit(float(1 << 52))


def running_sum(df: DataFrame, value: str, out: str, within: Sequence[str], unit: str, ties: Sequence[str]) -> DataFrame:
    """``out`` = sum of ``value`` up to and with the row, in the order of ``unit`` (0 to 1), then ``ties``.

    The order is cut into slots and sub-slots; sums of those give each sub-slot's offset, and only a
    sub-slot's rows are ordered in one window, so that a very large group is spread over many tasks.
    """
    fine = F.least(F.floor(F.col(unit) * (SLOTS * SLOTS)), F.lit(SLOTS * SLOTS - 1)).cast("long")
    cut = df.withColumn("_fine", fine).withColumn("_slot", F.floor(F.col("_fine") / SLOTS).cast("long"))
    sub = cut.groupBy(*within, "_slot", "_fine").agg(F.sum(value).alias("_n"))
    top = sub.groupBy(*within, "_slot").agg(F.sum("_n").alias("_m"))

    def before(total: str, keys: Sequence[str], by: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(total).over(w), F.lit(0).cast("long"))

    top = top.select(*within, "_slot", before("_m", within, "_slot").alias("_top"))
    sub = sub.select(*within, "_slot", "_fine", before("_n", [*within, "_slot"], "_fine").alias("_sub"))
    offsets = sub.join(top, [*within, "_slot"]).select(
        *within, "_fine", (F.col("_top") + F.col("_sub")).alias("_offset")
    )
    own = Window.partitionBy(*within, "_fine").orderBy(unit, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(offsets, [*within, "_fine"])
        .withColumn(out, F.sum(value).over(own) + F.col("_offset"))
        .drop("_fine", "_slot", "_offset")
    )


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, source_rank, source_size, target)`` from rows ``(source, size)``.

    Sources are ranked by code point, null last, and take the weights in turn. With the sources in the
    order of the share at which they fill up, the first k are full and the rest share what is left by
    weight; k is the only one for which that holds. One row per source is ordered, not the documents.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    by = by.withColumn("source_rank", rank.cast("long")).withColumn("weight", weight)
    by = by.withColumn("most", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("most") / F.col("weight"), "source_rank")
    earlier, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    full_before = F.coalesce(F.sum("most").over(earlier), F.lit(0).cast("long"))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    level = (F.sum("source_size").over(everything) - full_before) / weight_left
    by = by.withColumn("level", level)
    # the first source that would not fill at its level sets the level of all after it
    own = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    by = by.withColumn("level", F.first(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return by.select("source", "source_rank", "source_size", target.cast("double").alias("target"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """One row ``(id_col, source, size, dup, source_size, target, taken, copies, starts_at)`` per row.

    ``taken`` counts words with repeats, ``copies`` the begun copies, ``starts_at`` the words of the
    mix before the first of them; ``dup`` numbers the rows of one id by (source, size). Each step is
    written before the next, which keeps plans short: the driver holds all of a plan, step by step anew.
    """
    with freed_shuffles(docs.sparkSession), shared_code(docs.sparkSession):
        return _mix(docs, id_col, text_col, source_col, weights, max_repeats)


def _mix(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], max_repeats: int
) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = rows.withColumn("dup", F.row_number().over(Window.partitionBy("_id").orderBy("source", "size")))
    rows = cut_lineage(rows.withColumn("place", shuffled(F.col("_id"))))  # narrow: the texts are read once
    goal = cut_lineage(targets(rows, weights, max_repeats))
    rows = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    rows = cut_lineage(running_sum(cut_lineage(rows), "size", "_end", ["source_rank"], "place", ["_id", "dup"]))

    # every pass in which the copy begins before virtual time 1; a copy that ends later is cut
    begin = F.col("pass") * F.col("source_size") + F.col("_end") - F.col("size")
    copies = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    served = F.least(F.col("size"), F.floor(F.col("target")) - begin)
    copies = copies.withColumn("served", F.greatest(served, F.lit(0)).cast("long")).where("served > 0")
    finish = F.least((begin + F.col("served")) / F.col("target"), F.lit(1.0))
    copies = copies.select("_id", "source_rank", "dup", "pass", "place", "served", finish.alias("finish"))
    copies = running_sum(cut_lineage(copies), "served", "until", [], "finish", ["source_rank", "pass", "place", "_id", "dup"])
    budget = goal.agg(F.sum("source_size").alias("budget"))
    copies = copies.crossJoin(F.broadcast(budget))  # one row
    words = F.greatest(F.least(F.col("served"), F.col("budget") - F.col("until") + F.col("served")), F.lit(0))
    taken = copies.withColumn("words", words.cast("long")).groupBy("_id", "dup").agg(
        F.sum("words").alias("taken"), F.count("*").alias("copies"), F.min(F.col("until") - F.col("served")).alias("starts_at")
    )
    t = cut_lineage(taken.select(F.col("_id").alias("_t"), F.col("dup").alias("_d"), "taken", "copies", "starts_at"))
    both = rows.join(t, rows["_id"].eqNullSafe(t["_t"]) & (rows["dup"] == t["_d"]), "left")
    zero = F.lit(0).cast("long")
    return both.select(
        F.col("_id").alias(id_col), "source", "size", "dup", "source_size", "target",
        F.coalesce("taken", zero).alias("taken"), F.coalesce("copies", zero).alias("copies"), "starts_at",
    )


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix with all their columns and ``taken``, ``copies`` and ``starts_at``
    (any columns of those names are replaced). One row per taken row; copies are a count."""
    docs = docs.drop("taken", "copies", "starts_at")
    key, dup, size = (fresh(docs, c) for c in ("_id", "_dup", "_size"))
    got = mix(docs, id_col, text_col, source_col).where("taken > 0")
    got = got.select(F.col(id_col).alias(key), F.col("dup").alias(dup), "taken", "copies", "starts_at")
    nr = F.row_number().over(Window.partitionBy(id_col).orderBy(source_col, size))
    own = docs.withColumn(size, word_count(F.col(text_col))).withColumn("starts_at", nr)
    both = own.join(got, own[id_col].eqNullSafe(got[key]) & (own["starts_at"] == got[dup]))
    return both.select(*[own[c] for c in docs.columns], "taken", "copies", got["starts_at"])


def digest(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return mixed.select(id_col, "size", "source_size", "target", "taken", "copies", "starts_at")


SQL = r"""
with d as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double as place
  from documents),
r as (select *, row_number() over (partition by doc_id order by source, size) as dup from d),
s0 as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rk
       from r group by source),
s1 as (select *, [5.0, 2.0, 1.0][(rk % 3 + 1)::int]::double as weight, source_size * 3 as most from s0),
s2 as (select *, (sum(source_size) over () - coalesce(sum(most) over (order by most / weight, rk
                  rows between unbounded preceding and 1 preceding), 0))::double
                 / (sum(weight) over () - coalesce(sum(weight) over (order by most / weight, rk
                  rows between unbounded preceding and 1 preceding), 0)) as lev from s1),
s3 as (select *, first_value(case when lev * weight <= most then lev end ignore nulls)
                 over (order by most / weight, rk rows between unbounded preceding and current row) as l from s2),
s as (select *, case when l is null then most else least(most, l * weight) end::double as target from s3),
q as (select r.*, s.rk, s.source_size, s.target,
             sum(size) over (partition by rk order by place, doc_id, dup rows unbounded preceding)::bigint as fin
      from r join s on r.source is not distinct from s.source),
c as (select q.*, p, greatest(least(size, floor(target)::bigint - (p * source_size + fin - size)), 0)::bigint as served
      from q, (values (0), (1), (2)) v(p)),
o as (select *, sum(served) over (order by least((p * source_size + fin - size + served) / target, 1.0), rk, p, place,
                                  doc_id, dup rows unbounded preceding)::bigint - served as begun
      from c where served > 0),
t as (select doc_id, dup, sum(served)::bigint as taken, count(*) as copies, min(begun) as starts_at
      from o group by doc_id, dup)
select q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0) as taken, coalesce(t.copies, 0) as copies,
       t.starts_at
from q left join t on q.doc_id is not distinct from t.doc_id and q.dup = t.dup
"""
