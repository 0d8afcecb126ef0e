"""Ordered (time-series) building blocks that survive hot keys.

A plain ``Window.partitionBy(key).orderBy(ts)`` sorts all rows of one key in one
task. Here each key's history is cut into time chunks; the window runs inside a
chunk and only one summary row per (key, chunk) crosses chunk borders. The
number of summary rows of a key is bounded by the time span, not by its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsweave.session import cut_lineage

HOUR = 3600


def _chunk(ts: str, seconds: int) -> Column:
    return F.floor(F.col(ts) / F.lit(seconds)).cast("long")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[f"_r_{k}"])
    return cond


def _attach(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe left join that keeps only the left copy of the keys."""
    right = small.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in small.columns if c not in keys],
    )
    return df.join(right, _same(df, right, keys), "left").drop(*[f"_r_{k}" for k in keys])


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    tie: Sequence[str] = (),
    chunk_seconds: int = HOUR,
) -> DataFrame:
    """Add ``prev_<col>``: the value on the previous row of the key by (ts, tie).

    ``ts`` is a numeric column in epoch seconds.
    """
    keys = list(keys)
    order = [ts, *tie]
    src = df.withColumn("_chunk", _chunk(ts, chunk_seconds))
    packed = F.struct(*[F.col(c).alias(c) for c in cols])
    inside = src.withColumn(
        "_prev", F.lag(packed).over(Window.partitionBy(*keys, "_chunk").orderBy(*order))
    )
    tails = src.groupBy(*keys, "_chunk").agg(
        F.max_by(packed, F.struct(*[F.col(c) for c in order])).alias("_tail")
    )
    carry = tails.select(
        *keys,
        "_chunk",
        F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry"),
    )
    out = _attach(inside, carry, [*keys, "_chunk"])
    prev = F.coalesce("_prev", "_carry")
    return out.select(*df.columns, *[prev[c].alias(f"prev_{c}") for c in cols])


def with_running_sum(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: dict[str, Column],
    tie: Sequence[str] = (),
    chunk_seconds: int = HOUR,
) -> DataFrame:
    """Add each named sum over all rows of the key up to and including this one."""
    keys, names = list(keys), list(values)
    src = df.withColumn("_chunk", _chunk(ts, chunk_seconds)).withColumns(
        {f"_v_{n}": F.coalesce(v, F.lit(0)) for n, v in values.items()}
    )
    here = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(ts, *tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = src.select("*", *[F.sum(f"_v_{n}").over(here).alias(f"_run_{n}") for n in names])
    sums = src.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_v_{n}") for n in names])
    earlier = (
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = sums.select(
        *keys, "_chunk", *[F.sum(f"_v_{n}").over(earlier).alias(f"_before_{n}") for n in names]
    )
    out = _attach(inside, before, [*keys, "_chunk"])
    totals = [
        (F.col(f"_run_{n}") + F.coalesce(f"_before_{n}", F.lit(0))).alias(n) for n in names
    ]
    return out.select(*df.columns, *totals)


def over_recent(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    seconds: int,
    aggs: dict[str, Column],
    include_self: bool = True,
) -> DataFrame:
    """Aggregates over the rows of the key in ``[ts - seconds, ts]``.

    Rows are placed in their own time bucket (width = the window) and, as
    context only, in the next one, so no task holds more than two windows' worth
    of one key. With ``include_self=False`` the range is ``[ts - seconds, ts)``
    on the time axis (rows with the very same ``ts`` are left out).
    """
    keys = list(keys)
    own = _chunk(ts, seconds)
    src = df.withColumn("_own", own)
    placed = src.withColumn("_b", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    upper = 0 if include_self else -1
    scale = 1_000_000  # microseconds keep sub-second order in an integer range frame
    placed = placed.withColumn("_us", F.round(F.col(ts) * scale).cast("long"))
    w = Window.partitionBy(*keys, "_b").orderBy("_us").rangeBetween(-seconds * scale, upper)
    out = placed.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    return out.where(F.col("_b") == F.col("_own")).select(*df.columns, *aggs)


def _ranges(marks: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Number the range partitions of a total order as ``_p``. Spark samples the order and cuts a key with many
    rows into many ranges; the checkpoint freezes which range a row is in."""
    return cut_lineage(marks.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def _instants(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, agg: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with their instant ``_us``, and per (key, instant) two marks on the time axis: the instant itself
    (kind 1, with ``_v`` = the aggregate) and the start of its window (kind 0)."""
    rows = df.withColumn("_us", F.round(F.col(ts) * 1_000_000).cast("long"))
    held = rows.where("_us is not null").groupBy(*keys, "_us").agg(agg.alias("_v"))
    start = F.col("_us") - seconds * 1_000_000
    both = F.array(
        F.struct(F.col("_us").alias("_pos"), F.lit(1).alias("_kind"), "_v"),
        F.struct(start.alias("_pos"), F.lit(0).alias("_kind"), F.lit(None).cast(held.schema["_v"].dataType).alias("_v")),
    )
    return rows, held.select(*keys, "_us", F.inline(both))


def _back(df: DataFrame, rows: DataFrame, per_instant: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    return _attach(rows, per_instant, [*keys, "_us"]).select(*df.columns, name)


def count_recent(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, name: str) -> DataFrame:
    """Add the number of rows of the key in ``[ts - seconds, ts)``; null where ``ts`` is null.

    Rows are first counted per instant. A count is the difference of two running counts, and those come from
    ranges of (key, time) plus one total per range, so no task holds one key's window, however hot it is.
    """
    keys = list(keys)
    rows, marks = _instants(df, keys, ts, seconds, F.count("*"))
    order = [*[F.col(k) for k in keys], F.col("_pos"), F.col("_kind")]
    placed = _ranges(marks, order)
    n = F.coalesce("_v", F.lit(0))
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.groupBy("_p").agg(F.sum(n).alias("_sum"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_p", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    run = placed.withColumn("_before", F.sum(n).over(inside) - n).join(F.broadcast(offsets), "_p")  # one row per range
    at = F.col("_before") + F.col("_offset")
    span = F.max(F.when(F.col("_kind") == 1, at)) - F.max(F.when(F.col("_kind") == 0, at))
    return _back(df, rows, run.groupBy(*keys, "_us").agg(span.cast("long").alias(name)), keys, name)


def first_recent(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, col: str, tie: str, name: str) -> DataFrame:
    """Add ``col`` of the key's oldest row (ties: smallest ``tie``) in ``[ts - seconds, ts]``; null where ``ts`` is null.

    Read backwards in time, it is the last instant met before the start of the window; ranges as in ``count_recent``.
    """
    keys = list(keys)
    rows, marks = _instants(df, keys, ts, seconds, F.struct(F.min_by(col, tie).alias("v")))
    order = [*[F.col(k) for k in keys], F.col("_pos").desc(), F.col("_kind").desc()]
    placed = _ranges(marks, order)
    inside = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # reading order within a key: later times first
    tails = placed.withColumn("_rn", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    tails = tails.groupBy("_p").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_rn"))).alias("_tail"))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select("_p", F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    met = placed.withColumn("_met", F.last("_v", ignorenulls=True).over(inside)).join(F.broadcast(carry), "_p")  # one row per range
    starts = met.where("_kind = 0").select(*keys, "_us", F.coalesce("_met", "_carry")["v"].alias(name))
    return _back(df, rows, starts, keys, name)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows per key. Filtering right on the row number lets Spark trim
    every map task to ``k`` rows per key before the shuffle, so hot keys are cheap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def interval_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[tuple[str, str]],
    left_ts: str,
    right_ts: str,
    before: float,
    after: float,
    how: str = "inner",
) -> DataFrame:
    """Pairs with equal keys and ``right_ts`` in ``[left_ts - before, left_ts + after]``.

    The time axis is cut into buckets as wide as the interval, so the join is an
    equi join on (keys, bucket) with a residual range test; a hot key is spread
    over its buckets. Each right row is placed once; a left row visits the two or
    three buckets its interval touches.
    """
    width = float(before + after) or 1.0
    lo = F.floor((F.col(left_ts) - before) / width).cast("long")
    hi = F.floor((F.col(left_ts) + after) / width).cast("long")
    lt = left.withColumn("_bucket", F.explode(F.sequence(lo, hi)))
    rt = right.withColumn("_rbucket", F.floor(F.col(right_ts) / width).cast("long"))
    cond = lt["_bucket"] == rt["_rbucket"]
    for a, b in keys:
        cond = cond & (lt[a] == rt[b])
    cond = cond & (rt[right_ts] >= lt[left_ts] - before) & (rt[right_ts] <= lt[left_ts] + after)
    return lt.join(rt, cond, how).drop("_bucket", "_rbucket")


def with_last_known(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    tie: Sequence[str] = (),
    chunk_seconds: int = HOUR,
) -> DataFrame:
    """Add ``last_<col>``: the newest non-null value of each column up to and
    including this row. The base of as-of joins (union both sides, then this)."""
    keys = list(keys)
    order = [ts, *tie]
    src = df.withColumn("_chunk", _chunk(ts, chunk_seconds))
    w = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inside = src.select("*", *[F.last(c, ignorenulls=True).over(w).alias(f"_in_{c}") for c in cols])
    key = F.struct(*[F.col(c) for c in order])
    tails = src.groupBy(*keys, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), key)).alias(f"_t_{c}") for c in cols]
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy("_chunk")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = tails.select(
        *keys,
        "_chunk",
        *[F.last(f"_t_{c}", ignorenulls=True).over(before).alias(f"_c_{c}") for c in cols],
    )
    out = _attach(inside, carry, [*keys, "_chunk"])
    return out.select(
        *df.columns, *[F.coalesce(f"_in_{c}", f"_c_{c}").alias(f"last_{c}") for c in cols]
    )


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "row_index") -> DataFrame:
    """Number rows 0, 1, 2 … in the given total order without one task seeing them all.

    Rows are sorted by range partition; the checkpoint freezes which partition a
    row is in, and only one count per partition is summed up.
    """
    marked = df.orderBy(*order).select(
        "*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")
    )
    placed = cut_lineage(marked)
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    out = placed.join(F.broadcast(offsets), "_p")  # one row per partition
    return out.select(*df.columns, (F.col("_m") - F.col("_first") + F.col("_offset")).alias(name))
