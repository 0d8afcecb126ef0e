"""Sinks: upsert, append, incremental export, audit export."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsweave.functions.ordered import with_row_index
from opsweave.session import cut_lineage


def upserted(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_first: Sequence[str] = ()) -> DataFrame:
    """New values overwrite by key; columns in ``keep_first`` stay once they are set."""
    keys = list(keys)
    rest = [c for c in new.columns if c not in keys]
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, keys, "full_outer")
    return joined.select(
        *keys,
        *[
            F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
            if c in keep_first
            else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
            for c in rest
        ],
    )


PARTS = 64


def upsert_stream(
    spark: SparkSession, path: str, keys: Sequence[str], keep_first: Sequence[str] = (), parts: int = PARTS
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: merge a micro-batch into a table of ``parts`` hash partitions.

    Only the partitions that the batch touches are read and overwritten. Merging the same batch again
    changes nothing, so a replayed batch does no harm.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
        try:
            old = spark.read.parquet(path)
        except AnalysisException as e:  # a new table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most ``parts``
            old = old.where(F.col("part").isin(touched)).select(*new.columns)
            new = cut_lineage(upserted(old, new, [*keys, "part"], keep_first))  # before its files go
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    return merge


def append_audit(events: DataFrame, path: str, ts: str = "ts") -> None:
    """Append audit rows, one folder per day."""
    events.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").json(path)


def export_rows(log: DataFrame) -> DataFrame:
    """Audit rows as export payload rows."""
    blocked = F.col("action").isin("block", "suggest", "rewrite", "ask")
    return log.select(
        "event_id", "t",
        F.octet_length("detail").cast("string").alias("context_hash"),
        F.when(F.col("action") == "block", F.substring("detail", 1, 120)).otherwise("").alias("action"),
        "tool",
        F.when(blocked, "blocked").otherwise("allowed").alias("result"),
        F.when(F.col("reason") == "guard_rule", F.substring("detail", 1, 200)).alias("matched_rule"),
    )


def export_batches(log: DataFrame, offset: int, order: Sequence[str] = ("t", "event_id"), size: int = 200) -> DataFrame:
    """Rows past the offset in log order, numbered in batches of 200."""
    indexed = with_row_index(export_rows(log), order)
    rest = indexed.where(F.col("row_index") >= offset)
    return rest.withColumn("batch", F.floor((F.col("row_index") - offset) / size))


def next_offset(batches: DataFrame, offset: int, failed_batch: int | None) -> int:
    """The offset after sending: it only advances over the batches before a failure."""
    sent = batches if failed_batch is None else batches.where(F.col("batch") < failed_batch)
    return offset + sent.count()


PARCEL_ROWS = 50
RETRIES = 1_000_000  # sequence numbers between two micro-batches


def _outcomes(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/outcome")
    except AnalysisException as e:  # nothing sent so far
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def _latest(spark: SparkSession, path: str, below: int | None = None) -> tuple[int | None, DataFrame | None]:
    """Number and rows of the newest outcome (before ``below``)."""
    known = _outcomes(spark, path)
    if known is None:
        return None, None
    past = known if below is None else known.where(F.col("seq") < below)
    seq = past.agg(F.max("seq")).first()[0]
    return seq, None if seq is None else known.where(F.col("seq") == seq).drop("seq")


def _send_all(spark: SparkSession, parcels: DataFrame, send: Callable[[str, list[dict]], None], path: str, seq: int) -> None:
    names = [c for c in parcels.columns if c not in ("parcel", "attempts")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        error = None
        try:
            send(pdf["parcel"].iloc[0], pdf[names].to_dict("records"))
        except Exception as e:  # any failure of the receiver puts the parcel back
            error = f"{type(e).__name__}: {e}"
        return pdf.assign(attempts=pdf["attempts"] + 1, delivered=error is None, error=error)

    schema = T.StructType([*parcels.schema.fields, T.StructField("delivered", T.BooleanType()), T.StructField("error", T.StringType())])
    parcels.groupBy("parcel").applyInPandas(one, schema).write.mode("overwrite").parquet(f"{path}/outcome/seq={seq}")


def deliver(
    spark: SparkSession, path: str, send: Callable[[str, list[dict]], None], order: Sequence[str], size: int = PARCEL_ROWS
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: hand a stream to a receiver in parcels of at most ``size`` rows.

    ``send(parcel, rows)`` runs in the tasks and raises if it fails. The outcome of a micro-batch is one folder below
    ``path``: rows, parcel, attempts, delivered, error. Parcels that failed go out again, under the same name, with the next
    micro-batch or ``redeliver``; a micro-batch whose outcome stands is not sent again. Parcels are cut in the
    total order ``order``, so a micro-batch that is replayed before its outcome stood, or a task that is run twice, repeats
    the same names with the same rows and the receiver can tell. The trigger's interval is the longest wait.
    """

    def go(batch: DataFrame, batch_id: int) -> None:
        seq = batch_id * RETRIES
        known, _ = _latest(spark, path)
        if known is not None and known >= seq:
            return
        _, before = _latest(spark, path, seq)
        number = F.floor(F.col("_row") / size).cast("string")
        new = with_row_index(batch, order, "_row").select(
            *batch.columns, F.concat(F.lit(f"{batch_id}-"), number).alias("parcel"), F.lit(0).alias("attempts")
        )
        if before is not None:
            new = new.unionByName(before.where("not delivered").drop("delivered", "error"))
        _send_all(spark, new, send, path, seq)

    return go


def undelivered(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows that wait for another attempt; None before the first micro-batch."""
    _, last = _latest(spark, path)
    return None if last is None else last.where("not delivered")


def redeliver(spark: SparkSession, path: str, send: Callable[[str, list[dict]], None]) -> int:
    """Send what failed once more, between two micro-batches (not beside a running one); gives the rows still waiting."""
    seq, last = _latest(spark, path)
    if last is None:
        return 0
    _send_all(spark, last.where("not delivered").drop("delivered", "error"), send, path, seq + 1)
    return undelivered(spark, path).count()


def audit_export(log: DataFrame, path: str, kind: str = "csv") -> None:
    if kind == "csv":
        log.write.mode("overwrite").option("header", "true").csv(path)
    elif kind == "json":
        log.write.mode("overwrite").json(path)
    else:
        raise ValueError("kind is csv or json")


def audit_summary(log: DataFrame) -> DataFrame:
    """Counts per tool, action and reason."""
    return log.groupBy("tool", "action", "reason").agg(F.count("*").alias("n"))
