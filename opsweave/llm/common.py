"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from opsweave.session import ensure_checkpoint_dir

ROWS_PER_BATCH = 1000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_rows(df: DataFrame, fn: Callable[[tuple], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn`` gets one row of ``df`` as plain Python values and yields output rows.

    Batches are Arrow record batches of at most ``ROWS_PER_BATCH`` rows, so that very long texts
    never meet in one batch by the ten thousands; output is sent on batch by batch.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    out = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for row in zip(*(c.to_pylist() for c in batch.columns)) for r in fn(row)]
            for at in range(0, len(rows), 50_000):
                cols = list(zip(*rows[at : at + 50_000]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) for c, f in zip(cols, out)], schema=out
                )

    return df.mapInArrow(run, schema)


def map_columns(df: DataFrame, fn: Callable[[list[pa.Array]], Iterator[list]], schema: str) -> DataFrame:
    """``fn`` gets the Arrow columns of a batch of at most ``ROWS_PER_BATCH`` rows and yields lists of output columns."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    out = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cols in fn(batch.columns):
                made = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, out)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, out)], schema=out)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[list], np.ndarray]) -> DataFrame:
    """The rows whose texts ``keep`` marks, batch by batch, with all columns as they are."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


@contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, which is removed at the end: for rows that are read more
    than once, but no longer than the block lasts. What is made of it must be checkpointed inside."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    yield spark.read.parquet(path)
    remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own in the shared folder, by the file system that holds it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space; bytes.lower() leaves other letters alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer on unsigned integers (wraps around)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x

