"""Session helpers: configuration for local runs and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "opsweave") -> SparkSession:
    """A session for tests and the bench. On a cluster, pass your own session in."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine: on a cluster
    the checkpoint must survive the loss of an executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="opsweave-ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


ROWS_PER_PARTITION = 500_000


@contextmanager
def fixed_partitions(spark: SparkSession, rows: int) -> Iterator[None]:
    """Plan without adaptive re-planning, for loops that reuse one partitioning.

    Adaptive execution would merge the small exchanges of each round and so break
    the co-location of the two sides; such loops split hot keys themselves. Small
    inputs use fewer partitions than configured, never more.
    """
    wanted = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.codegen.useIdInClassName": "false",  # rounds share their compiled code
        "spark.sql.shuffle.partitions": str(
            max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_PARTITION)))
        ),
    }
    with _settings(spark, wanted):
        yield


@contextmanager
def enough_partitions(spark: SparkSession, rows: int, per_partition: int = 4 * ROWS_PER_PARTITION) -> Iterator[None]:
    """Shuffle into at least so many partitions that none holds more than about ``per_partition`` of ``rows`` rows.

    For joins whose result is far larger than what they read: adaptive planning sees only the bytes read and would
    merge partitions. It still splits hot keys. What is planned here must be written or checkpointed inside.
    """
    wanted = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))),
    }
    with _settings(spark, wanted):
        yield


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of each action when it ends; for steps whose results are written or checkpointed."""
    with _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        yield


@contextmanager
def shared_code(spark: SparkSession) -> Iterator[None]:
    """Plans of equal shape share their compiled code, on the driver and in executors; for loops and repeated steps."""
    with _settings(spark, {"spark.sql.codegen.useIdInClassName": "false"}):
        yield


@contextmanager
def shared_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A new folder beside the checkpoints, removed at the end; what is made of it must be checkpointed inside."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    yield path
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
