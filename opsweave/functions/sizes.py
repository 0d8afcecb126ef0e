"""Broadcast only what is proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 200_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when a bounded count shows at most ``max_rows`` rows.

    Beyond the bound the join shuffles.
    """
    seen = df.limit(max_rows + 1).count()
    return F.broadcast(df) if seen <= max_rows else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """Mark ``df`` for a sort-merge join.

    Spark takes the size of a compressed file for that of its rows, and so would send a table of a few MB,
    with columns made of it, through the driver as some hundred MB of rows.
    """
    return df.hint("merge")
