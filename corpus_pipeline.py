"""Corpus pipeline over ``documents``: every stage is written as Parquet and read again.

1. ``toxicity``: documents that the classifier chain finds toxic go.
2. ``near_duplicates``: of each group of linked documents, the one with the smallest id stays. Links are
   those of the n-gram join at word shingles of five and a Jaccard of 0.8 or more.
3. ``decontaminate``: documents that hold a benchmark item go.
4. ``secrets``: every secret is replaced in the text; all documents stay.
5. ``mix``: the documents that the mix takes, with their number of words taken, copies and place.

Every stage keeps all columns; the last one adds ``taken``, ``copies`` and ``starts_at``. Null and empty
texts pass the first four stages and are never taken by the mix. An empty table stays empty. ``run`` removes a
stage's folder once the next one is written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opsweave.llm import decontaminate, mixing, ngram_join, secrets, toxicity
from opsweave.llm.common import load, remove
from opsweave.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, load(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_all(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]
#: A fitted classifier and a similarity join decide; tested against a brute-force version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after another, through the folder that the executors share."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
