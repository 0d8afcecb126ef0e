"""Registered queries of the training-data operators: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsweave.llm import (
    decontaminate, extract, licenses, merkle, mixing, ngram_join, periodic, secrets, suffix_dedup, token_files, topk, toxicity, urls,
)
from opsweave.llm.common import load


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(load(spark, sf_dir, "documents")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(load(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(load(spark, sf_dir, "documents")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a passage of 50 words or more with another, with the spans."""
    return suffix_dedup.digest(suffix_dedup.find(load(spark, sf_dir, "documents")))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(load(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the chain finds toxic, with their probabilities."""
    docs = load(spark, sf_dir, "documents")
    return toxicity.rejected(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the place."""
    return decontaminate.find(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(load(spark, sf_dir, "pages"), urls.outcomes_of(load(spark, sf_dir, "labels")))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(load(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(load(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.digest(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_secret_scan, op2_ngram_join, op3_license_scan, op4_suffix_dedup, op5_source_mix, op6_toxicity, op7_top_k, op8_decontaminate, op9_url_filter,
        op10_html_extract, op11_periodic_runs, op12_token_files, op13_merkle_manifest,
    )
}
SQL: dict[str, str] = {
    "op2_ngram_join": ngram_join.SQL, "op5_source_mix": mixing.SQL, "op7_top_k": topk.SQL, "op9_url_filter": urls.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
