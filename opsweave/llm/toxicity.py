"""Toxicity by classifier chains.

Categories are predicted one after another. Each has a linear model on word and word-beginning
counts, and also gets the probabilities of the categories before it; while fitting, those are
out-of-fold predictions, so that a later model sees what it will see on new documents. The chain here:
``low_quality`` (quality 0), ``toxic`` (toxic 1), ``severe`` (both). The threshold of each category is
the one with the best F1 of its out-of-fold predictions.

Fitting uses at most ``FIT_ROWS`` labelled documents, in the order of the MD5 of their ids; scoring
covers every document and its whole text. Several label rows of one document count as one, the worse
label winning; a null label is no label. A category with fewer than ``FEWEST`` rows of either kind
stays at its share of the rows and marks nothing, so without labels no document is toxic. A null or
empty text has no words and is scored by the intercept alone, but never marked. One output row per
input row; extra columns play no part.
An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsweave.llm.common import keep_rows, map_rows
from opsweave.session import cut_lineage

FIT_ROWS = 10_000
FEWEST = 5
FOLDS = 5
FEATURES = 150  # per category, by chi-square on the fitted rows
BEGINNINGS = (5, 6, 7)
CHAIN = ("low_quality", "toxic", "severe")
_WORD = re.compile(r"[^\W\d_]+")
_CACHED = 400_000


def features(text: str | None) -> tuple[Counter, int]:
    """Counts of the words and of the beginnings of longer words; number of words."""
    words = Counter(_WORD.findall(text.lower())) if text else Counter()
    out = Counter(words)
    for w, n in words.items():
        for k in BEGINNINGS:
            if len(w) > k:
                out[w[:k] + "~"] += n
    return out, sum(words.values())


def _value(count: int, n_words: int) -> float:
    return math.log1p(1000 * count / (n_words + 200))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _sigmoid(x @ w)
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Of 0.05, 0.10 ... 0.95 the one with the best F1; of equals the one nearest to the middle."""
    f1 = {}
    for t in np.arange(1, 20) / 20:
        marked = p >= t
        f1[float(t)] = 2 * (marked & (y == 1)).sum() / max(1, marked.sum() + y.sum())
    return max(f1, key=lambda t: (round(f1[t], 9), -abs(t - 0.5)))


@dataclass
class Chain:
    """Vocabulary (feature -> column) and, per category, its columns, weights and threshold."""

    vocabulary: dict[str, int]
    columns: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray | None] = field(default_factory=list)
    priors: list[float] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)
    out_of_fold: np.ndarray | None = None

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        p = np.zeros((len(x), 0))
        for cols, w, prior in zip(self.columns, self.weights, self.priors):
            own = np.full(len(x), prior) if w is None else _sigmoid(np.c_[x[:, cols], p, np.ones(len(x))] @ w)
            p = np.c_[p, own]
        return p


def fit_chain(x: np.ndarray, y: np.ndarray, chosen: list[list[int]], vocabulary: dict[str, int]) -> Chain:
    """``y`` has one column per category, ``chosen`` the feature columns of each."""
    chain, n = Chain(vocabulary), len(x)
    fold = np.arange(n) % FOLDS
    earlier = np.zeros((n, 0))  # out-of-fold probabilities of the categories before
    for j in range(y.shape[1]):
        own, cols = y[:, j].astype(float), np.array(chosen[j], dtype=int)
        prior = float(own.mean()) if n else 0.0
        if min(own.sum(), n - own.sum()) < FEWEST:
            w, oof, threshold = None, np.full(n, prior), 2.0
        else:
            xx, oof = np.c_[x[:, cols], earlier], np.zeros(n)
            for k in range(FOLDS):
                held = fold == k
                oof[held] = _sigmoid(np.c_[xx[held], np.ones(held.sum())] @ fit_linear(xx[~held], own[~held]))
            w, threshold = fit_linear(xx, own), best_threshold(oof, own)
        chain.columns.append(cols)
        chain.weights.append(w)
        chain.priors.append(prior)
        chain.thresholds.append(threshold)
        earlier = np.c_[earlier, oof]
    chain.out_of_fold = earlier
    return chain


def _labels(labels: DataFrame) -> DataFrame:
    """One row ``(_id, low_quality, toxic, severe)`` per labelled document."""
    low, toxic = (F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int")
    own = labels.where("doc_id is not null and quality is not null and toxic is not null")
    by = own.groupBy(F.col("doc_id").alias("_id")).agg(F.max(low).alias("low_quality"), F.max(toxic).alias("toxic"))
    return by.withColumn("severe", F.col("low_quality") * F.col("toxic"))


def chi_square(n: Column, n1: Column, all_: Column, all1: Column) -> Column:
    """Of a feature held by n rows, n1 of them positive; 0 where it is rarer in positive rows."""
    a, b, c, d = n1, n - n1, all1 - n1, all_ - all1 - n + n1
    det = (a * d - b * c).cast("double")
    return F.when((det > 0) & (a >= 3), all_ * det * det / ((a + b) * (c + d) * all1 * (all_ - all1) + 1e-9)).otherwise(0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Chain:
    """Fit the chain on at most ``rows`` labelled documents.

    Features are counted and chosen by Spark; the driver only gets the values of the chosen ones.
    """
    picked = _labels(labels).orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    sample = cut_lineage(texts.join(F.broadcast(picked), "_id"))  # at most `rows` ids

    totals = sample.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in CHAIN]).collect()[0]

    def held(row) -> Iterator[tuple]:
        for f in features(row[0])[0]:
            yield (f, *row[1:])

    counted = map_rows(sample.select("text", *CHAIN), held, "feature string, " + ", ".join(f"{c} int" for c in CHAIN))
    counted = counted.groupBy("feature").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in CHAIN])
    counted = cut_lineage(counted.where("n >= 3"))
    lists = []
    for c in CHAIN:
        score = chi_square(F.col("n"), F.col(c), F.lit(totals["n"]), F.lit(totals[c] or 0))
        top = counted.withColumn("score", F.round(score, 9)).where("score > 0").orderBy(F.desc("score"), "feature")
        lists.append([r["feature"] for r in top.limit(FEATURES).collect()])
    vocabulary = {f: i for i, f in enumerate(dict.fromkeys(f for one in lists for f in one))}

    def values(row) -> Iterator[tuple]:
        own, n = features(row[1])
        at = [(vocabulary[f], _value(k, n)) for f, k in own.items() if f in vocabulary]
        yield row[0], [i for i, _ in at], [v for _, v in at], *row[2:]

    kind = sample.schema["_id"].dataType.simpleString()
    got = map_rows(
        sample.select("_id", "text", *CHAIN), values,
        f"id {kind}, at array<int>, v array<double>, " + ", ".join(f"{c} int" for c in CHAIN),
    )
    got = got.orderBy(F.md5(F.col("id").cast("string")), "id").collect()
    x = np.zeros((len(got), len(vocabulary)))
    for i, r in enumerate(got):
        x[i, r["at"]] = r["v"]
    y = np.array([[r[c] for c in CHAIN] for r in got], dtype=int).reshape(len(got), len(CHAIN))
    return fit_chain(x, y, [[vocabulary[f] for f in one] for one in lists], vocabulary)


def scorer(chain: Chain):
    """Text to probabilities; looks each distinct word up once per worker."""
    vocabulary, cache = chain.vocabulary, {}

    def columns(word: str) -> tuple[int, ...]:
        keys = [word] + [word[:k] + "~" for k in BEGINNINGS if len(word) > k]
        found = tuple(vocabulary[k] for k in keys if k in vocabulary)
        if len(cache) >= _CACHED:
            cache.clear()
        cache[word] = found
        return found

    def score(text: str | None) -> np.ndarray:
        words = Counter(_WORD.findall(text.lower())) if text else Counter()
        counts: Counter = Counter()
        for w, n in words.items():
            at = cache.get(w)
            for c in columns(w) if at is None else at:
                counts[c] += n
        x, total = np.zeros((1, len(vocabulary))), sum(words.values())
        for c, n in counts.items():
            x[0, c] = _value(n, total)
        return chain.probabilities(x)[0], total

    return score


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(id_col, p_<category>..., categories)`` per row; categories: those at or above their
    thresholds."""
    run = scorer(chain)

    def one(row) -> Iterator[tuple]:
        p, n_words = run(row[1])
        marked = [c for c, v, t in zip(CHAIN, p, chain.thresholds) if n_words and v >= t]
        yield row[0], *[round(float(v), 6) for v in p], marked

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return map_rows(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), one,
        f"id {kind}, " + ", ".join(f"p_{c} double" for c in CHAIN) + ", categories array<string>",
    ).withColumnRenamed("id", id_col)


def rejected(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, chain, id_col, text_col).where(F.array_contains("categories", "toxic"))


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows that are not toxic, with all their columns and nothing else; no shuffle."""
    run, toxic = scorer(chain), CHAIN.index("toxic")

    def keep(texts: list) -> np.ndarray:
        scored = [run(t) for t in texts]
        return np.array([not (n and p[toxic] >= chain.thresholds[toxic]) for p, n in scored], dtype=bool)

    return keep_rows(docs, text_col, keep)
