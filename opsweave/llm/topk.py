"""Exact top-k search by inner product with Fagin's threshold algorithm.

Components are whole numbers, floor(256 x). Candidates are cut into blocks; a block keeps one list per
dimension, sorted by the component. A query walks all lists at once, from the end that its own component
favours, in growing steps: every vector met for the first time is scored in full. No vector unseen so
far can score more than the sum of the query's components times the values just reached in the lists;
once the k-th best score is above that bound, the walk stops. The best k of each block are merged. As only
what the bound rules out is left unseen, results are exact, ties going to the smaller id.

Queries are cut into blocks as well, and each pair of a query block and a candidate block is one task's
group of bounded size; nothing is broadcast or collected.

Vectors that are null, empty, or hold a null or non-finite component take no part, nor do rows without an
id. Shorter vectors count as filled up with zeros. A query never meets rows of its own id; rows that
repeat an id are each a candidate, and each a query. Scores are exact; one beyond a long is set to
the nearest long. With fewer than k candidates, all are returned.
Without queries or candidates there are no rows; columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
CANDIDATES = 8192  # per block, on average
QUERIES = 1024
FIRST_STEP = 16
_LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def whole(vectors: list, width: int) -> np.ndarray:
    """floor(256 x) as rows of equal width: doubles where these are exact, else Python integers."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    out = np.floor(out * 256)
    if len(out) and np.abs(out).max() >= 2.0**53:
        return np.array([[int(x) for x in row] for row in out], dtype=object)
    return out


class Lists:
    """A block of candidates with its sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")
        self.values = np.take_along_axis(self.vectors, self.order, axis=0)

    def top(self, query: np.ndarray, own_id: int, k: int = K) -> tuple[list[tuple[int, int]], int]:
        """The best ``(score, id)`` in order, and how many candidates were scored."""
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = self.ids == own_id
        scored = int(seen.sum())
        best_at, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=query.dtype)
        if not len(up) and not len(down):  # every score is 0
            at = np.flatnonzero(~seen)[:k]
            return [(0, int(self.ids[i])) for i in at], n
        a, step = 0, FIRST_STEP
        while a < n and scored < n:
            b = min(n, a + step)
            met = np.concatenate([self.order[n - b : n - a][:, up].ravel(), self.order[a:b][:, down].ravel()])
            fresh = np.unique(met[~seen[met]])
            seen[fresh] = True
            scored += len(fresh)
            best_at = np.concatenate([best_at, fresh])
            best = np.concatenate([best, self.vectors[fresh] @ query])
            if len(best) > k:  # positions follow ids, so ties keep the smaller ids
                keep = np.lexsort((best_at, -best))[:k]
                best_at, best = best_at[keep], best[keep]
            bound = (query[up] * self.values[n - b, up]).sum() + (query[down] * self.values[b - 1, down]).sum()
            if len(best) >= k and min(best) > bound:
                break
            a, step = b, step * 2
        order = np.lexsort((best_at, -best))
        return [(int(best[i]), int(self.ids[best_at[i]])) for i in order[:k]], scored


def _exact(candidates: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles as long as every score and bound is a whole number below 2 ** 53, else integers."""
    if candidates.dtype != object and queries.dtype != object and len(candidates) and len(queries):
        if float((np.abs(candidates).max(axis=0) * np.abs(queries).max(axis=0)).sum()) < 2.0**53:
            return candidates, queries
    return tuple(np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (candidates, queries))


def search_block(candidates: pd.DataFrame, queries: pd.DataFrame, k: int = K) -> Iterator[tuple]:
    if not len(candidates) or not len(queries):
        return
    width = max(max(map(len, candidates["vector"])), max(map(len, queries["vector"])))
    c, q = _exact(whole(list(candidates["vector"]), width), whole(list(queries["vector"]), width))
    lists = Lists(candidates["id"].to_numpy(), c)
    for qid, nr, vector in zip(queries["id"].tolist(), queries["nr"].tolist(), q):
        for score, vid in lists.top(vector, qid, k)[0]:
            yield qid, nr, vid, max(_LONG[0], min(_LONG[1], score))


def top_k(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
) -> DataFrame:
    """One row ``(query_id, rank, vec_id, score)`` per query and result."""
    def own(df: DataFrame) -> DataFrame:
        vector = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(
            F.col("id").isNotNull() & usable(F.col("vector"))
        )

    c, q = own(vectors), own(queries)
    q = q.withColumn("nr", F.row_number().over(Window.partitionBy("id").orderBy("vector")))
    blocks = max(1, -(-c.count() // CANDIDATES))
    query_blocks = max(1, -(-q.count() // QUERIES))

    def block(n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "id", "vector"), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    c = c.withColumn("c", block(blocks, 1)).withColumn("q", every(query_blocks))
    q = q.withColumn("q", block(query_blocks, 2)).withColumn("c", every(blocks))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = list(search_block(left, right, k))
        return pd.DataFrame(rows, columns=["query_id", "nr", "vec_id", "score"], dtype="int64")

    found = c.groupBy("c", "q").cogroup(q.groupBy("c", "q")).applyInPandas(
        search, "query_id bigint, nr bigint, vec_id bigint, score bigint"
    )
    rank = F.row_number().over(Window.partitionBy("query_id", "nr").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
      from v q join v c on c.vec_id != q.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
