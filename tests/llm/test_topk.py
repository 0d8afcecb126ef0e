import math
import random

import numpy as np

from opsweave.llm import queries, topk
from tests.llm.conftest import SF


def brute(rows, k=5, every=50):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in ok]
    out = []
    for i, q in whole:
        if i % every == 0:
            scores = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, embedding array<float>, id int, score int")
    return sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0"), k=k).collect()))


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert sorted(map(tuple, queries.QUERIES["op7_top_k"](spark, SF).collect())) == brute(map(tuple, rows))


def test_blocks_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1.0, 0.0, 0.5, 1.0)) for _ in range(4)]) for i in range(400)]
    assert run(spark, rows) == brute(rows)
    rows = [(i % 100, [rng.random() for _ in range(6)]) for i in range(150)]
    got, want = run(spark, rows, 7), brute(rows, 7)
    assert got == want


def test_walk_stops_early():
    rng = np.random.default_rng(0)
    v = np.floor(256 * np.abs(rng.standard_normal((5000, 2))) ** 3)
    best, scored = topk.Lists(np.arange(5000), v).top(np.array([9.0, 4.0]), -1)
    scores = v @ np.array([9.0, 4.0])
    assert [s for s, _ in best] == sorted(scores.astype(int))[::-1][:5] and scored < 1000


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (50, [0.0, 0.0]), (100, None), (1, []), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]),
        (None, [1.0, 1.0]), (5, [1.0, 2.0]), (6, [-1.0]), (7, [3e38, 3e38]), (8, [1e15, -1e15]),
    ]
    got = run(spark, rows)
    assert [(q, r, v) for q, r, v, _ in got if q == 0] == [(0, 1, 7), (0, 2, 5), (0, 3, 50), (0, 4, 6), (0, 5, 8)]
    assert {q for q, *_ in got} == {0, 50} and got[0][3] == 2**63 - 1
    assert [v for q, _, v, _ in got if q == 50] == [0, 5, 6, 7, 8]
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []
