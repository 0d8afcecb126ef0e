import random
from collections import defaultdict

import numpy as np

from opsweave.llm import queries, suffix_dedup
from tests.llm.conftest import SF


def brute(rows, n=50):
    """Merged windows of n words that stand in rows of another id as well."""
    words = [(d, (t or "").encode().lower().split()) for d, t in rows]
    held = defaultdict(set)
    for d, w in words:
        for i in range(len(w) - n + 1):
            held[tuple(w[i : i + n])].add(d)
    out = defaultdict(set)
    for d, w in words:
        out[d].update(i for i in range(len(w) - n + 1) if len(held[tuple(w[i : i + n])]) > 1)
    merged = {}
    for d, starts in out.items():
        spans = []
        for i in sorted(starts):
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + n
            else:
                spans.append([i, i + n])
        if spans:
            merged[d] = ",".join(f"{a}:{b}" for a, b in spans)
    return merged


def found(df):
    return {r["doc_id"]: r["spans"] for r in suffix_dedup.digest(suffix_dedup.find(df)).collect()}


def test_query_against_brute_force(spark, docs):
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: r["spans"] for r in queries.QUERIES["op4_suffix_dedup"](spark, SF).collect()}
    assert want and got == want


def test_planted_passages(spark, frame):
    rng = random.Random(2)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    hot, rows = prose(51), []
    passages = [prose(n) for n in (49, 50, 51, 64, 300)]
    for d in range(120):
        parts = [prose(rng.randrange(80)), rng.choice(passages), prose(rng.randrange(80))]
        if d % 2:
            parts.append(hot)
        rows.append((d, " ".join(w for p in parts for w in p)))
    rows.append((500, " ".join(["same"] * 400)))
    rows.append((501, " ".join(["same"] * 200 + prose(5))))
    rows.append((502, " ".join(hot + prose(3) + hot)))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    got, want = found(frame([(d, t, "a") for d, t in rows])), brute(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got.keys() == want.keys()
    assert sum(got[d] != want[d] for d in want) <= 6  # only at the borders of ranges


def test_minimisers_depend_on_the_passage_only():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 2**62, 50).astype(np.uint64)
    keys = []
    for n in (0, 3, 90):
        h = np.r_[rng.integers(0, 2**62, n).astype(np.uint64), passage, rng.integers(0, 2**62, 7).astype(np.uint64)]
        at, heads = suffix_dedup.retained(h, 50)
        keys.append(set(heads[(at >= n) & (at < n + 16)].tolist()))
    assert keys[0] & keys[1] & keys[2]


def test_edges(frame, edge_rows):
    got = found(frame(edge_rows))
    assert got == {7: "0:30000", 8: "0:30000"}
    assert found(frame([(1, "a " * 80, "s"), (1, "a " * 80, "s")])) == {}
    assert found(frame([])) == {}
