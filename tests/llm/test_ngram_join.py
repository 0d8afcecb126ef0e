import random
import sys
import time
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.accumulators import AccumulatorParam

from opsweave.llm import ngram_join, queries
from opsweave.llm.components import components
from tests.llm.conftest import SF


class Largest(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return max(a, b)


def brute(rows, n=3, percent=90):
    """Smallest linked id and set size per row, by all pairs of sets that share a shingle of n words."""
    sets, size = defaultdict(list), {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) or frozenset([tuple(w)] if w else [])
        size[d] = len(s)
        if s:
            sets[s].append(d)
    nodes, root = list(sets), {}

    def find(i):
        while root.get(i, i) != i:
            i = root[i]
        return i

    index = defaultdict(list)
    for i, s in enumerate(nodes):
        shared = Counter(j for x in s for j in index[x])
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(nodes[j]) - k):
                root[find(i)] = find(j)
        for x in s:
            index[x].append(i)
    least = {}
    for i, s in enumerate(nodes):
        least[find(i)] = min([least.get(find(i), min(sets[s])), *sets[s]])
    own = {d: least[find(i)] for i, s in enumerate(nodes) for d in sets[s]}
    return {d: (size[d], own.get(d, d)) for d, _ in rows}


def planted(seed=4):
    """Groups of copies with a few words changed, from equal texts to pairs around the bound."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    common = [word() for _ in range(70)]  # a passage of many documents
    rows = []
    for group in range(40):
        base = [word() for _ in range(rng.choice((2, 3, 9, 11, 12, 13, 40, 90, 200, 700)))]
        if group % 3 == 0:
            base += common
        for _ in range(rng.choice((1, 2, 5, 12, 90 if group < 3 else 3))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice(([], [word()], [copy[at], word()])) if len(copy) > 1 else copy
            rows.append((len(rows) * 7 % 9973, " ".join(copy)))
    return rows


def test_planted_groups_against_brute_force(spark, frame, monkeypatch):
    rows = planted()
    want = brute(rows)
    assert sum(d != c for d, (_, c) in want.items()) > 80
    docs = frame([(d, t, "a") for d, t in rows])
    for small in (False, True):  # again with frequent tokens in pairs and many blocks
        if small:
            monkeypatch.setattr(ngram_join, "FREQUENT", 3)
            monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 2000)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs).collect()}
        assert got == want


def test_five_words_at_80_percent(spark, frame):
    """Near copies of 5-word Jaccard 0.80 to 0.85, which 3 words at 0.9 do not link."""
    rng = random.Random(7)
    rows, want = [], {}
    for group, (n, changed) in enumerate([(200, 4), (100, 2), (420, 8), (1000, 18), (3000, 55), (8, 0), (9, 0)]):
        base = [f"g{group}w{i}" for i in range(n)]
        copy = list(base)
        for k in range(changed):
            copy[10 + k * (n - 20) // max(changed, 1)] = f"new{rng.random()}"
        if not changed:  # 4 shingles of 5, and 5 of 6
            copy.append("more")
        sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (base, copy)]
        assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85
        rows += [(2 * group, " ".join(base), "a"), (2 * group + 1, " ".join(copy), "a")]
        want |= {2 * group: 2 * group, 2 * group + 1: 2 * group}
    rows += [(99, " ".join(f"w{i}" for i in range(300)), "a"), (100, "g1w0 g1w1 g1w2", "a")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(frame(rows), size=5, percent=80).collect()}
    assert got == want | {99: 99, 100: 100}
    kept = ngram_join.keep_one(frame(rows), size=5, percent=80).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({*want.values(), 99, 100})
    for n in range(1, 500):
        assert all(set(ngram_join.bands(n, 80)) & set(ngram_join.bands(m, 80)) for m in range(n + 1, n * 5 // 4 + 1)), n


def test_query_against_brute_force(spark, docs):
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op2_ngram_join"](spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("n,percent", [(20, 90), (100, 90), (1000, 90), (2000, 90), (20_000, 90), (1000, 80)])
def test_pairs_of_a_prefix_grow_with_the_edits(n, percent):
    """A set of frequent tokens only: entries in proportion to the edits, and a pair left after all of them."""
    rng = np.random.default_rng(n)
    e = ngram_join.edits(n, percent)
    for band in ngram_join.bands(n, percent):
        c = ngram_join.classes(band, percent)
        keys = rng.integers(-(1 << 63), 1 << 63, e + c + 1).tolist()
        found = ngram_join.pairs_within_classes(keys, c)
        assert len(found) <= max(10, 6 * (e + c))
        for _ in range(20):
            left = rng.choice(len(keys), c + 1, replace=False)
            assert set(ngram_join.pairs_within_classes([keys[i] for i in left], c)) & set(found)
    assert ngram_join.pairs_within_classes([], 3) == []


def test_bound_and_bands():
    for n in range(1, 3000):
        linked = [m for m in range(n, int(n / 0.9) + 2) if 100 * n >= 90 * m]  # a subset of n in m
        for m in linked:
            assert n == m or set(ngram_join.bands(n)) & set(ngram_join.bands(m)), (n, m)
    assert [ngram_join.edits(n) for n in (9, 10, 19, 20)] == [0, 1, 1, 2]


def test_linked_finds_all_components():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.choice(60, 40)).astype(np.uint64) for _ in range(60)]
    near = [(i, j) for i in range(60) for j in range(i) if 10 * len(np.intersect1d(sets[i], sets[j])) >= 9 * len(np.union1d(sets[i], sets[j]))]
    forest = list(ngram_join.linked(sets))
    assert set(map(frozenset, forest)) <= set(map(frozenset, near)) and len(forest) < 60


@pytest.mark.parametrize("n", [1, 2, 50])
def test_components_of_a_path(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 100)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100}


def test_a_star_takes_one_round(spark, monkeypatch):
    """Stars are known by their nodes, not by a second round that changes nothing."""
    module, rounds = sys.modules["opsweave.llm.components"], []
    monkeypatch.setattr(module, "cut_lineage", lambda df, cut=module.cut_lineage: rounds.append(1) or cut(df))
    edges = spark.createDataFrame([(0, i) for i in range(1, 9)] + [(20, 21), (30, 30)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(9)} | {20: 20, 21: 20, 30: 30} and len(rounds) == 1


def test_shares_follow_the_set_that_needs_most(frame):
    """One pass tells how far every band has to reach, so that no text is read again with a larger share."""
    rng = random.Random(2)
    rows = [(d, " ".join(f"w{rng.randrange(10**6)}" for _ in range(516)), "a") for d in range(200)]
    few = [s for r in ngram_join._rows(frame(rows), "doc_id", "text", 3, 90).collect() for s in r["short"]]
    assert few
    below = {b: (max(s["half"] for s in few if s["band"] == b) + 1) << 1 for b in {s["band"] for s in few}}
    for r in ngram_join._parts(frame(rows), "doc_id", "text", below, 3, 90).collect():
        need = min(r["n"], ngram_join.edits(r["n"]) + ngram_join.classes(r["band"]) + 1)
        assert need <= r["m"] == len(r["keys"]) < r["n"]


def test_edges(frame, edge_rows):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame(edge_rows)).collect()]
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 5), (6, 1, 5), (7, 29_998, 7), (8, 29_999, 7), (None, 3, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = ngram_join.keep_one(frame(edge_rows))
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 7, None], key=str)
    assert kept.columns == frame([]).columns and ngram_join.keep_one(frame([])).count() == 0


def test_keep_one_judges_rows_by_their_texts(frame):
    """Different texts under one id or without an id are different documents."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    near = b.replace("b0 ", "x0 ")  # 27 of 29 shingles
    loose = [(None, f"text {i} without an id", "a") for i in range(20)]
    rows = [(3, a, "a"), (5, a, "a"), (5, b, "a"), (5, b, "a"), (6, near, "a"), (None, a, "a"), (None, c, "a"), (None, c, "b")]
    rows += loose + loose[:4] + [(None, "", "a"), (None, None, "a"), (1, " ", "a"), (1, " ", "a")]
    want = [(3, a), (5, b), (None, c), (None, ""), (None, None), (1, " "), (1, " ")] + [(None, t) for _, t, _ in loose]
    kept = ngram_join.keep_one(frame(rows))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_memory_of_many_short_sets():
    """Two blocks of short texts: one float matrix and strips, not several matrices of 8 bytes a cell."""
    rng = np.random.default_rng(3)
    shared = np.arange(28, dtype=np.uint64)
    sets = [np.concatenate([shared, 100 + np.sort(rng.choice(3000, 2, False)).astype(np.uint64)]) for _ in range(3000)]
    side = np.arange(3000) % 2
    tracemalloc.start()
    forest = list(ngram_join.linked(sets, side))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * 3000**2 and all(side[i] != side[j] for i, j in forest)
    near = lambda i, j: 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 90 * (60 - k)
    assert forest and all(near(i, j) for i, j in forest)


def test_blocks_are_bounded_in_sets(spark, frame, monkeypatch):
    """A cluster of short texts is cut into blocks though its tokens would fit into one."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(40)]
    rows = [(d, " ".join([f"a{d}" if rng.random() < 0.5 else f"b{d % 9}", *shared, f"c{rng.randrange(200)}"])) for d in range(300)]
    monkeypatch.setattr(ngram_join, "FREQUENT", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 40)
    largest, linked = spark.sparkContext.accumulator(0, Largest()), ngram_join.linked

    def watched(sets, side=None, percent=90):
        largest.add(len(sets))
        return linked(sets, side, percent)

    monkeypatch.setattr(ngram_join, "linked", watched)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame([(d, t, "a") for d, t in rows])).collect()}
    assert got == brute(rows)
    assert 2 < largest.value < 160  # two blocks of 40 on average, of 300


def test_tokens_go_in_slices_and_shuffles_are_freed(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {x for x in blocks.getAllBlocks().mkString(",").split(",") if "shuffle" in x}
    before = files()
    found, named = ngram_join._components(docs, "doc_id", "text", 5, 80)
    for _ in range(50):  # they are deleted in the background
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left
    c = {r.v: r.c for r in named.collect()}
    got = {r.id: c.get(r.v, r.id) for r in found.collect()}
    want = brute(rows, 5, 80)
    assert len({(got[i], want[i][1]) for i in got}) == len(set(got.values())) == len({w for _, w in want.values()})
    key = [(v, 1, v % 5 + 1, list(range(-9, v))) for v in range(6)]
    parts = spark.createDataFrame(key, "v long, band int, m long, keys array<long>")
    with ngram_join.shared_folder(spark, "t") as folder:
        shared = {(r.key, r.v, r.df) for r in ngram_join._shared_tokens(parts, folder).collect()}
    assert shared == {(k, v, 6 - max(0, k + 1)) for v in range(6) for k in range(-9, v) if k < 4}
