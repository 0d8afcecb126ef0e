import random
from collections import defaultdict, deque

import pytest

from opsweave.operators import code_queries as Q
from opsweave.operators import graph_algos as A
from opsweave.plans import load_all


def graph(seed, nodes=24, edges=40):
    r = random.Random(seed)
    pairs = {(r.randint(0, nodes - 1), r.randint(0, nodes - 1)) for _ in range(edges)}
    pairs |= {(0, x) for x in range(1, nodes // 3)}  # a hub
    return sorted((a, b) for a, b in pairs if a != b), list(range(nodes + 2))


def frames(spark, pairs, nodes):
    return spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "id long")


def distances(pairs, start):
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    seen, queue = {}, deque([(start, 0)])
    while queue:
        at, d = queue.popleft()
        for n in out[at]:
            if n not in seen:
                seen[n] = d + 1
                queue.append((n, d + 1))
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    pairs, nodes = graph(seed)
    e, n = frames(spark, pairs, nodes)
    both = pairs + [(b, a) for a, b in pairs]
    weak = {r.id: r.component for r in A.weak_components(e, n).collect()}
    assert weak == {x: min([x, *distances(both, x)]) for x in nodes}
    reach = {x: distances(pairs, x) for x in nodes}
    want = {}
    for x in nodes:
        mates = [y for y in nodes if y != x and y in reach[x] and x in reach[y]]
        if mates:
            want[x] = min([x, *mates])
    assert {r.id: r.component for r in A.strong_components(e).collect()} == want


def test_long_chain_is_one_component(spark):
    pairs = [(i, i + 1) for i in range(60)]
    e, _ = frames(spark, pairs, [0])
    assert {r.component for r in A.weak_components(e).collect()} == {0}
    assert A.strong_components(e).count() == 0


def test_page_rank(spark):
    pairs, nodes = graph(3)
    e, n = frames(spark, pairs, nodes)
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    score = {x: 1 / len(nodes) for x in nodes}
    for _ in range(100):
        new = {x: 0.15 / len(nodes) for x in nodes}
        for x in nodes:
            for y in out[x] or nodes:
                new[y] += 0.85 * score[x] / len(out[x] or nodes)
        score = new
    got = {r.id: r for r in A.page_rank(e, n).collect()}
    assert all(abs(got[x].score - score[x]) < 1e-7 for x in nodes)
    assert got[0].callees == len(out[0]) and sum(r.callers for r in got.values()) == len(pairs)


def test_page_rank_with_split_hubs(spark, monkeypatch):
    pairs, nodes = graph(3)
    e, n = frames(spark, pairs, nodes)
    plain = {r.id: round(r.score, 9) for r in A.page_rank(e, n, iterations=12).collect()}
    monkeypatch.setattr(A, "HUB_EDGES", 2)
    assert {r.id: round(r.score, 9) for r in A.page_rank(e, n, iterations=12).collect()} == plain


def brandes(pairs, nodes, sources):
    out = defaultdict(list)
    for a, b in pairs:
        out[a].append(b)
    total = dict.fromkeys(nodes, 0.0)
    for s in sources:
        dist, sigma, pred, order, queue = {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    pred[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    scale = 1 / ((len(nodes) - 1) * (len(nodes) - 2))
    return {x: v * scale for x, v in total.items()}


@pytest.mark.parametrize("sources", [200, 5])
def test_betweenness(spark, sources):
    pairs, nodes = graph(4)
    e, n = frames(spark, pairs, nodes)
    step = max(len(nodes) // sources, 1)
    picked = nodes if len(nodes) <= sources else nodes[::step][:sources]
    want = brandes(pairs, nodes, picked)
    got = {r.id: r.centrality for r in A.betweenness(e, n, sources).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in nodes)


def test_reach_paths_and_cycles(spark):
    pairs, nodes = graph(5)
    e, _ = frames(spark, pairs, nodes)
    starts = spark.createDataFrame([(0,), (7,)], "start long")
    got = {(r.start, r.node): r.depth for r in A.reach(e, starts, 3).collect()}
    assert got == {(s, x): d for s in (0, 7) for x, d in distances(pairs, s).items() if d <= 3}
    goals = spark.createDataFrame([(0, g) for g in nodes if g], "start long, goal long")
    edge = set(pairs)
    for r in A.shortest_paths(e, goals, 10).collect():
        assert r.hops == distances(pairs, 0)[r.goal]
        assert all(step in edge for step in zip(r.path, r.path[1:]))


def test_community_summary_text(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "src long, dst long")
    f = spark.createDataFrame(
        [(1, "get_user_name", "a/users/x.py"), (2, "set_user_name", "a/users/y.py"), (3, "load_user", "a/b/z.py"), (5, "alpha", ""), (6, "beta", "")],
        "id long, name string, file string",
    )
    rows = {r.component: r for r in A.community_summaries(e, f).collect()}
    assert rows[1].name == "users" and rows[1].key_function == "set_user_name"
    assert rows[1].description == (
        "User/name module (3 functions, 3 files). Hub: set_user_name. Does: get, load, set for user, name"
    )
    assert rows[5].name == "alpha beta" and rows[5].description == "Module (2 functions, 0 files). Hub: alpha"


def test_token_scores(spark):
    def score(query, name):
        q = spark.createDataFrame([(1, query)], "qid int, description string")
        f = spark.createDataFrame([(1, name, "f.py", 3, "")], "id int, name string, file string, line int, body string")
        got = Q.similar_functions(q, f, threshold=0.0).collect()
        return got[0].score if got else 0.0

    assert score("retry backoff", "retry_backoff") == 0.6  # 0.6 * 1.0, no body
    assert score("retry backoff", "create_user") == 0.0
    assert score("retry", "retrying") > 0


def test_module_exports_lists_every_name(spark, tmp_path):
    part = spark.range(1, 1101).selectExpr("id as p_partkey", "'a b' as p_name", "'Brand#11' as p_brand", "1 as p_size")
    part.write.parquet(f"{tmp_path}/part.parquet")
    (got,) = load_all()["code_module_exports"].run(spark, str(tmp_path)).collect()
    assert got.n == 1100 and got.names.split(",") == sorted(f"a_b_{i}" for i in range(1, 1101))
    few = Q.module_exports(spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "_c")], "file string, name string"), 1).collect()
    assert [(r.n, r.names) for r in few] == [(2, ["a"])]
