"""Steps that must not grow with a product of two sides, compared with plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from opsweave.functions import text
from opsweave.functions import vectors as V
from opsweave.functions.sizes import broadcast_if_small
from opsweave.functions.text import contains_join
from opsweave.operators import code_queries as Q
from opsweave.operators import codegraph as G
from opsweave.operators import diagnose
from opsweave.operators import graph_algos as A
from opsweave.operators import logs
from opsweave.operators import paths as P
from opsweave.operators import policy as pol
from opsweave.operators import search as S
from opsweave.session import cut_lineage
from opsweave.sources import tables as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_functions_of_a_well_compressed_table_are_not_broadcast(spark, tmp_path):
    parts = [(k, "red ring", "Brand#11", 7) for k in range(500)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k, k + 1) for k in range(500)], "id long, dst long").write.parquet(f"{tmp_path}/calls.parquet")
    joined = T.load(spark, tmp_path, "calls").join(T.functions(spark, tmp_path).select("id", "name"), "id")
    assert "BroadcastHashJoin" not in plan(joined) and joined.count() == 500
    few, many = spark.range(3), spark.range(9)
    assert "BroadcastHashJoin" not in plan(few.join(broadcast_if_small(many, 5), "id"))
    assert "BroadcastHashJoin" in plan(few.join(broadcast_if_small(many, 9), "id"))


def test_modified_functions_counts_without_pairs(spark):
    changes = [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (None, "b"), (3, None), (4, "c")]
    fns = [(10, "a"), (10, "a"), (11, "a"), (11, "b"), (12, None), (None, "b"), (13, "b"), (13, None), (14, "z")]
    c, f = spark.createDataFrame(changes, "commit long, file string"), spark.createDataFrame(fns, "id long, file string")
    pairs = {(m, fn) for m, x in changes for fn, y in fns if x is not None and x == y}
    assert {tuple(r) for r in G.modified_functions(c, f).collect()} == pairs
    want = Counter(fn for _, fn in pairs)
    assert {r.fn: r.commits for r in G.modified_functions(c, f, counted=True).collect()} == want


def test_affected_functions_shuffle_no_pairs(spark):
    c = spark.createDataFrame([(1, "a", "M"), (1, "a", "M"), (1, "a", "D"), (2, None, "A")], "pr long, file string, change_type string")
    f = spark.createDataFrame([(7, "f", "a"), (7, "f", "a"), (8, "f", "a"), (9, "g", None)], "id long, name string, file string")
    out = Q.affected_functions(c, f)
    assert sorted(tuple(r) for r in out.collect()) == [(1, fn, "f", "a", t) for fn in (7, 8) for t in "DM"]
    top = plan(out).split("SortMergeJoin")[0].split("BroadcastHashJoin")[0]
    assert "HashAggregate" not in top and "Exchange" not in top


def test_forgotten_files(spark, monkeypatch):
    r = random.Random(5)
    changes = [(r.choice([1, 2, 3, None]), r.choice("abcd")) for _ in range(9)] + [(4, None), (5, "x")]
    fc = [(r.choice([*range(12), None]), r.choice("abcdefg")) for _ in range(60)] + [(None, "x"), *((m, None) for m in range(12))]
    files, of = {x for x in changes}, {x for x in fc}
    want = Counter()
    for pr in {p for p, _ in files}:
        mine = {f for p, f in files if p == pr}
        for m in {m for m, _ in of if m is not None}:
            there = {f for k, f in of if k == m}
            for f in there:
                if f not in mine or pr is None or f is None:
                    want[pr, f] += len([x for x in there & mine if x is not None])
    want = {k: n for k, n in want.items() if n >= 3}
    assert want and any(f is None for _, f in want)
    c = spark.createDataFrame(changes, "pr long, file string")
    d = spark.createDataFrame(fc, "commit long, file string")
    for most in (2_000_000, 0):
        monkeypatch.setattr(Q, "TOGETHER_ROWS", most)
        assert {(x.pr, x.file): x.n for x in Q.forgotten_files(c, d).collect()} == want


def test_contains_join_around_the_gram_lengths(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("ab1") for _ in range(n))
    texts = [(k, word(r.randint(0, 30))) for k in range(40)] + [(99, None)]
    needles = sorted({word(n) for n in (1, 2, 3, 4, 5, 7, 8, 9, 10) for _ in range(6)})
    t, n = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame([(x,) for x in needles], "n string")
    for least in (1, 4, 8):
        want = {(k, x) for k, text in texts if text for x in needles if len(x) >= max(least, 1) and x in text}
        some = n.where(f"length(n) >= {least}")
        got = [(x.id, x.n) for x in contains_join(t, "t", some, "n", min_length=min(least, 4)).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert contains_join(t, "t", n.limit(0), "n").count() == 0
    assert contains_join(t, "t", n.selectExpr("n as _k"), "_k").columns == ["id", "t", "_k"]  # any name but those used inside


def test_last_step_of_a_path_shuffles_only_nodes_with_several_ways(spark):
    edges = [("p", "RUNS", "i1", 1.0), ("p", "RUNS", "i2", 2.0), ("q", "RUNS", "i1", None), ("i1", "BUILT_FROM", "f1", None),
             ("i2", "BUILT_FROM", "f2", None), ("f1", "CONTAINS", "x", 3.0), ("f1", "CONTAINS", "x", 5.0), ("f2", "CONTAINS", "x", 4.0),
             ("f2", "CONTAINS", "y", None), ("f1", "CONTAINS", None, 1.0), ("f2", "CONTAINS", None, 9.0)]
    e = spark.createDataFrame(edges, "src string, edge_type string, dst string, at double")
    s = spark.createDataFrame([("p",), ("q",), ("q",)], "start string")
    got = sorted((r.start, r.node or "", r["at"]) for r in P.follow(e, s, P.TRACE).collect())
    assert [(a, b) for a, b, _ in got] == [("p", ""), ("p", "x"), ("p", "y"), ("q", ""), ("q", "x")]
    assert [t for *_, t in got] == [9.0, 5.0, None, 1.0, 5.0]


def test_reach_sizes_keep_packed_parts(spark, monkeypatch):
    r = random.Random(11)
    ids = [-40_000, -1, 0, 7, 8_191, 8_192, 32_767, 32_768, 70_001, 2**40] + list(range(100_000, 100_240))
    edges = {(r.choice(ids), r.choice(ids)) for _ in range(900)} | {(i, 7) for i in ids} | {(7, i) for i in ids[:160]}
    edges = sorted(e for e in edges if e[0] != e[1])
    mark = {i: i % 9 for i in ids if i % 4}
    kept = []

    def cut(df):
        out = cut_lineage(df)
        if "bits" in out.columns:
            kept.append(out.selectExpr("sum(octet_length(bits))").first()[0])
        return out

    monkeypatch.setattr(A, "cut_lineage", cut)
    e = spark.createDataFrame([*edges, *edges, (None, 7), (3, None)], "src long, dst long")
    marks = spark.createDataFrame([*mark.items(), *mark.items(), (5, None)], "id long, mark long")
    callers = {}
    for a, b in edges:
        callers.setdefault(b, set()).add(a)
    within = {1: callers}
    for d in (2, 3):
        within[d] = {i: s.union(*(within[d - 1].get(c, set()) for c in s)) for i, s in callers.items()}
    for d in (1, 3):
        got = {x.id: (x.n, x.kinds) for x in A.reach_sizes(e, d, {"n": None, "kinds": marks}).collect()}
        assert got == {i: (len(s), len({mark[c] for c in s if c in mark}) or None) for i, s in within[d].items()}
    assert max(x or 0 for x in kept) < 600 * len(ids)  # bitmaps of 32,768 marks took 4,096 bytes a node and kind


def test_names_with_the_same_matching_words_are_ranked_once(spark):
    names = ["ring_a", "ring_b", "ring_c", "ring_ring", "ringer_x", "blue_ring", "none", "a_ringing_bell", "bl"]
    ents = [(i, n, f"src/{n[0]}.py", "function") for i, n in enumerate(names * 6)] + [(0, "ring_a", "src/r.py", "function"), (None, "ring_z", "f", "function")]
    asked = [("q1", "ring blue"), ("q2", "blue bell stone"), ("q3", "ring"), ("q4", "zzz")]
    e = spark.createDataFrame(ents, "id long, name string, file string, kind string")
    q = spark.createDataFrame(asked, "qid string, text string")

    def near(a, b):
        return a in b or b in a or (min(len(a), len(b)) >= 6 and a[:6] == b[:6])

    tokens = {}
    for i, n, _, _ in ents:
        if i is not None and len(n) > 2:
            tokens.setdefault(i, set()).update(n.split("_"))
    want = []
    for qid, text in asked:
        words, rows = text.split(), []
        for i, n, f, _ in ents:
            if i is None or len(n) < 3:
                continue
            ratio = sum(any(near(w, t) for t in tokens[i]) for w in words) / len(words)
            if ratio >= 0.5:
                rows.append((-ratio, len(n), i, n, f, qid))
        want += [(qid, i, -r, n, f) for r, _, i, n, f, qid in sorted(rows)[:4]]
    found = S.name_matches(e, q, 4)
    assert sorted((x.qid, x.id, x.ratio, x.name, x.file) for x in found.collect()) == sorted(want)
    assert "_like" in plan(found)  # queries meet sets of words, not entities

    full = S.ranked(S.keyword_scores(e, q), "score", keep=5).collect()
    assert sorted(map(str, S.ranked(S.best_keywords(e, q, 5), "score", keep=5).collect())) == sorted(map(str, full))


def test_edges_are_computed_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            made.add(1)
            yield r

    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)]
    edges = spark.createDataFrame(spark.sparkContext.parallelize(pairs, 1).mapPartitions(seen), "src long, dst long")
    for run in (A.weak_components, A.strong_components, lambda e: A.shortest_paths(e, spark.createDataFrame([(1, 4)], "start long, goal long"))):
        before = made.value
        run(edges).collect()
        assert made.value - before == len(pairs)


def test_grams_of_many_texts_at_once(monkeypatch):
    texts = ["", "ab", "abc", "Ring \u00e9\u20ac\U0001f600\ud800", "x" * 40, None, "small ring economy " * 9]

    def slow(text):
        out, chars = np.zeros(V.DIM), [c.encode("utf-8", "surrogatepass") for c in (text or "").lower()]
        for n in range(3, 7):
            for i in range(len(chars) - n + 1):
                h = 2166136261
                for o in b"".join(chars[i : i + n]):
                    h = (h ^ o) * 16777619 % 2**32
                out[h % V.DIM] += 1 if h < 2**31 else -1
        norm = np.sqrt((out * out).sum())
        return out / norm if norm else out

    for chars in (7, 1 << 17):
        monkeypatch.setattr(V, "BLOCK_CHARS", chars)
        assert (V._ngram_vectors(texts) == np.stack([slow(t) for t in texts])).all()


def test_best_cells_are_the_sorted_ones():
    rng, least = np.random.default_rng(3), np.full(5, -np.inf)
    kept = []
    for start in (0, 40, 80):
        sims, ids = rng.integers(0, 9, (5, 40)).astype(float), start + rng.permutation(40)
        rows, cols = V._best_cells(sims, ids, 6, least)
        kept.append((sims, ids, list(zip(rows, sims[rows, cols], ids[cols]))))
    for q in range(5):
        every = sorted((-v, i) for sims, ids, _ in kept for v, i in zip(sims[q], ids))[:6]
        assert sorted((-v, i) for _, _, got in kept for r, v, i in got if r == q)[:6] == every
    assert len(kept[2][2]) < 5 * 6  # a task's earlier batches leave less to keep


def test_codebase_suggestion_meets_sets_of_words(spark):
    r = random.Random(4)
    words = ["load", "user", "order", "parse", "x"]
    name = lambda: "_".join(r.choice(words) for _ in range(r.randint(1, 4)))
    fns = [("function", name() + r.choice(["", f"_{k}", "Load"]), r.choice(["a", "b", None]), k % 7) for k in range(60)]
    fns += [*fns[:9], ("function", None, "a", 1), ("class", "load_user_order_parse_x", "a", 0)]
    acts = [(name().replace("_", r.choice("_- ")),) for _ in range(25)] + [("zzz",), (None,), ("",)]
    split = lambda s: {w for w in re.split(r"[_\-\s]+", s.lower()) if w}
    times = Counter(f[1:] for f in fns if f[0] == "function" and f[1])
    want = {}
    for (a,) in acts:
        shared = {f: n * len(split(a or "") & (split(f[0]) | split(re.sub("([a-z])([A-Z])", r"\1_\2", f[0])))) for f, n in times.items()}
        shared = {f: n for f, n in shared.items() if n}
        if shared:
            f = min(shared, key=lambda f: (-shared[f], f[1] is not None, f[1] or "", f[2], f[0]))
            want[a] = (f[0], shared[f])
    got = pol.codebase_suggestion(
        spark.createDataFrame(acts, "action string"), spark.createDataFrame(fns, "kind string, name string, file string, line int")
    )
    assert {x.action: (x.name, x.shared) for x in got.collect()} == want
    # a thousand functions of equal words are one row where actions meet them
    many = spark.createDataFrame([("function", f"load_user_{k}", "a", k) for k in range(1000)], "kind string, name string, file string, line int")
    few = pol.codebase_suggestion(spark.createDataFrame([("load user",)], "action string"), many)
    few.collect()
    assert "held" in plan(few) and [tuple(x)[1:3] for x in few.collect()] == [("load_user_0", 2)]


def test_reports_leave_out_the_examples(spark):
    rows = [("n", "p", 1.0, "ERROR disk full"), ("n", "p", 2.0, "ERROR disk full"), (None, "p", 2.0, "ERROR disk full")]
    lines = spark.createDataFrame(rows, "namespace string, pod string, ts double, line string")
    b = logs.pod_buckets(lines)
    assert [(x["count"], x.examples) for x in b.collect()] == [(2, ["ERROR disk full"] * 2)]  # no bucket without a key
    report = diagnose.diagnose_report({"cluster": b})
    report.collect()
    assert "Join" not in plan(report) and "Window" not in plan(report)
    assert "Window" in plan(b)


def test_co_change_takes_partitions_by_its_pairs(spark, monkeypatch):
    seen, real = [], Q.cut_lineage
    monkeypatch.setattr(Q, "cut_lineage", lambda df: seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))) or real(df))
    changes = spark.range(400).selectExpr("id % 4 as commit", "id as fn").union(spark.sql("select null, 1L"))
    with monkeypatch.context() as m:
        m.setattr(Q.enough_partitions.__wrapped__, "__defaults__", (1000,))
        got = Q.co_change_partners(changes, changes.select("fn"), "fn", 3).collect()
    assert seen == [40] and spark.conf.get("spark.sql.shuffle.partitions") == "8"  # four commits of 100 * 100 pairs
    first = lambda t: [x for x in range(t % 4, 400, 4) if x != t][:3]
    assert {(x.target, x.partner, x.shared) for x in got} == {(t, p, 1) for t in range(400) for p in first(t)}


def test_betweenness_deals_out_its_edges_once(spark, monkeypatch):
    edges = spark.createDataFrame([(0, k) for k in range(1, 9)] + [(k, 9) for k in range(1, 9)] + [(9, 10)], "src long, dst long")
    want = {0: 0.0, 10: 0.0, 9: 9 / 90, **{k: 0.25 / 90 for k in range(1, 9)}}
    for hub in (1_000_000, 3):
        monkeypatch.setattr(A, "HUB_EDGES", hub)
        dealt, real = [], A.cut_lineage
        monkeypatch.setattr(A, "cut_lineage", lambda df: dealt.append(plan(df)) or real(df))
        got = {x.id: round(x.centrality, 9) for x in A.betweenness(edges).collect()}
        monkeypatch.setattr(A, "cut_lineage", real)
        assert got == {k: round(v, 9) for k, v in want.items()}
        assert sum(bool(re.search(r"hashpartitioning\(src#\d+L, \d", p)) for p in dealt) == 1  # to find hubs, in no round


def test_page_rank_ends_when_ranks_are_final(spark, monkeypatch):
    """A well mixed graph needs few of the 100 rounds; a cycle with a tail ends right as well."""
    rng = random.Random(7)
    pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(600)} | {(70, 71), (71, 72), (72, 70), (73, 70), (1, 80)})
    nodes = sorted({x for p in pairs for x in p})
    out, rank = Counter(a for a, _ in pairs), dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(400):
        loose = sum(r for n, r in rank.items() if n not in out)
        new = dict.fromkeys(nodes, (0.15 + 0.85 * loose) / len(nodes))
        for a, b in pairs:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    rounds = []
    monkeypatch.setattr(A, "cut_lineage", lambda df, cut=A.cut_lineage: rounds.append(1) or cut(df))
    mixed = [(a, b) for a, b in pairs if a < 60 and b < 60]
    A.page_rank(spark.createDataFrame(mixed, "src long, dst long")).count()
    assert len(rounds) <= 10
    got = {r["id"]: r["score"] for r in A.page_rank(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-9 for n in nodes)


def test_alike_functions_are_scored_once(spark, monkeypatch):
    """Numbers in a name are related to no word asked for, so 400 functions fall into few groups."""
    functions = spark.createDataFrame(
        [(i, f"{('load', 'save')[i % 2]}_user_{i}", "a.py", i, "db") for i in range(400)], "id long, name string, file string, line int, body string"
    )
    asked = spark.createDataFrame([("q", "load user db"), ("p", "save it")], "qid string, description string")
    scored, own = [], Q._token_scores
    monkeypatch.setattr(Q, "_token_scores", lambda q, t, r: scored.append(t.count()) or own(q, t, r))
    got = [(r["qid"], r["id"], r["score"]) for r in Q.similar_functions(asked, functions, k=3).collect()]
    assert scored == [2, 2]
    first = sorted((f"load_user_{i}", i) for i in range(0, 400, 2))[:3]
    assert sorted(got) == sorted(("q", i, 0.61) for _, i in first)


def test_import_edges_broadcast_no_prefixes(spark, tmp_path):
    """The file's size says little of a row per prefix of its functions' paths."""
    fns = [(f"f{k}", f"src/m{k % 3}.py") for k in range(60)] + [("f0", "src/x.py"), ("f0", "src/x.py"), (None, "src/m0.py"), ("f1", None)]
    spark.createDataFrame(fns, "name string, file string").write.parquet(f"{tmp_path}/f.parquet")
    asked = [("a", ["f0", "f1"], "src/m0"), ("a", ["f0"], "src"), ("a", ["f0"], "src"), ("b", ["f4"], "numpy"), ("b", ["f7", None], None), ("c", ["f5"], "")]
    found = G.import_edges(spark.createDataFrame(asked, "file string, import_names array<string>, resolved string"), spark.read.parquet(f"{tmp_path}/f.parquet"))
    assert "Broadcast" not in plan(found)
    assert sorted(tuple(x) for x in found.collect()) == [("a", "f0", "src/m0.py"), ("a", "f0", "src/x.py"), ("c", "f5", "src/m2.py")]


def test_lines_of_calls_are_dealt_out_once(spark, tmp_path):
    lines = [(1, 1, 7), (1, 1, 7), (1, 2, 8), (1, 2, 9), (1, 3, 8), (2, 1, 7), (2, 2, 8), (2, 3, None), (None, 1, 7), (None, 2, 8), (3, None, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = T.call_pairs(spark, tmp_path)
    assert sorted(tuple(x) for x in pairs.collect()) == [(7, 8), (7, 9), (9, 8)]
    told = plan(T.call_pairs(spark, tmp_path))
    assert "Broadcast" not in told and len(re.findall("Exchange hashpartitioning", told)) == 3  # two sides and the pairs


def test_upstream_trace_shuffles_its_targets(spark, tmp_path):
    fns = [(k, f"validate_{k}" if k % 3 else f"load_{k}", f"{'src' if k % 2 else 'lib'}/m{k % 5}.py") for k in range(40)]
    spark.createDataFrame(fns, "id long, name string, file string").write.parquet(f"{tmp_path}/f.parquet")
    f = spark.read.parquet(f"{tmp_path}/f.parquet")
    calls = [(1, 2), (6, 2), (1, 4), (9, None), (None, 3)]
    imports = [("a.py", "validate_2"), ("a.py", "load_3"), *[("b.py", "load_3")] * 2, ("lib/m1.py", "load_0"), (None, "load_3"), ("c.py", None)]
    made = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            made.add(1)
            yield r

    i = spark.createDataFrame(spark.sparkContext.parallelize(imports, 1).mapPartitions(seen), "importer string, name string")
    out = diagnose.upstream_trace(f, f, spark.createDataFrame(calls, "src long, dst long"), i, f.where("id = 6"))
    assert not re.search(r"BroadcastHashJoin \[(dst|name|id)#", plan(out))
    got = sorted(tuple(x) for x in out.collect() if x.upstream)
    assert got == [(0, "lib/m1.py", True, True), (2, "a.py", True, False), (2, "lib/m1.py", True, True), (2, "src/m1.py", False, False),
                   (3, "a.py", True, False), (3, "b.py", False, True), (4, "src/m1.py", False, False)]
    assert made.value == len(imports)


def test_where_used_broadcasts_no_names(spark, tmp_path, monkeypatch):
    names = ["load_user", "load", "save_users", "x", "\u00e9t\u00e9", "load_user_all", "se"]
    fns = [(k, n, f"m{k}.py", f"{names[(k + 1) % 7]}(); {names[(k + 3) % 7]}()" if k != 3 else None) for k, n in enumerate(names)]
    spark.createDataFrame(fns, "id long, name string, file string, body string").write.parquet(f"{tmp_path}/f.parquet")
    calls, imports = [(0, 1), (2, 1), (None, 2)], [("m9.py", "load"), ("m9.py", "load"), ("m8.py", "none"), (None, "x")]
    want = {(b, "caller", names[a]) for a, b in calls if a is not None} | {(k, "import", i) for i, n in imports for k, m in enumerate(names) if m == n}
    for k, n in enumerate(names):
        want |= {(k, "body", who) for who in sorted(m for by, m, _, body in fns if by != k and body and n in body)[:3]}
    for most in (text.BROADCAST_BYTES, 0):
        monkeypatch.setattr(text, "BROADCAST_BYTES", most)
        got = Q.where_used(
            spark.createDataFrame(calls, "src long, dst long"), spark.createDataFrame(imports, "importer string, name string"),
            spark.read.parquet(f"{tmp_path}/f.parquet"), 3,
        )
        told = plan(got)
        rows = [tuple(x) for x in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert "Broadcast" not in told


def test_texts_send_only_grams_in_use(spark, monkeypatch):
    """Runs of bytes over all borders of chunks, and a table of bits in several parts."""
    monkeypatch.setattr(text, "CHUNK_BYTES", 13)
    r = random.Random(8)
    word = lambda n: "".join(r.choice("ab\u00e9\u20ac\U0001f600") for _ in range(n))
    texts, needles = [word(r.randint(0, 40)).encode() for _ in range(50)], sorted({word(r.randint(1, 9)).encode() for _ in range(40)})
    column = pa.array([*texts, None], pa.binary())
    data, ends = text._bytes_of(column)
    for size in text.GRAM_BYTES:
        got = [(int(a), int(g).to_bytes(8, "little", signed=True)[:size]) for rows, grams in text._grams(data, ends, size) for a, g in zip(rows, grams)]
        assert sorted(got) == sorted((k, t[i : i + size]) for k, t in enumerate(texts) for i in range(len(t) - size + 1))
    filed = [list(b.to_pylist()) for b in text._needle_grams(iter([pa.record_batch([pa.array([n.decode() for n in needles]), pa.array(needles)], names=["n", "b"])]))][0]
    assert {x["_needle"].encode() for x in filed} == set(needles)
    f = spark.createDataFrame([(x["_gram"],) for x in filed], "_gram long")
    for slots in text.SLOTS[:2]:
        bits = text._bits(f, slots)
        asked = text._text_grams([8, 4, 3, 2, 1], slots, type("B", (), {"value": bits}))
        sent = pa.Table.from_batches(asked(iter([pa.record_batch([pa.array(range(51)), column], names=["id", "_gram"])]))).to_pylist()
        sent = [(x["id"], x["_gram"]) for x in sent]
        assert len(sent) == len(set(sent))
        for k, t in enumerate(texts):
            there = {x["_gram"] for x in filed if x["_needle"].encode() in t}
            assert there <= {g for i, g in sent if i == k}
    assert len(sent) < sum(map(len, texts))


def test_cross_file_calls_compute_their_inputs_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(rows):
        for r in rows:
            made.add(1)
            yield r

    fns = [("f", "a", "G() h("), ("g", "b", "f h"), ("h", "b", None), ("k", "a", "kk"), ("g", "a", "g"), ("z", None, "g")]
    imports = [("a", "g", "b"), ("a", "H", "b"), ("a", "k", "a"), ("b", "h", "b"), ("b", "g", None), (None, "g", "b"), ("a", "g", "b")]
    rows = spark.createDataFrame(spark.sparkContext.parallelize(imports, 1).mapPartitions(seen), "importer string, name string, file string")
    got = G.cross_file_calls(spark.createDataFrame(fns, "name string, file string, body string"), rows).collect()
    want = {(n, f, c, cf) for n, f, body in fns for i, c, cf in imports if f and i == f and body and c.lower() in body.lower() and cf and (n, f) != (c, cf)}
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert made.value == len(imports)


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_reach_sizes_take_turns(spark, monkeypatch):
    """Marks of many parts in turns: the same sizes; a turn leaves its sizes only."""
    r = random.Random(3)
    ids = [k * 9_000 for k in range(30)] + list(range(40))
    edges = sorted({(a, b) for a, b in ((r.choice(ids), r.choice(ids)) for _ in range(400)) if a != b} | {(k, 5) for k in ids if k != 5})
    callers = {}
    for a, b in edges:
        callers.setdefault(b, set()).add(a)
    within, sizes, freed, kinds = callers, {}, [], {i: i % 5 * 9_000 for i in ids}
    for _ in range(2):
        within = {i: s.union(*(within.get(c, set()) for c in s)) for i, s in callers.items()}
    sizes = {i: (len(callers[i]), len(s), len({kinds[c] for c in s})) for i, s in within.items()}
    e, real = spark.createDataFrame(edges, "src long, dst long"), A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda df: freed.append((df.columns, spark.conf.get(FREED, "false"))) or real(df))
    marks = spark.createDataFrame([*kinds.items()], "id long, mark long")
    for most, turns in ((4_000_000, 1), (100, min(-(-len(edges) // 100), 30)), (1, 30)):
        monkeypatch.setattr(A, "TURN_EDGES", most)
        freed.clear()
        got = {x.id: (x.direct, x.n, x.kinds) for x in A.reach_sizes(e, 3, {"n": None, "kinds": marks}).collect()}
        assert got == sizes
        assert sum(c == ["id", "tag", "n"] for c, _ in freed) >= turns > 0 and {f for _, f in freed} == {"true"}
    assert spark.conf.get(FREED, "false") == "false"


def test_betweenness_frees_what_a_round_shuffles(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(5)] + [(0, 9), (9, 2)], "src long, dst long")
    freed, real = [], A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda df: freed.append((df.columns, spark.conf.get(FREED, "false"))) or real(df))
    got = {x.id: round(x.centrality * 30) for x in A.betweenness(edges).collect()}
    assert got == {0: 0, 1: 2, 9: 2, 2: 9, 3: 8, 4: 5, 5: 0}
    assert len(freed) > 12 and [f for _, f in freed].count("false") == 2  # the sources and the hubs


def test_shortest_paths_free_what_a_step_shuffles(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 3), (1, 2), (2, 4), (3, 4), (4, 1), (4, 5), (None, 6)], "src long, dst long")
    freed, real = [], A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda df: freed.append(spark.conf.get(FREED, "false")) or real(df))
    found = A.shortest_paths(edges, spark.createDataFrame([(1, 5), (1, 4), (1, 9)], "start long, goal long"))
    assert sorted((x.goal, x.path, x.hops) for x in found.collect()) == [(4, [1, 2, 4], 2), (5, [1, 2, 4, 5], 3)]
    assert freed == ["true"] * 5 and spark.conf.get(FREED, "false") == "false"


def test_listed_marks_are_added_and_packed_at_once(monkeypatch):
    """Lists and bitmaps of one block, in any mix and in pieces of few pairs, as sets of Python."""
    rng, codec, size = np.random.default_rng(5), pa.Codec("zstd", compression_level=1), 1 << A.MARK_BITS
    marks = [np.sort(rng.choice(size, k, replace=False)) for k in (1, 3, 64, 65, 300, 2, 1, 64, 5000, 7)]
    rows = np.stack([np.packbits(np.isin(np.arange(size), m)) for m in marks])
    n = np.array([len(m) for m in marks])
    bits = A._packed(rows, n, codec)
    assert [len(b) for b, m in zip(bits, marks) if len(m) <= A.LISTED] == [2 * len(m) for m in marks if len(m) <= A.LISTED]
    heads = [(4, 0, 1)] * 6 + [(4, 1, 1)] * 3 + [(5, 0, 1)]
    ats = [np.sort(rng.choice(60, k, replace=False)).astype(np.int32) for k in (5, 60, 1, 30, 2, 9, 9, 9, 3, 4)]
    want = {}
    for (block, tag, part), m, at in zip(heads, marks, ats):
        for x in at:
            want.setdefault(((block << A.BLOCK_BITS) + int(x), tag, part), set()).update(m.tolist())
    columns = [*zip(*heads)]
    batch = pa.record_batch(
        [pa.array(columns[0]), pa.array(columns[1], pa.int32()), pa.array(columns[2]), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.array(ats, pa.list_(pa.int32()))],
        names=["block", "tag", "part", "n", "bits", "ats"],
    )
    for pairs in (1 << 20, 7):
        monkeypatch.setattr(A, "PAIRS", pairs)
        for cut in (10, 4, 1):
            parts = [batch.slice(k, cut) for k in range(0, 10, cut)]
            got = pa.Table.from_batches(A._united(True)(iter(parts))).to_pylist()
            assert {(x["id"], x["tag"], x["part"]): x["n"] for x in got} == {k: len(v) for k, v in want.items()}
            for x in got:
                mine = np.frombuffer(x["bits"], ">u2") if x["n"] <= A.LISTED else np.flatnonzero(np.unpackbits(A._unpacked(x["bits"], codec)))
                assert set(mine.tolist()) == want[x["id"], x["tag"], x["part"]]
