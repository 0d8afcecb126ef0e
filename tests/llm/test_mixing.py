import random

from opsweave.llm import mixing


def fill(sizes):
    """Shares by weight, again and again: what is above a source's most goes to the others."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        for s in full or open_:
            target[s] = 3.0 * sizes[s] if full else level * weight[s]
        left -= sum(3 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    return target


def test_targets_fill_like_repeated_sharing(spark):
    rng = random.Random(1)
    for n in (1, 2, 7, 20):
        sizes = {f"s{i}": rng.choice((0, 1, 5, 90, 1000)) for i in range(n)} | {None: 3}
        df = spark.createDataFrame([(s, k) for s, k in sizes.items()], "source string, size long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = fill(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_taken_meets_targets(spark, docs):
    got = mixing.mix(docs).collect()
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
    assert all(abs(n - t) < 1 for n, t in by.values())
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"], r["dup"])
    assert sorted(got, key=key) == sorted(again, key=key)
    order = sorted((r["starts_at"], r["taken"]) for r in got if r["taken"])
    assert order[0][0] == 0 and len({a for a, _ in order}) == len(order)


def test_edges(frame, edge_rows):
    got = mixing.digest(mixing.mix(frame(edge_rows))).collect()
    assert len(got) == len(edge_rows)
    assert all(r["taken"] == 0 and r["starts_at"] is None for r in got if not r["size"])
    out = mixing.apply(frame(edge_rows))
    assert out.columns == [c for c in frame([]).columns if c != "taken"] + ["taken", "copies", "starts_at"]
    rows = out.collect()
    assert sum(r["taken"] for r in rows) == sum(r["taken"] for r in got) and sum(r["doc_id"] == 4 for r in rows) == 2
    assert {r["_nr"] for r in rows} == {9} and {r["size"] for r in rows} == {"y"}
    assert mixing.mix(frame([])).count() == 0 and mixing.apply(frame([])).count() == 0
    assert mixing.mix(frame([(1, None, "a"), (2, "", "b")])).where("taken > 0").count() == 0


def test_plan_is_short(spark):
    """The driver holds a plan as a whole: steps are written one after another."""
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * i) for i in range(20)], "doc_id long, source string, text string")
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 4
