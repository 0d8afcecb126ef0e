import random

from pyspark.sql import functions as F

from opsweave.functions import ordered as O
from opsweave.functions.text import contains_join
from opsweave.operators.metrics import nth_value


def rows(n=400, seed=3):
    r = random.Random(seed)
    # one key holds most rows; times are out of order and repeat
    return [(i, "hot" if r.random() < 0.7 else f"k{r.randint(0, 4)}", float(r.randint(0, 20000)), r.randint(0, 9)) for i in range(n)]


def frame(spark, data):
    return spark.createDataFrame(data, "id int, key string, t double, v int").repartition(5)


def test_previous_running_sum_and_last_known(spark):
    data = rows()
    df = frame(spark, data)
    prev = {r.id: r.prev_v for r in O.with_previous(df, ["key"], "t", ["v"], tie=["id"], chunk_seconds=500).collect()}
    run = {r.id: r.s for r in O.with_running_sum(df, ["key"], "t", {"s": F.col("v")}, tie=["id"], chunk_seconds=500).collect()}
    sparse = df.withColumn("x", F.when(F.col("v") > 6, F.col("v")))
    last = {r.id: r.last_x for r in O.with_last_known(sparse, ["key"], "t", ["x"], tie=["id"], chunk_seconds=500).collect()}
    for key in {d[1] for d in data}:
        mine = sorted((d for d in data if d[1] == key), key=lambda d: (d[2], d[0]))
        total, before, known = 0, None, None
        for i, _, _, v in mine:
            total += v
            known = v if v > 6 else known
            assert prev[i] == before and run[i] == total and last[i] == known
            before = v


def test_recent_window(spark):
    data = rows()
    got = {r.id: (r.n, r.m) for r in O.over_recent(frame(spark, data), ["key"], "t", 300, {"n": F.count("*"), "m": F.min("v")}).collect()}
    for i, k, t, _ in data:
        near = [d for d in data if d[1] == k and t - 300 <= d[2] <= t]
        assert got[i] == (len(near), min(d[3] for d in near))
    strict = {r.id: r.n for r in O.over_recent(frame(spark, data), ["key"], "t", 300, {"n": F.count("*")}, include_self=False).collect()}
    for i, k, t, _ in data:
        assert strict[i] == sum(d[1] == k and t - 300 <= d[2] < t for d in data)


def test_interval_pairs(spark):
    a, b = rows(150, 1), rows(150, 2)
    left = frame(spark, a)
    right = frame(spark, b).select(F.col("id").alias("rid"), F.col("key").alias("rkey"), F.col("t").alias("rt"))
    got = {(r.id, r.rid) for r in O.interval_pairs(left, right, [("key", "rkey")], "t", "rt", 120, 10).collect()}
    assert got == {(x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] - 120 <= y[2] <= x[2] + 10}


def test_row_index_and_top_k(spark):
    data = rows()
    got = {r.id: r.row_index for r in O.with_row_index(frame(spark, data), ["t", "id"]).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [d[0] for d in sorted(data, key=lambda d: (d[2], d[0]))]
    assert sorted(got.values()) == list(range(len(data)))
    top = O.top_k(frame(spark, data), ["key"], [F.desc("v"), F.col("id")], 3).collect()
    for key in {d[1] for d in data}:
        want = sorted((-d[3], d[0]) for d in data if d[1] == key)[:3]
        assert sorted((-r.v, r.id) for r in top if r.key == key) == want


def test_exact_quantile(spark):
    data = rows()
    got = {r.key: r.t for r in nth_value(frame(spark, data), ["key"], "t", 0.95, 100.0).collect()}
    for key, value in got.items():
        mine = sorted(d[2] for d in data if d[1] == key)
        assert value == mine[int(len(mine) * 0.95)]


def test_substring_join(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abé ") for _ in range(r.randint(0, 30))) for _ in range(60)]
    needles = sorted({"".join(r.choice("abé") for _ in range(r.randint(1, 6))) for _ in range(40)})
    t = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id int, text string")
    n = spark.createDataFrame([(x,) for x in needles], "needle string")
    got = sorted((x.id, x.needle) for x in contains_join(t, "text", n, "needle", min_length=1).collect())
    assert got == sorted((i, y) for i, x in enumerate(texts) for y in needles if y in x)
    long = sorted((x.id, x.needle) for x in contains_join(t, "text", n, "needle").collect())
    assert long == [(i, y) for i, y in got if len(y) >= 4]


def test_recent_counts_and_first_rows_of_a_hot_key(spark):
    """One key holds every row; ranges cut it, so no task holds its window."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"  # small inputs would become one range
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        _recent_of_a_hot_key(spark)
    finally:
        spark.conf.set(name, before)


def _recent_of_a_hot_key(spark):
    data = rows(600) + [(600 + i, None, float(50 * i), i) for i in range(30)] + [(700 + i, "hot", 9000.0, i) for i in range(40)]
    for df, mine in ((frame(spark, data), data), (frame(spark, [(i, "one", t, v) for i, _, t, v in data]), [(i, "one", t, v) for i, _, t, v in data])):
        n = {r.id: r.n for r in O.count_recent(df, ["key"], "t", 300, "n").collect()}
        first = {r.id: r.f for r in O.first_recent(df, ["key"], "t", 300, "v", "id", "f").collect()}
        for i, k, t, _ in mine:
            same = [(u, j, v) for j, q, u, v in mine if q == k and t - 300 <= u <= t]
            assert n[i] == sum(u < t for u, _, _ in same) and first[i] == min(same)[2]
    marks = O._instants(df, ["key"], "t", 300, F.count("*"))[1]
    sizes = [r["count"] for r in O._ranges(marks, [F.col("key"), F.col("_pos"), F.col("_kind")]).groupBy("_p").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 0.5 * sum(sizes)
    empty = O.count_recent(df.where("id < 0"), ["key"], "t", 300, "n")
    assert empty.count() == 0 and O.first_recent(df.withColumn("t", F.lit(None).cast("double")), ["key"], "t", 300, "v", "id", "f").where("f is null").count() == len(mine)
