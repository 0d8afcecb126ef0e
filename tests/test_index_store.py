"""The maintained code index against a full rebuild and against plain Python."""

import random

from pyspark.sql import functions as F

from opsweave.operators import codegraph as G
from opsweave.operators import index_store as X

ENT = "repo string, kind string, name string, file string, line int"
SITES = "repo string, caller_name string, caller_file string, callee_name string"


def parse(rng, repo, file, names=12):
    """A made-up parse of one file."""
    pool = [f"n{i}" for i in range(names)]
    ents = [(repo, rng.choice(["function", "function", "import"]), n, file, rng.randrange(99)) for n in rng.sample(pool, rng.randrange(4))]
    sites = [(repo, rng.choice(pool), file, rng.choice(pool)) for _ in range(rng.randrange(5))]
    return ents, sites


def frames(spark, files):
    ents = [e for f in files.values() for e in f[0]]
    sites = [s for f in files.values() for s in f[1]]
    return spark.createDataFrame(ents, ENT), spark.createDataFrame(sites, SITES)


def plain_edges(files):
    """Edges by plain Python, repository by repository."""
    out = set()
    for repo in {r for r, _ in files}:
        ents = [e for k, f in files.items() if k[0] == repo for e in f[0] if e[1] == "function"]
        sites = [s for k, f in files.items() if k[0] == repo for s in f[1]]
        own, first = {(e[2], e[3]) for e in ents}, {}
        for _, name, file, _ in sites:
            first[name] = min(first.get(name, file), file)
        defined = {}
        for _, _, name, file, line in ents:
            defined[name] = min(defined.get(name, (file, line)), (file, line))
        first.update({n: f for n, (f, _) in defined.items()})
        for _, name, file, callee in sites:
            src, dst = file if (name, file) in own else first[name], first.get(callee, "")
            if (name, src) != (callee, dst):
                out.add((repo, name, src, callee, dst))
    return out


def stored_edges(spark, root):
    return {(r.repo, r.src_name, r.src_file, r.dst_name, r.dst_file) for r in X.call_edges(spark, root).collect()}


def rows(spark, root, table):
    return sorted(map(str, X.read(spark, root, table).collect()))


def test_change_sets_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(5)
    files = {(repo, f"src/f{i}.py"): parse(rng, repo, f"src/f{i}.py") for repo in ("a", "007") for i in range(12)}
    live = str(tmp_path / "live")
    X.build(live, *frames(spark, files), buckets=4)
    assert stored_edges(spark, live) == plain_edges(files)
    for step in range(2):
        chosen = rng.sample(sorted(files), 3) + [("a", f"src/new{step}.py")]
        fresh = {k: parse(rng, *k) for k in chosen[1:]}  # the first one is deleted
        del files[chosen[0]]
        files.update(fresh)
        changed = spark.createDataFrame(chosen + [chosen[1], ("a", None)], "repo string, file string")
        X.apply_changes(live, changed, *frames(spark, fresh), buckets=4)
        assert stored_edges(spark, live) == plain_edges(files)
    whole = str(tmp_path / "whole")
    X.build(whole, *frames(spark, files), buckets=4)
    for table in X.TABLES:
        assert rows(spark, live, table) == rows(spark, whole, table)
    # the same change set again, and a repository taken out
    X.apply_changes(live, changed, *frames(spark, fresh), buckets=4)
    assert rows(spark, live, "edges") == rows(spark, whole, "edges")
    X.drop_repos(live, spark.createDataFrame([("007",)], "repo string"), buckets=4)
    assert stored_edges(spark, live) == plain_edges({k: f for k, f in files.items() if k[0] == "a"})
    assert X.read(spark, live, "names").where("repo = '007'").count() == 0


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    files = {("r", f"f{i}.py"): ([("r", "function", f"g{i}", f"f{i}.py", 1)], [("r", f"g{i}", f"f{i}.py", f"g{(i + 1) % 40}")]) for i in range(40)}
    root = str(tmp_path / "x")
    X.build(root, *frames(spark, files), buckets=32)

    def listed():
        return {p: p.stat().st_mtime_ns for p in tmp_path.glob("x/*/part=*/*.parquet")}

    before = listed()
    fresh = {("r", "f7.py"): ([("r", "function", "moved", "f7.py", 3)], [])}
    got = X.apply_changes(root, spark.createDataFrame([("r", "f7.py")], "repo string, file string"), *frames(spark, fresh), buckets=32)
    files.update(fresh)
    assert stored_edges(spark, root) == plain_edges(files)
    after = listed()
    rewritten = {p.parts[-3:-1] for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    assert rewritten == {(t, f"part={p}") for t, parts in got.items() for p in parts}
    assert len(got["entities"]) == 1 and len(got["edges"]) <= 2 and len(got["names"]) <= 3


def test_interrupted_change_is_repaired(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    files = {("r", f"f{i}.py"): parse(rng, "r", f"f{i}.py", 8) for i in range(10)}
    fresh = {("r", f"f{i}.py"): parse(rng, "r", f"f{i}.py", 8) for i in range(3)}
    changed = spark.createDataFrame(list(fresh), "repo string, file string")
    write = X._write
    for stop in ("names", "sites", "entities"):
        root = str(tmp_path / stop)
        X.build(root, *frames(spark, files), buckets=4)

        def failing(table, *args, stop=stop):
            if table == stop:
                raise OSError("lost")
            write(table, *args)

        monkeypatch.setattr(X, "_write", failing)
        try:
            X.apply_changes(root, changed, *frames(spark, fresh), buckets=4)
        except OSError:
            pass
        monkeypatch.setattr(X, "_write", write)
        X.apply_changes(root, changed, *frames(spark, fresh), buckets=4)
        assert stored_edges(spark, root) == plain_edges({**files, **fresh})
        assert X.read(spark, root, "entities").count() == sum(len(f[0]) for f in {**files, **fresh}.values())


def test_edges_and_empty_tables(spark, tmp_path):
    root = str(tmp_path / "e")
    X.build(root, *frames(spark, {}), buckets=2)
    assert stored_edges(spark, root) == set()
    none = spark.createDataFrame([], "repo string, file string")
    assert X.apply_changes(root, none, *frames(spark, {}), buckets=2) == {t: [] for t in X.TABLES}
    bad = {("r", "a"): ([("r", "function", None, "a", 1), (None, "function", "f", "a", 1)], [("r", "f", "a", None)])}
    fresh = {("r", "a"): ([("r", "function", "f", "a", None)] * 2, [("r", "f", "a", "g")] * 2)}
    changed = spark.createDataFrame([("r", "a")], "repo string, file string")
    X.apply_changes(root, changed, *frames(spark, bad), buckets=2)
    assert X.read(spark, root, "names").count() == 0
    X.apply_changes(root, changed, *frames(spark, fresh), buckets=2)
    assert stored_edges(spark, root) == {("r", "f", "a", "g", "")}


def test_same_edges_as_the_whole_graph(spark, tmp_path):
    rng = random.Random(3)
    files = {("r", f"f{i}.py"): parse(rng, "r", f"f{i}.py") for i in range(15)}
    ents, sites = frames(spark, files)
    X.build(str(tmp_path / "g"), ents, sites, buckets=3)
    want = {("r", *e) for e in map(tuple, G.build_graph(ents, sites)[1].select("src_name", "src_file", "dst_name", "dst_file").collect())}
    assert stored_edges(spark, str(tmp_path / "g")) == want
    assert X.call_edges(spark, str(tmp_path / "g")).where(F.col("repo").isNull()).count() == 0
