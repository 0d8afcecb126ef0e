import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from opsweave.llm import merkle as M
from opsweave.llm.common import load
from tests.compare import duck, rows_of


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, k):
    """The top of a list of digests, and for each the siblings (left, right) of every level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for p, i in zip(paths, at):
            run = level[i // k * k : i // k * k + k]
            p.append(("".join(run[: i % k]), "".join(run[i % k + 1 :])))
        level, at = [h("".join(level[i : i + k])) for i in range(0, len(level), k)], [i // k for i in at]
    return level[0], paths


def brute(rows, k=8):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf_of(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = []
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        tops.append(climb([x[1] for x in groups[g]], k))
    root, above = climb([t[0] for t in tops], k)
    out = []
    for g, (subroot, paths), up in zip(order, tops, above):
        for (i, leaf, r), path in zip(groups[g], paths):
            now = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and r[4] is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4])
                now = leaf_of((*r[:4], text))
            for left, right in path + up:
                now = h(left + now + right)
            proof = h("".join(a + b for a, b in path + up))
            out.append((i, leaf, subroot, root, proof, now, now == root))
    return out


def key(rows):
    return sorted([tuple(r) for r in rows], key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r)))


def test_whole_table_and_sql(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = M.digest(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = key(got.collect())
    assert got == key(brute(rows))
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2
    cur = duck("/root/testdata/sf0.001").execute(M.SQL)
    names, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert rows_of(["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"], got) == (names, want)


@pytest.mark.parametrize("sizes", [[1], [9], [65, 1, 8], [3] * 9 + [1]])
def test_shapes(spark, sizes):
    rows = [(100 * g + i, f"s{i % 2}", f"l{g}", i, f"Text {g} {i}") for g, n in enumerate(sizes) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert key(M.digest(table).collect()) == key(brute(rows))


@pytest.mark.parametrize("k", [2])
def test_fan_out(spark, docs, k):
    some = docs.where("doc_id < 70")
    rows = [tuple(r) for r in some.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    found = M.manifest(some, fan_out=k).withColumn("folded", M.folded(F.col("leaf"), F.col("proof")))
    got = found.select("id", M.hexed(F.col("subroot")), M.hexed(F.col("root")), M.proof_digest(F.col("proof")), M.hexed(F.col("folded")))
    want = [(r[0], r[2], r[3], r[4], r[3]) for r in brute(rows, k)]
    assert key(got.collect()) == key(want)


def test_edges(spark, frame, edge_rows):
    """Null ids, texts, sources and groups; repeated rows; clashing names."""
    rows = [(r[0], r[2], None, None, r[1]) for r in edge_rows]
    assert key(M.digest(frame(edge_rows)).collect()) == key(brute(rows))
    assert M.digest(frame([])).collect() == []
    many = frame([(None, "Same", "a")] * 40 + [(1, "Other", "b")])
    assert key(M.digest(many).collect()) == key(brute([(None, "a", None, None, "Same")] * 40 + [(1, "b", None, None, "Other")]))


def test_a_changed_row_is_found(spark):
    docs = load(spark, "/root/testdata/sf0.001", "documents")
    found = M.manifest(docs).where("id = 7").collect()[0]
    assert found["root"] is not None and len(found["leaf"]) == 32
