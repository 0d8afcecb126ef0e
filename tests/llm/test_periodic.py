import hashlib
import random
import zlib

import numpy as np
import pytest

from opsweave.llm import periodic as P


def brute(words, min_words=24, min_repeats=3):
    """All runs of all periods by comparing words, smallest periods only."""
    n, found = len(words), {}
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_words, min_repeats * q):
                found.setdefault((i, j + q), q)  # the smallest comes first
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def texts(seed, many=60):
    rng = random.Random(seed)
    out = [["a"] * k for k in (23, 24, 25, 300)] + [["a", "b"] * 12, ["a", "b"] * 11 + ["a"], ["a", "b"] * 200 + ["c"] + ["a", "b"] * 200]
    for _ in range(many):
        words = []
        while len(words) < rng.randint(10, 700):
            root = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, rng.choice((4, 20, 120))))]
            part = root * rng.randint(1, 6) + root[: rng.randint(0, len(root))]
            words += part + [rng.choice("abxyz") for _ in range(rng.randint(0, 3))]
        out.append(words)
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    out += [[str(x) for x in thue], [str(x) for x in (thue[:65] * 7)[:400]], [str(x) for x in thue[:128]] * 4]
    fib = ["a", "b"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    return out + [list(fib[-1])]


def test_fragments_of_batches_equal_brute_force():
    own = texts(1)
    known = {}
    codes = [np.array([known.setdefault(w, len(known)) for w in t], dtype=np.int64) for t in own]
    for t, found in zip(own, P._fragments(codes, 24, 3)):
        assert sorted((lo, hi + q - lo, q) for q, lo, hi in found) == brute(t)


@pytest.mark.parametrize("min_words,min_repeats", [(24, 3), (8, 3), (60, 5)])
def test_pieces_stitch_to_the_same(spark, min_words, min_repeats):
    own = texts(min_words, 25)
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(own)], "doc_id long, text string")
    for piece in (40, 1 << 17):
        got = {r.doc_id: [tuple(x) for x in r.runs] for r in P.find(table, min_words=min_words, min_repeats=min_repeats, piece=piece).collect()}
        assert got == {k: brute(t, min_words, min_repeats) for k, t in enumerate(own)}


def want_of(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    left = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(), hashlib.sha256(left).hexdigest(),
    )


def test_whole_table(spark, docs):
    got = P.digest(docs)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = sorted(want_of(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = sorted(map(tuple, got.collect()))
    assert got == want
    assert sum(r[1] > 0 for r in got) >= 10


def test_edges(spark, frame, edge_rows):
    rows = edge_rows + [(11, "x " * 30, "a"), (None, "y z " * 30, None), (12, "É é " * 40 + "\x85", "a")]
    got = P.digest(frame(rows)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted((want_of(r[0], r[1]) for r in rows), key=key)
    assert P.digest(frame([])).collect() == []


def test_a_long_text_is_dealt_out(spark):
    """300,000 words, a run of period 70,000 over most of them and one of period 3 inside."""
    root = [f"w{i}" for i in range(70_000)]
    root[100:400] = ["p", "q", "r"] * 100
    words = (root * 5)[:290_000] + ["end"] * 24
    table = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    got = [tuple(x) for x in P.find(table, piece=1 << 15).collect()[0].runs]
    small = [(70_000 * k + 100, 300, 3) for k in range(5) if 70_000 * k + 400 <= 290_000]
    assert got == sorted([(0, 290_000, 70_000), (290_000, 24, 1), *small])
