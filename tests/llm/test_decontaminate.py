import random

import numpy as np

from opsweave.llm import decontaminate, queries
from opsweave.llm.common import load
from opsweave.llm.decontaminate import Index, allowed_edits, distance, words_of
from tests.llm.conftest import SF


def brute_distance(item, text):
    """Least edit distance of the item to any stretch of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (v != w)))
        row = new
    return min(row)


def test_distance():
    rng = random.Random(0)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randint(1, 9))]
        b = [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        assert distance(np.array(a), np.array(b, dtype=np.int64))[0] == brute_distance(a, b)


def test_query_against_brute_force(spark, docs):
    items = {r["item_id"]: words_of(r["text"]) for r in load(spark, SF, "benchmark").collect()}
    want = set()
    for d, t in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        words, held = words_of(t), set(words_of(t))
        for i, item in items.items():
            # an item can only be near if all but its allowed edits' words occur
            if sum(w not in held for w in item) <= allowed_edits(len(item)) and brute_distance(item, words) <= allowed_edits(len(item)):
                want.add((d, i))
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op8_decontaminate"](spark, SF).collect()}
    assert want and got == want


def test_recall_of_edited_copies(spark):
    rng = random.Random(8)
    items = [(r["item_id"], r["text"]) for r in load(spark, SF, "benchmark").collect()]
    index, texts, want = Index(items), [], []
    for k in range(400):
        key, text = items[k % len(items)]
        words = text.split()
        for _ in range(allowed_edits(len(words_of(text)))):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 2)] = [] if kind == 0 else [f"zq{rng.randrange(99)}"]
        around = [f"p{rng.randrange(999)}" for _ in range(rng.randrange(60))]
        texts.append(" ".join(around + words + around))
        want.append(key)
    got = [set() for _ in texts]
    for d, key, *_ in index.find(texts):
        got[d].add(key)
    assert np.mean([w in g for w, g in zip(want, got)]) >= 0.97


def test_sizes_beyond_the_most_repetitions_are_exact():
    """Long items with all allowed edits, whose target the lookup cannot reach, against the plain table."""
    rng = random.Random(4)
    items = [(k, " ".join(f"i{rng.randrange(5000)}" for _ in range(n))) for k, n in enumerate((30, 30, 60, 400, 400, 2500))]
    index = Index(items, most=0)
    assert set(index.repetitions.values()) == {None} and not index.buckets
    texts = []
    for key, text in items[:5] * 3:
        words = text.split()
        for _ in range(allowed_edits(len(words)) + rng.randrange(2)):
            at, kind = rng.randrange(len(words)), rng.randrange(3)
            words[at : at + (kind != 2)] = [] if kind == 0 else [f"zq{rng.randrange(99)}"]
        texts.append(" ".join([f"p{rng.randrange(99)}" for _ in range(20)] + words + ["tail"] * 9))
    want = set()
    for d, t in enumerate(texts):
        for key, item in items[:5]:
            if brute_distance(words_of(item), words_of(t)) <= allowed_edits(len(words_of(item))):
                want.add((d, key))
    assert len(want) >= 8 and {(d, key) for d, key, *_ in index.find(texts)} == want
    sizes = Index(items).repetitions
    assert sizes.keys() == {30, 60, 400, 2500} and all(r is None or 16 <= r <= 256 for r in sizes.values())


def test_slices_give_the_same(spark, docs):
    bench = load(spark, SF, "benchmark")
    whole = sorted(map(tuple, decontaminate.find(docs, bench).collect()))
    assert sorted(map(tuple, decontaminate.find(docs, bench, slice_chars=1500).collect())) == whole
    kept = {r["doc_id"] for r in decontaminate.keep_clean(docs, bench, slice_chars=1500).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {w[0] for w in whole}


def test_edges(spark, frame, edge_rows):
    schema = "item_id long, text string, doc_id int, edits int"
    items = [(1, None, 0, 0), (2, "", 0, 0), (3, "one two", 0, 0), (4, "one two", 0, 0), (5, "ONE, two three four five six", 0, 0)]
    bench = spark.createDataFrame(items, schema)
    texts = [(40, "x One -- two y", "a"), (41, "zero one two three four five six", "a"), (42, "one two three, five six", "a")]
    docs = frame(edge_rows + texts)
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.find(docs, bench).collect())
    pairs = [(d, i, 0) for d in (5, 6, 40, 41, 42) for i in (3, 4)]
    assert got == sorted([*pairs, (41, 5, 0), (42, 5, 1)])
    assert decontaminate.keep_clean(docs, bench).count() == len(edge_rows) - 2
    assert decontaminate.keep_clean(docs, bench).columns == docs.columns
    for empty in (spark.createDataFrame([], schema), spark.createDataFrame(items[:2], schema)):
        assert decontaminate.find(docs, empty).count() == 0 and decontaminate.keep_clean(docs, empty).count() == docs.count()
    assert decontaminate.find(frame([]), bench).count() == 0
