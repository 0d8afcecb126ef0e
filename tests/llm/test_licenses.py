import random
import re

from opsweave.llm import licenses, queries
from tests.llm.conftest import SF


def brute(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places = [
        (i, label) for i in range(len(words)) for p, label in licenses.PHRASES if words[i : i + len(p.split())] == p.split()
    ]
    return len(words), sorted(places)


def test_query_against_brute_force(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_license_scan"](spark, SF).collect()}
    for d, t in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        n, places = brute(t)
        starts = [i for i, _ in places]
        assert (got[d]["n_words"], got[d]["n_base"]) == (n, len(places))
        assert (got[d]["first_word"], got[d]["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert got[d]["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert {x for _, x in places} <= set(got[d]["labels"].split(",")) and 0 <= got[d]["score"] <= 1


def test_templates(frame):
    rows = [
        (1, "Licensed under CC BY-NC 4.0.", "a"), (2, "licensed under the Apache License, Version 2.0", "a"),
        (3, "This work is licensed under the GNU General Public License, version 3.", "a"), (4, "licence to sing", "a"),
        (5, "Licensed, as agreed, under the Apache License -- Version 2.0", "a"), (6, "mit license MIT LICENSE, MIT\nLicense", "a"),
    ]
    got = {r["doc_id"]: r for r in licenses.digest(licenses.scan(frame(rows))).collect()}
    assert got[1]["labels"] == "cc-by-nc" and got[1]["n_base"] == 0 and got[1]["score"] == 1.0
    assert got[2]["labels"] == got[5]["labels"] == "apache,apache-2.0"
    assert got[3]["labels"] == "gpl,gpl-3.0" and got[4]["labels"] == "" and got[4]["score"] == 0
    assert (got[6]["n_base"], got[6]["first_word"], got[6]["last_word"]) == (3, 0, 4)


def test_edges(frame, edge_rows):
    rows = licenses.digest(licenses.scan(frame(edge_rows))).collect()
    assert len(rows) == len(edge_rows) and {r["labels"] for r in rows} == {""}
    assert max(r["n_words"] for r in rows) == 30_001
    assert licenses.scan(frame([])).count() == 0


def all_starts(words, index, needed):
    """Every template at every start that one of its anchors gives, word by word, without postings or bounds."""
    found = {}
    for k, notice in enumerate(index.notices):
        if not all(w in words for p in index.must[k] for w in p):
            continue
        rare = sorted({w for w in notice if w in words}, key=lambda w: (-index.idf[w], w))[: index.anchors]
        for start in range(-len(notice), len(words)):
            if not any(x in rare and 0 <= start + q < len(words) and words[start + q] == x for q, x in enumerate(notice)):
                continue
            near = [words[max(0, start + q - licenses.SLACK) : max(0, start + q + licenses.SLACK + 1)] for q in range(len(notice))]
            score = sum(index.idf[w] for w, part in zip(notice, near, strict=True) if w in part) / index.totals[k]
            lo, hi = max(0, start - licenses.SLACK), min(len(words), start + len(notice) + licenses.SLACK)
            stands = [any(words[i : i + len(p)] == p for i in range(lo, hi - len(p) + 1)) for p in index.must[k]]
            if score >= needed and all(stands):
                key = (index.labels[k], max(0, start))
                found[key] = max(found.get(key, (0.0, 0)), (round(score, 6), hi))
    return [(label, s, a, b) for (label, a), (s, b) in sorted(found.items())]


def test_matches_against_all_starts():
    r = random.Random(7)
    vocabulary = sorted(licenses.vocabulary())
    seen = set()
    for trial in range(150):
        index = licenses.Index({w: r.choice([1.0, 1.5, 3.0, 6.0]) + r.random() for w in vocabulary})
        words = []
        for _ in range(r.randint(1, 4)):
            words += [r.choice([*vocabulary, b"filler"]) for _ in range(r.randint(0, 12))]
            for w in r.choice(index.notices):
                if r.random() > 0.06:
                    words.append(w)
                if r.random() < 0.04:
                    words.append(b"inserted")
        got = licenses.matches(words, index)
        assert got == all_starts(words, index, licenses.NEEDED)
        seen |= {label for label, *_ in got}
    assert seen == {label for label, *_ in licenses.TEMPLATES}


def test_votes_come_from_the_rarest_words_of_the_file():
    index = licenses.Index({w: 1.0 + i for i, w in enumerate(sorted(licenses.vocabulary()))})
    words = [b"x"] * 5 + index.notices[0] + [b"y"]
    by = licenses.votes(index, licenses._places(words, index))[0]
    assert sorted(by) == sorted(sorted(set(index.notices[0]), key=lambda w: -index.idf[w])[: licenses.ANCHORS])
    assert all(5 in at for at in by.values()) and licenses.candidates(index, 0, by, licenses._places(words, index), 0.8) == [5]


def test_phrase_without_its_notice(frame):
    rows = licenses.digest(licenses.scan(frame([(1, "an mit license perhaps", "a"), (2, "released under the mit license", "a"), (3, "", "a")])))
    got = {r["doc_id"]: r for r in rows.collect()}
    assert got[1]["labels"] == "mit" and 0 < got[1]["score"] < licenses.NEEDED and got[2]["score"] == 1.0 and got[3]["score"] == 0
