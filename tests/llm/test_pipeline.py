import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from opsweave.llm import decontaminate, mixing, ngram_join, queries, secrets, toxicity
from opsweave.llm.common import load
from tests.compare import compare, duck
from tests.llm.conftest import SF
from tests.llm.test_ngram_join import brute


def test_stages_against_plain_python(spark, docs):
    rows = [r.asDict() for r in docs.collect()]
    score = toxicity.scorer(chain := toxicity.fit(docs, load(spark, SF, "labels")))
    at = toxicity.CHAIN.index("toxic")
    rows = [r for r in rows if score(r["text"])[0][at] < chain.thresholds[at]]
    link = brute([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    rows = [r for r in rows if link[r["doc_id"]][1] == r["doc_id"]]
    index = decontaminate.Index([(r["item_id"], r["text"]) for r in load(spark, SF, "benchmark").collect()])
    bad = {x[0] for x in index.find([r["text"] for r in rows])}
    rows = [r for i, r in enumerate(rows) if i not in bad]
    for r in rows:
        if (clean := secrets.redact(r["text"])) != r["text"]:
            r |= {"text": clean, "n_chars": len(clean)}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(r["doc_id"], r["text"], r["source"]) for r in rows])
    mixed = {d: (n, c, s) for d, _, _, _, n, c, s in con.execute(mixing.SQL).fetchall() if n}
    want = {r["doc_id"]: (r["text"], r["n_chars"], *mixed[r["doc_id"]]) for r in rows if r["doc_id"] in mixed}
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["taken"], r["copies"], r["starts_at"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and len(got) < docs.count()


def test_stages_on_edge_rows(spark, frame, edge_rows, tmp_path):
    for rows in (edge_rows, []):
        docs = frame(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            docs = out
        assert set(docs.columns) - {"taken"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, SF).columns)
    assert ngram_join.keep_one(frame([])).count() == 0


def test_entry_lists_everything():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(queries.SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    class Entry:
        run, sql = staticmethod(queries.QUERIES[name]), queries.SQL[name]

    ok, message = compare(Entry, spark, SF, duck(SF))
    assert ok, message
