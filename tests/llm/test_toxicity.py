import numpy as np
import pytest

from opsweave.llm import queries, toxicity
from opsweave.llm.common import load
from tests.llm.conftest import SF

LABELS = "doc_id long, quality int, toxic int, p_toxic int, id string"


@pytest.fixture(scope="module")
def held_out(spark):
    """A chain fitted without every fourth labelled document, and the labels left out."""
    sf = "/root/testdata/sf0.01"
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    chain = toxicity.fit(docs, labels.where("doc_id % 4 != 0"))
    return chain, toxicity.score(docs, chain).join(labels.where("doc_id % 4 = 0"), "doc_id").collect()


def test_held_out_accuracy(held_out):
    _, rows = held_out
    marked = {r["doc_id"] for r in rows if "toxic" in r["categories"]}
    toxic = {r["doc_id"] for r in rows if r["toxic"] == 1}
    assert len(marked & toxic) >= 0.8 * len(toxic) and len(marked - toxic) <= 0.02 * len(rows)


def test_later_models_read_earlier_probabilities(held_out):
    chain, _ = held_out
    for j, (cols, w) in enumerate(zip(chain.columns, chain.weights)):
        assert w is None or len(w) == len(cols) + j + 1
    assert chain.out_of_fold.shape[1] == len(toxicity.CHAIN)


def test_out_of_fold_predictions_never_see_their_row():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((200, 3)), rng.integers(0, 2, (200, 2))
    a = toxicity.fit_chain(x, y, [[0, 1, 2]] * 2, {})
    other = y.copy()
    other[0, 0] = 1 - other[0, 0]
    b = toxicity.fit_chain(x, other, [[0, 1, 2]] * 2, {})
    fold = np.arange(200) % toxicity.FOLDS == 0
    assert np.allclose(a.out_of_fold[fold, 0], b.out_of_fold[fold, 0])
    assert not np.allclose(a.out_of_fold[~fold, 0], b.out_of_fold[~fold, 0])


def test_linear_fit_equals_gradient_zero():
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((300, 4)), rng.integers(0, 2, 300).astype(float)
    w = toxicity.fit_linear(x, y)
    xx = np.c_[x, np.ones(300)]
    assert np.abs(xx.T @ (1 / (1 + np.exp(-xx @ w)) - y) + w).max() < 1e-3


def test_query_and_stage_agree(spark, docs):
    got = {r["doc_id"] for r in queries.QUERIES["op6_toxicity"](spark, SF).collect()}
    kept = toxicity.keep_clean(docs, toxicity.fit(docs, load(spark, SF, "labels")))
    assert {r["doc_id"] for r in docs.collect()} - got == {r["doc_id"] for r in kept.collect()}
    assert kept.schema == docs.schema and got


def test_edges(spark, frame, edge_rows):
    docs = frame(edge_rows)
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(1, None, 1, 0, ""), (None, 1, 1, 0, ""), (4, 1, 0, 0, ""), (4, 0, 1, 0, "")], LABELS)
    for labels in (none, odd):
        chain = toxicity.fit(docs, labels)
        scored = toxicity.score(docs, chain).collect()
        assert len(scored) == len(edge_rows) and not any(r["categories"] for r in scored)
        assert toxicity.keep_clean(docs, chain).count() == len(edge_rows)
    assert toxicity.score(frame([]), chain).count() == 0
    many = spark.createDataFrame([(i, i % 2, i % 2, 0, "") for i in range(60)], LABELS)
    texts = frame([(i, "awful words here" if i % 2 else "kind words here", "a") for i in range(60)] + [(99, "", "a"), (98, None, "a")])
    marked = toxicity.rejected(texts, toxicity.fit(texts, many)).collect()
    assert {r["doc_id"] for r in marked} == set(range(1, 60, 2))
