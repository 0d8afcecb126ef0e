"""Every registered query against its SQL on the smallest tables."""

import pytest

from opsweave.plans import load_all
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
ENTRIES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, con, name):
    ok, message = compare(ENTRIES[name], spark, SF, con)
    assert ok, message


#: Queries that SQL does not say; they are tested by their parts or against plain Python.
WITHOUT_SQL = {
    "graph_communities", "graph_matching_communities", "search_document_vectors", "search_fused", "search_local",
    "search_docs", "search_communities", "diagnose_dns_and_crash_advice", "diagnose_candidate_functions",
}


def test_every_other_query_has_sql():
    assert {name for name, e in ENTRIES.items() if not e.sql} == WITHOUT_SQL
