import pytest

import oracle
import __spark_entry__ as entry
from ampliq.plans import all_queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(n for n, q in all_queries().items() if q.sql))
def test_query_equals_sql(spark, con, name):
    problems, _ = oracle.compare(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name])
    # A tiny table may leave a report empty; agreement is what counts here.
    assert [p for p in problems if p != "no rows"] == []


def test_every_query_is_registered():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert set(all_queries()) <= names
    assert {n for n, q in all_queries().items() if not q.sql} == {"independent_panel", "designed_assays"}
