"""Every registered page-stream query against its SQL statement on the smallest tables."""

import pytest
from oracle import compare, connect

from pagestream.plans import more_queries, oracles, queries, stage_queries, study_queries

QUERIES, ORACLES = queries.QUERIES | more_queries.QUERIES | study_queries.QUERIES | stage_queries.QUERIES, oracles.ORACLES | more_queries.ORACLES | study_queries.ORACLES | stage_queries.ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_statement(spark, con, name):
    compare(con, QUERIES[name](spark, SF), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
