"""Every query that has SQL against DuckDB on the smallest tables."""

import os

import pytest

from tilewright.queries import all_queries

from .oracle import connect, same

SF = "/root/testdata/sf0.001"
QUERIES, SQL = all_queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["extend_add", "extend_add_packed"])
def test_extend_add_of_the_whole_son(spark, name):
    from tilewright.queries.matrix import fixture

    total = lambda df: df.agg({"v": "sum"}).first()[0]
    son = fixture(spark, SF, "r").df.where("j <= i")
    assert son.where("i >= 20").count() > 0  # what a cut at 20 leaves out
    assert total(QUERIES[name](spark, SF)) == total(fixture(spark, SF, "s").df) + total(son)


def test_p6_statistics_counts_a_record_once(spark, duck):
    records = duck.execute("SELECT count(*) FROM (SELECT DISTINCT file_id, rpos FROM kaapi_event WHERE kid IS NOT NULL AND date > 0)").fetchone()[0]
    assert QUERIES["p6_statistics"](spark, SF).agg({"n": "sum"}).first()[0] == records
