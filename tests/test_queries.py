"""Every registered query against its SQL on the smallest tables, and the same result for other partition counts."""

import os

import pytest

from quarry.parity import compare, duck
from quarry.queries import data, reference, visits

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
QUERIES = reference.QUERIES | visits.QUERIES | data.QUERIES
ORACLES = reference.ORACLES | visits.ORACLES | data.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, con, name):
    outcome = compare(name, QUERIES[name](spark, FOLDER), con, ORACLES[name])
    assert outcome.same, outcome


@pytest.mark.parametrize(
    "name, table",
    [
        ("row_ids_whole", "FROM lineitem WHERE l_quantity > 45"),
        ("select_projection_whole", "FROM orders WHERE o_orderstatus = 'F'"),
        ("group_null_keys_whole", "FROM (SELECT 1 FROM crates_versions WHERE license IS NOT NULL AND edition IS NOT NULL GROUP BY license, edition)"),
        ("group_having_whole", "FROM (SELECT 1 FROM lineitem GROUP BY l_partkey HAVING count(*) > 28)"),
    ],
)
def test_whole_outputs_are_compared(spark, con, name, table):
    rows = con.execute("SELECT count(*) " + table).fetchone()[0]
    assert rows and QUERIES[name](spark, FOLDER).count() == rows


@pytest.mark.parametrize("name", ["p2_found", "p5_found", "p6_totals", "p7_found", "group_first_seen", "group_topk_count"])
@pytest.mark.parametrize("partitions", ["1", "7"])
def test_partition_count_changes_nothing(spark, con, name, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert compare(name, QUERIES[name](spark, FOLDER), con, ORACLES[name]).same
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_visits_take_every_published_shape(spark):
    assert len(visits.STATEMENTS) == 43
    empty = [name for name, run in visits.QUERIES.items() if run(spark, "/root/testdata/sf0.01").isEmpty()]
    assert empty == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = reference.QUERIES["group_topk_count"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(l_returnflag,R)" in plan and "TakeOrderedAndProject" in plan
    assert "l_comment" not in plan and "l_tax" not in plan
