import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from quarry import PlanError, build_plan, execute
from quarry.parity import signature
from quarry.plans.compiler import main_frame
from quarry.plans.model import EXAMPLE_PLAN
from quarry.plans.render import to_sql
from quarry.sources.tables import Table

NUMBERS = [(i, None if i == 5 else i, i - 32, float("nan") if i == 10 else (None if i == 7 else i / 2), None if i % 9 == 0 else "ab"[i % 2] * (i % 4), None if i == 3 else i % 3 == 0, datetime.date(2020, 2, 27) + datetime.timedelta(days=i % 5)) for i in range(64)]


@pytest.fixture(scope="module")
def table(spark):
    return Table("t", spark.createDataFrame(NUMBERS, "id long, u int, s int, d double, txt string, b boolean, day date").coalesce(1).withColumn("__row_id", F.col("id")))


def ids(table, filters, combine=()):
    frame = execute(table, build_plan(filters=filters, combine=combine, limit=1000)).rows
    return [r[0] for r in frame.collect()]


def f(column, op, value, value2=None):
    return {"column": column, "op": op, "value": value, "value2": value2}


def test_comparisons_drop_null_and_nan(table):
    assert ids(table, [f("u", "!=", 4)]) == [i for i in range(64) if i not in (4, 5)]
    assert ids(table, [f("d", "!=", 1)]) == [i for i in range(64) if i not in (2, 7, 10)]
    assert ids(table, [f("d", ">", 30)]) == [61, 62, 63]
    assert ids(table, [f("s", "<=", -31)]) == [0, 1]
    assert ids(table, [f("u", "<", 2.5)]) == [0, 1, 2]
    assert ids(table, [f("u", "=", -1)]) == []
    assert ids(table, [f("s", "between", -1, 1)]) == [31, 32, 33]


def test_lists_texts_booleans_days(table):
    assert ids(table, [f("u", "in", [1, 5, 60])]) == [1, 60]
    assert ids(table, [f("u", "in", [])]) == []
    assert ids(table, [f("txt", "like", "bb")]) == [i for i in range(64) if i % 9 and i % 2 and i % 4 >= 2]
    assert ids(table, [f("txt", "=", "")]) == [i for i in range(64) if i % 9 and i % 4 == 0]
    assert ids(table, [f("b", "!=", "true")]) == [i for i in range(64) if i != 3 and i % 3]
    assert ids(table, [f("day", ">", "2020-02-29")]) == [i for i in range(64) if i % 5 > 2]


def test_like_takes_no_wildcards(spark):
    t = Table("t", spark.createDataFrame([(0, "a%b"), (1, "a_b"), (2, "axb"), (3, None)], "id long, s string").coalesce(1).withColumn("__row_id", F.col("id")))
    assert ids(t, [f("s", "like", "a%")]) == [0]
    assert ids(t, [f("s", "not_like", "_")]) == [0, 2]


def test_combination(table):
    a, b = f("u", "<", 10), f("s", ">", -25)
    assert ids(table, [a, b], ("AND",)) == [8, 9]
    assert ids(table, [f("u", "<", 2), f("u", ">", 61)], ("or",)) == [0, 1, 62, 63]
    # NOT turns a null comparison, which is false, to true.
    assert ids(table, [f("u", ">", 1)], (0, "NOT")) == [0, 1, 5]
    assert ids(table, [a, b, f("b", "=", True)], (0, 1, -1, 2, -3, -1)) == [8]


@pytest.mark.parametrize("combine", [(0, 1), (-1, 0), (0, 7, -1), (0, "XOR"), (0, 1, -1, -1)])
def test_malformed_combination(table, combine):
    with pytest.raises(PlanError):
        ids(table, [f("u", "<", 10), f("u", ">", 2)], combine)


@pytest.mark.parametrize(
    "spec",
    [
        {"select": ["u"], "groupBy": {"keys": ["u"]}},
        {"select": ["u"], "aggregates": [{"column": "u"}]},
        {"groupBy": {"keys": ["u", "s", "d"]}},
        {"aggregates": [{"column": "txt"}]},
        {"filters": [f("u", "=", None)], "limit": 1},
        {"filters": [f("u", "=", "x")], "limit": 1},
        {"filters": [f("day", "=", "soon")], "limit": 1},
        {"filters": [f("u", "~", 1)], "limit": 1},
        {"filters": [f("nope", "=", 1)], "limit": 1},
        {"filters": [f("U", "=", 1)], "limit": 1},
        {"filters": [f(99, "=", 1)], "limit": 1},
        {"limit": -1},
    ],
)
def test_rejected(table, spec):
    with pytest.raises(PlanError):
        main_frame(table, build_plan(spec)).collect()


def test_rows_need_a_limit_groups_do_not(table):
    assert execute(table, build_plan()).rows.collect() == []
    assert execute(table, build_plan(limit=0)).rows.collect() == []
    assert execute(table, build_plan(groupBy={"keys": ["b"]}, limit=0)).groups.count() == 2


def test_projection_by_name_and_number(table):
    result = execute(table, build_plan(filters=[f("u", ">", 60)], limit=2, select=["txt", 0]))
    assert [tuple(r) for r in result.projection.collect()] == [("b", 61), ("aa", 62)]
    assert [r[0] for r in result.rows.collect()] == [61, 62]


def test_aggregates_skip_nan_and_default_to_zero(table):
    row = execute(table, build_plan(aggregates=[{"column": "d"}, {"column": "b"}])).aggregates.collect()[0]
    known = [x for _, _, _, x, *_ in NUMBERS if x is not None and not math.isnan(x)]
    assert (row.d_count, row.d_sum, row.d_min, row.d_max) == (62, sum(known), min(known), max(known))
    assert row.d_mean == pytest.approx(sum(known) / 62)
    assert (row.b_count, row.b_sum) == (63, sum(bool(b) for *_, b, _ in NUMBERS))
    empty = execute(table, build_plan(aggregates=[{"column": "u"}], filters=[f("u", ">", 1000)])).aggregates.collect()[0]
    assert tuple(empty) == (0, 0.0, 0, 0, 0.0)


def test_one_statistic_only(table):
    assert execute(table, build_plan(aggregates=[{"col": "u", "op": "max"}])).aggregates.columns == ["u_max"]


def test_groups_drop_null_keys_and_keep_first_seen_order(spark):
    data = [("z", 1.0), ("a", 2.0), (None, 9.0), ("z", 3.0), ("m", float("nan")), ("a", -2.0)]
    t = Table("t", spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i long, k string, v double").coalesce(1).withColumn("__row_id", F.col("i")))
    seen = execute(t, build_plan(groupBy={"keys": ["k"], "value": "v"})).groups.collect()
    assert [tuple(r) for r in seen] == [("z", 2, 4.0, 1.0, 3.0, 2.0), ("a", 2, 0.0, -2.0, 2.0, 0.0), ("m", 1, 0.0, 0.0, 0.0, 0.0)]
    top = execute(t, build_plan(groupBy={"keys": ["k"]}, groupOrderByCount=True, limit=2)).groups.collect()
    assert [tuple(r) for r in top] == [("a", 2), ("z", 2)]
    paged = execute(t, build_plan(groupBy={"keys": ["k"]}, groupOrderByCount=True, limit=2, offset=2)).groups.collect()
    assert [tuple(r) for r in paged] == [("m", 1)]


def test_groups_and_aggregates_together(table):
    result = execute(table, build_plan(groupBy={"keys": ["b"]}, aggregates=[{"column": "u"}], filters=[f("u", "<", 6)]))
    assert result.groups.count() == 2 and result.aggregates.collect()[0].u_count == 5


def test_json_round_trip():
    assert build_plan(EXAMPLE_PLAN.to_json()) == EXAMPLE_PLAN
    with pytest.raises(PlanError):
        build_plan({"filtre": []})


def test_big_integers_stay_exact(spark):
    t = Table("t", spark.createDataFrame([(0, 435090932899640449), (1, 435090932899640448), (2, 2**53 + 1)], "i long, v long").coalesce(1).withColumn("__row_id", F.col("i")))
    assert ids(t, [f("v", "=", 435090932899640449)]) == [0]
    assert ids(t, [f("v", "=", 2**53)]) == []


def test_random_plans_against_duckdb(spark, tmp_path):
    import duckdb

    random.seed(7)
    data = [(i, random.choice([None, "x", "yy", "", "a%"]), random.choice([None, -1, 0, 3, 7]), random.choice([None, 0.5, 2.25]), random.choice([None, True, False])) for i in range(300)]
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(data, "i long, k string, n int, v double, b boolean").coalesce(1).write.parquet(path)
    t = Table("t", spark.read.parquet(path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW t AS SELECT * FROM read_parquet('{path}/*.parquet')")
    pools = {"k": ["x", "y", ""], "n": [-1, 3], "v": [0.5, 1], "b": [True, False]}
    for _ in range(40):
        filters = []
        for _ in range(random.randint(0, 3)):
            c = random.choice("knvb")
            op = random.choice(["=", "!=", "in"] + (["<", ">="] if c in "nv" else []) + (["like", "not_like"] if c == "k" else []))
            v = random.choice(pools[c])
            filters.append(f(c, op, [v] if op == "in" else v))
        combine = random.choice([(), ("AND",), ("OR",), (0, "NOT", 1, "OR") if len(filters) == 2 else ()]) if filters else ()
        shape = random.choice([{"groupBy": {"keys": ["k"], "value": "n"}}, {"groupBy": {"keys": ["k", "b"]}, "groupOrderByCount": True, "limit": 3}, {"aggregates": [{"column": "v"}]}, {"limit": 9, "select": ["i", "k"]}])
        plan = build_plan(filters=filters, combine=combine, **shape)
        frame = main_frame(t, plan)
        cursor = con.execute(to_sql("t", plan))
        names = [d[0] for d in cursor.description]
        want = sorted([tuple(signature(round(x, 4) if isinstance(x, float) else x) for x in r) for r in cursor.fetchall()], key=repr)
        got = sorted([tuple(signature(round(x, 4) if isinstance(x, float) else x) for x in r) for r in frame.select(*names).collect()], key=repr)
        assert got == want, plan


def executed(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_or_and_nested_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(i, float(i), str(i % 3)) for i in range(50)], "i long, v double, k string").write.parquet(path)
    t = Table("t", spark.read.parquet(path))
    filters = [f("i", "<", 3), f("v", ">", 45.0), f("k", "!=", "1")]
    for combine, pushed in [(("OR",), "Or(Or(LessThan(i,3),"), ((0, 1, "OR", 2, "AND"), "Or(LessThan(i,3),")]:
        frame = main_frame(t, build_plan(filters=filters, combine=combine, aggregates=[{"column": "i"}]))
        assert pushed in executed(frame).replace(" ", "")
    assert main_frame(t, build_plan(filters=filters[:2], combine=("OR",), aggregates=[{"column": "i", "op": "count"}])).collect()[0][0] == 7


def test_a_page_opens_the_first_files_only(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    for part in range(9):
        spark.createDataFrame([(100 * part + i, i % 10) for i in range(100)], "i long, k int").coalesce(1).write.mode("append").parquet(path)
    t = Table("t", spark.read.parquet(path))
    order = {}
    for r in t.df.selectExpr("i", "_metadata.file_path AS p").collect():
        order.setdefault(r.p, []).append(r.i)
    rows_in_order = [i for p in sorted(order) for i in sorted(order[p])]
    for spec, start, step, count, opened in [({"limit": 20}, 0, 1, 20, 1), ({"limit": 20, "offset": 150}, 150, 1, 20, 2), ({"limit": 25, "filters": [f("k", "=", 0)]}, 0, 10, 25, 4), ({"limit": 5000}, 0, 1, 900, 9)]:
        frame = execute(t, build_plan(select=["i"], **spec)).projection
        assert [r.i for r in frame.collect()] == rows_in_order[start : start + step * count : step]
        assert len(frame.inputFiles()) == opened
    assert [r[0] for r in execute(t, build_plan(limit=3, offset=299)).rows.collect()] == [299, 300, 301]
