import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarry import PlanError, build_plan, execute
from quarry.plans.compiler import main_frame
from quarry.catalog import Question, over_budget, presets
from quarry.explore import drafts, summary
from quarry.functions import sketch, sums
from quarry.schema import as_epoch_day, coerce, epoch_day, exact
from quarry.sources import convert, etl
from quarry.sources.tables import ROW_ID, Table, open_table, with_row_ids
from quarry.streaming.runner import stream_plan, stream_table
from quarry.synth import plain_counts, salted_counts, skewed_keys


def test_row_ids_over_several_files(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).select(F.col("id").alias("v")).repartitionByRange(4, "v").write.parquet(path)
    numbered = with_row_ids(spark.read.parquet(path))
    got = [r.v for r in numbered.orderBy(ROW_ID).collect()]
    assert got == [r[0] for f in sorted(spark.read.parquet(path).inputFiles()) for r in spark.read.parquet(f).collect()]
    assert [r[0] for r in numbered.select(ROW_ID).orderBy(ROW_ID).collect()] == list(range(1000))
    table = open_table(spark, path)
    assert execute(table, build_plan(limit=3, offset=5)).rows.collect()[0].row_id == 5


def test_convert_clusters_and_reports(spark, tmp_path):
    source, target = str(tmp_path / "s.csv"), str(tmp_path / "t.parquet")
    spark.range(5000).select(F.pmod(F.col("id") * 7919, F.lit(5000)).alias("n"), F.lit("x").alias("s")).repartition(3).write.option("header", True).csv(source)
    convert.convert(spark, source, target, cluster_by=["n"], rows_per_file=1000)
    done = open_table(spark, target)
    assert done.df.count() == 5000 and len(done.df.inputFiles()) >= 5
    report = convert.storage_report(done.df).where("column = 'n'").collect()
    spans = sorted((int(r.low), int(r.high)) for r in report)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert {r.column for r in convert.column_storage(convert.storage_report(done.df)).collect()} == {"n", "s"}
    assert convert.schema_report(done.df, 1) == ["n: int", "… +1 more"]
    assert convert.as_text(spark.createDataFrame([(bytearray(b"ab"),)], "b binary")).collect()[0].b == "ab"


@pytest.mark.parametrize("kind", ["orc", "json"])
def test_other_formats(spark, tmp_path, kind):
    path = str(tmp_path / f"t.{kind}")
    getattr(spark.range(5).write, kind)(path)
    assert open_table(spark, path).df.count() == 5


def test_etl_from_csv(spark, tmp_path):
    def put(name, header, *lines):
        (tmp_path / f"{name}.csv").write_text("\n".join([header, *lines]) + "\n")
        return etl.read_dump(spark, str(tmp_path), name)

    crates = put("crates", "id,name,downloads", "1,alpha,100", "2,beta,50")
    versions = put("versions", "id,crate_id,num,downloads,crate_size,created_at,yanked,edition,license,has_lib,rust_version,num_no_build", "10,1,' 1.0 ',7,5,2025-01-01,false,2021,MIT,true,1.7,1.0", "11,9,2.0,7,5,2025-01-01,false,2021,MIT,true,1.7,2.0")
    dependencies = put("dependencies", "id,version_id,explicit_name,req,kind,optional", "1,10,beta,^1,0,false", "2,10,,beta ^2,1,true", "3,10,nobody,*,0,false", "4,99,beta,*,0,false")
    assert [(r.version_id, r.crate_name) for r in etl.version_table(versions, crates).collect()] == [(10, "alpha")]
    edges = sorted((r.dependency_id, r.parent_crate_name, r.dep_crate_id, r.dep_crate_name) for r in etl.dependency_table(dependencies, versions, crates).collect())
    assert edges == [(1, "alpha", 2, "beta"), (2, "alpha", 2, "beta ^2"), (3, "alpha", None, "nobody")]
    links = spark.createDataFrame([(1, 5), (2, 5), (2, 6)], "crate_id int, category_id int")
    categories = spark.createDataFrame([(5, "web", "Web")], "id int, slug string, category string")
    totals = spark.createDataFrame([(1, 100)], "crate_id int, downloads int")
    assert sorted(tuple(r) for r in etl.category_table(crates, links, categories, totals).collect()) == [(1, "alpha", "web", "Web", 100), (2, "beta", "web", "Web", 0)]
    owners = spark.createDataFrame([(1, 7, 1)], "crate_id int, owner_id int, owner_kind int")
    users = spark.createDataFrame([(7, "u", None)], "id int, gh_login string, name string")
    assert tuple(etl.maintainer_table(crates, owners, users, totals).collect()[0]) == (1, "alpha", "u", None, 1, 100)
    facts = spark.createDataFrame([(10, dt.date(2026, 1, d), d) for d in (3, 1, 2)], "version_id int, date date, downloads int")
    daily = etl.daily_table(facts, etl.version_table(versions, crates))
    assert [tuple(r) for r in etl.recent_totals(daily, "2026-01-02").collect()] == [("alpha", 5)]
    assert [r.downloads for r in etl.version_totals(daily, "alpha").collect()] == [6]


def test_stream_of_a_plan(spark, tmp_path):
    folder = str(tmp_path / "in")
    data = [(i, ["a", "b", None][i % 3], float(i), dt.datetime(2025, 1, 1, i % 5)) for i in range(60)]
    schema = "i long, k string, v double, ts timestamp"
    spark.createDataFrame(data, schema).repartition(3).write.parquet(folder)
    stream = stream_table(spark, folder, spark.read.parquet(folder).schema, 1)
    plan = build_plan(filters=[{"column": "v", "op": ">=", "value": 10}], groupBy={"keys": ["k"], "value": "v"})
    q = stream_plan(stream, plan).writeStream.outputMode("complete").format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    batch = execute(Table("t", spark.read.parquet(folder)), plan).groups
    assert sorted(map(tuple, spark.sql("SELECT * FROM out").collect())) == sorted(map(tuple, batch.collect()))
    rows = stream_plan(stream, build_plan(select=["i"])).writeStream.format("memory").queryName("rows_out").start()
    rows.processAllAvailable()
    rows.stop()
    assert spark.sql("SELECT count(*) FROM rows_out").collect()[0][0] == 60
    assert stream_plan(stream, build_plan(groupBy={"keys": ["k"]}), time="ts", window="1 hour").isStreaming
    with pytest.raises(PlanError):
        stream_plan(stream, build_plan(limit=3, select=["i"]))


def test_synthetic_keys(spark):
    keys = skewed_keys(spark, 20_000, 500, 2, 0.4)
    assert sorted(map(tuple, plain_counts(keys, "key").collect())) == sorted(map(tuple, salted_counts(keys, "key").collect()))
    assert keys.where("key < 2").count() > 7000 and keys.collect()[:5] == skewed_keys(spark, 20_000, 500, 2, 0.4).collect()[:5]


def test_sketches_and_shifted_sums(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 5000).alias("v"), F.col("id").cast("double").alias("d"))
    estimate = sketch.merged(sketch.sketches(df, ["g"], "v").withColumn("all", F.lit(1)), ["all"]).collect()[0].estimate
    assert abs(estimate - 5000) < 5000 * 6 * sketch.STANDARD_ERROR
    row = sums.shifted_sums(df, "v", [0, 3]).collect()[0]
    assert row.sum_3 - row.sum_0 == 60_000
    with pytest.raises(PlanError):
        sums.shifted_sums(df, "d", [1])


def test_days_and_literals(spark):
    assert epoch_day("2013-07-01") == 15887 and epoch_day("1970-01-01") == 0
    assert spark.range(1).select(as_epoch_day(F.lit("2013-07-01"))).collect()[0][0] == 15887
    from pyspark.sql import types as T

    for value, kind in (("maybe", T.BooleanType()), ("x", T.LongType()), ("x", T.DateType()), ("x", T.TimestampNTZType()), (None, T.StringType()), (1, T.ArrayType(T.LongType()))):
        with pytest.raises(PlanError):
            coerce(value, kind)
    with pytest.raises(PlanError):
        exact(spark.range(1), "nope")


def test_drafts(spark):
    plan = drafts.build_query_plan(drafts.QueryDraft("aggregate", "x", "name", (drafts.FilterDraft("n", "between", "1, 5"), drafts.FilterDraft("b", "=", "true"), drafts.FilterDraft("s", "contains", "12"), drafts.FilterDraft("n", "in", "1,2"), drafts.FilterDraft("", "=", "z")), ("k",), ""))
    assert [f.column for f in plan.filters] == ["name", "n", "b", "s", "n"] and plan.filters[1].value2 == 5 and plan.filters[2].value is True
    assert plan.filters[3].value == "12" and plan.filters[4].value == [1, 2] and plan.limit == 25 and plan.group_by.value == "downloads"
    again = drafts.build_query_plan(drafts.draft_of(plan))
    assert again.filters == plan.filters and again.group_by == plan.group_by
    for bad in (drafts.QueryDraft("aggregate"), drafts.QueryDraft("dance"), drafts.QueryDraft(filters=(drafts.FilterDraft("a", "between", "1"),))):
        with pytest.raises(PlanError):
            drafts.build_query_plan(bad)
    assert "Top 25 groups of k" in drafts.narrative(drafts.QueryDraft("aggregate", group_keys=("k",)))


def test_kinds_and_defaults():
    for kind in drafts.KINDS:
        assert drafts.default_draft(kind).search_column
    assert drafts.default_draft("trends", ["version", "downloads"]).group_keys == ("version",)
    assert drafts.detect_kind(["dep_crate_name", "parent_crate_name", "license"]) == "dependencies"
    assert drafts.detect_kind(["crate_name", "license", "downloads"]) == "crates"
    assert drafts.detect_kind(["date", "version_id", "downloads"]) == "trends"
    assert drafts.detect_kind(["CounterID"]) == "hits" and drafts.detect_kind(["zzz"]) == "crates"


def test_catalog_presets_and_budgets(spark):
    import time

    from quarry.queries.reference import CATALOG

    chosen = presets(CATALOG)
    assert set(chosen) == set(drafts.KINDS) and [len(chosen[k]) for k in ("crates", "dependencies", "categories", "maintainers", "trends", "hits")] == [7, 5, 3, 3, 5, 3]
    took = {}
    for name, question in CATALOG.items():
        assert question.asks.endswith("?") and question.seconds > 0
        table = open_table(spark, f"/root/testdata/sf0.01/{question.table}.parquet")
        began = time.perf_counter()
        rows = main_frame(table, question.plan).count()
        took[name] = (time.perf_counter() - began, rows)
    assert over_budget(CATALOG, took) == {}
    bad = {"x": Question("events", "?", build_plan(limit=1), 1, 5)}
    assert over_budget(bad, {"x": (2.0, 9)}) and over_budget(bad, {"x": (0.5, 4)}) and not over_budget(bad, {"x": (0.5, 5)})


def test_summaries(spark):
    df = spark.createDataFrame([("a", "MIT", 3, True), ("a", "MIT", 4, False), ("a", None, 1, None), ("b", None, None, True), (None, "MIT", 9, True)], "e string, c string, n long, f boolean")
    assert sorted(map(tuple, summary.entity_profile(df, "e", "n", "f", "c").collect())) == [("a", 3, 8, 1, "MIT"), ("b", 1, 0, 1, None)]
    assert [r.n for r in summary.entity_versions(df, "e", "a", "n").collect()] == [4, 3, 1]
    table = Table("t", df.withColumn(ROW_ID, F.monotonically_increasing_id()))
    result = execute(table, build_plan(groupBy={"keys": ["e", "f"], "value": "n"}))
    assert summary.chart_kind(result) == "grouped" and summary.pivoted(result.groups, ["e", "f"]).columns == ["e", "false", "true"]
    assert summary.chart_kind(execute(table, build_plan(limit=1))) == "rows"


def test_command_line(spark, tmp_path, capsys):
    from quarry import cli

    path = str(tmp_path / "t.parquet")
    spark.range(10).write.parquet(path)
    assert cli.main(["query", path, "SELECT COUNT(*) AS n FROM t"]) == 0 and '{"n":10}' in capsys.readouterr().out
    assert cli.main(["query", path, '{"limit": 2, "select": ["id"]}']) == 0 and '{"id":1}' in capsys.readouterr().out
    assert cli.main(["query", path, "SELECT MAX(id) AS n FROM t", "--stats"]) == 0 and '"rows": 1' in capsys.readouterr().out
    file = tmp_path / "q.md"
    file.write_text("# notes\nSELECT COUNT(*) AS n FROM t;\nSELECT MAX(id) AS m FROM t;\n")
    assert cli.main(["bench", path, str(file), "--only", "2", "--runs", "1", "--warmup", "0"]) == 0 and '"query": 2' in capsys.readouterr().out
    assert cli.main(["parity", path + "/*.parquet", str(file)]) == 0 and "1: same" in capsys.readouterr().out
    assert cli.main(["convert", path, str(tmp_path / "o.parquet"), "--show-schema", "--show-stats"]) == 0 and "id: bigint" in capsys.readouterr().out
    assert cli.chosen("1,3-5", 4) == [1, 3, 4] and cli.statements("SELECT 1;\nSELECT 2;", False) == ["SELECT 1", "SELECT 2"]


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from quarry.session import shared_dir

    unset = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: unset, master="spark://host:7077")
    with pytest.raises(PlanError):
        shared_dir(SimpleNamespace(conf=unset, sparkContext=context))
    named = SimpleNamespace(get=lambda key, *a: "hdfs:///shared")
    assert shared_dir(SimpleNamespace(conf=named, sparkContext=context)) == "hdfs:///shared"


def test_written_tables_are_dropped(spark):
    import os

    from quarry.session import drop_written, shared_dir, written

    path = written(spark.range(3), "probe").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and shared_dir(spark).removeprefix("file://") in path
    assert drop_written(spark) >= 1 and not os.path.exists(path) and drop_written(spark) == 0
