"""Queries of the engine's own operators on the test tables, each with the SQL it must agree with.

Plan queries take their SQL from the plan's rendering; the others state it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.catalog import questions
from quarry.explore import drafts, summary
from quarry.functions import sketch, sums
from quarry.operators import relations
from quarry.operators.closure import reachable
from quarry.plans.compiler import execute, main_frame
from quarry.plans.model import QueryPlan, build_plan
from quarry.plans.render import to_sql
from quarry.schema import as_epoch_day
from quarry.sources import etl
from quarry.sources.tables import Table, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> Table:
    return Table(name, read_table(spark, folder, name))


def _rounded(df: DataFrame) -> DataFrame:
    last = lambda c: c.rsplit("_", 1)[-1] in ("sum", "mean")
    return df.withColumns({c: F.round(c, 4) for c, kind in df.dtypes if kind == "double" and last(c)})


def _plan(name: str, table: str, plan: QueryPlan | dict, part: str | None = None) -> None:
    plan = plan if isinstance(plan, QueryPlan) else build_plan(plan)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        source = _table(spark, folder, table)
        return _rounded(getattr(execute(source, plan), part) if part else main_frame(source, plan))

    QUERIES[name], ORACLES[name] = run, to_sql(table, plan, part)


def _sql(name: str, table: str, text: str, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: _table(spark, folder, table).sql(text)
    ORACLES[name] = oracle or text


def query(oracle: str | None):
    """Register a function as a query with its SQL (none: checked against brute force in the tests)."""

    def register(function):
        QUERIES[function.__name__] = function
        if oracle:
            ORACLES[function.__name__] = oracle
        return function

    return register


# Filters: counts and sums over the whole table, so that every matching row is compared.
def _count(name: str, table: str, value: str, *filters: tuple, combine: tuple = ()) -> None:
    specs = [dict(zip(("column", "op", "value", "value2"), f, strict=False)) for f in filters]
    _plan(name, table, {"filters": specs, "combine": combine, "aggregates": [{"column": value, "op": s} for s in ("count", "min", "max", "sum")]})


_count("filter_eq", "lineitem", "l_orderkey", ("l_returnflag", "=", "R"))
_count("filter_neq", "lineitem", "l_orderkey", ("l_returnflag", "!=", "R"))
_count("filter_lt", "lineitem", "l_orderkey", ("l_quantity", "<", 10))
_count("filter_lte", "lineitem", "l_orderkey", ("l_quantity", "<=", 10))
_count("filter_gt", "lineitem", "l_orderkey", ("l_extendedprice", ">", 50000.5))
_count("filter_gte", "lineitem", "l_orderkey", ("l_quantity", "gte", 49))
_count("filter_between", "orders", "o_orderkey", ("o_totalprice", "between", 1000, 20000))
_count("filter_in", "orders", "o_orderkey", ("o_orderstatus", "in", ["F", "P"]))
_count("filter_in_empty", "orders", "o_orderkey", ("o_orderstatus", "in", []))
_count("filter_like_contains", "documents", "doc_id", ("text", "like", "the river"))
_count("filter_not_like", "documents", "doc_id", ("text", "not_like", "the river"))
_count("filter_empty_string", "crates_versions", "version_id", ("license", "=", ""))
_count("filter_not_empty_string", "crates_versions", "version_id", ("license", "!=", ""))
_count("filter_boolean", "crates_versions", "version_id", ("yanked", "!=", True))
_count("filter_date_iso", "orders", "o_orderkey", ("o_orderdate", ">=", "1997-01-01"))
_count("filter_day", "version_downloads_daily", "downloads", ("date", "between", "2026-01-10", "2026-02-10"))
_count("combine_and", "lineitem", "l_orderkey", ("l_returnflag", "=", "R"), ("l_quantity", ">", 30), combine=("AND",))
_count("combine_or", "lineitem", "l_orderkey", ("l_returnflag", "=", "R"), ("l_quantity", ">", 45), combine=("OR",))
_count("combine_not", "crates_versions", "version_id", ("license", "=", "MIT"), combine=(0, "NOT"))
_count("combine_nested", "crates_versions", "version_id", ("edition", "=", 2021), ("downloads", ">", 1000), ("yanked", "=", True), combine=(0, 1, "OR", 2, "NOT", "AND"))

# Rows and projection.
_plan("row_ids", "lineitem", {"filters": [{"column": "l_quantity", "op": ">", "value": 45}], "limit": 500})
_plan("row_ids_no_limit", "lineitem", {"filters": [{"column": "l_quantity", "op": ">", "value": 45}]})
_plan("select_projection", "orders", {"filters": [{"column": "o_orderstatus", "op": "=", "value": "F"}], "limit": 200, "select": ["o_orderkey", "o_totalprice", "o_orderpriority"]})
# The whole output, by a limit above the tables' sizes (row plans need one).
EVERY_ROW = 2**31 - 1
_plan("row_ids_whole", "lineitem", {"filters": [{"column": "l_quantity", "op": ">", "value": 45}], "limit": EVERY_ROW})
_plan("select_projection_whole", "orders", {"filters": [{"column": "o_orderstatus", "op": "=", "value": "F"}], "limit": EVERY_ROW, "select": ["o_orderkey", "o_totalprice", "o_orderpriority"]})
_plan("order_by_one", "orders", {"limit": 50, "select": ["o_orderkey", "o_totalprice"], "orderBy": [{"column": "o_totalprice"}]})
_plan("order_by_two_desc", "lineitem", {"limit": 60, "select": ["l_orderkey", "l_linenumber", "l_quantity"], "orderBy": [{"column": "l_quantity", "descending": True}, {"column": "l_orderkey", "descending": True}]})
_plan("order_by_string", "crates_versions", {"limit": 40, "select": ["license", "version_id"], "orderBy": [{"column": "license"}]})
_plan("limit_offset", "orders", {"limit": 20, "offset": 100, "select": ["o_orderkey"]})
_sql("count_rows", "lineitem", "SELECT COUNT(*) AS n FROM lineitem")

# Global aggregates.
_plan("agg_stats_bundle", "lineitem", {"aggregates": [{"column": "l_quantity"}, {"column": "l_extendedprice"}], "filters": [{"column": "l_linestatus", "value": "O"}]})
_plan("agg_empty_plan", "lineitem", {"aggregates": [{"column": "l_quantity"}], "filters": [{"column": "l_quantity", "op": "<", "value": 0}]})
_plan("agg_nulls", "crates_versions", {"aggregates": [{"column": "downloads"}, {"column": "crate_size"}]})
_sql("agg_count_star", "orders", "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus <> 'O'")
_sql("agg_count_col", "crates_versions", "SELECT COUNT(downloads) AS n, COUNT(*) AS every FROM crates_versions")
_sql("agg_sum", "lineitem", "SELECT ROUND(SUM(l_extendedprice), 2) AS total, COUNT(*) AS n, ROUND(AVG(l_discount), 6) AS mean FROM lineitem")
_sql("agg_avg", "orders", "SELECT ROUND(AVG(o_totalprice), 4) AS mean FROM orders")
_sql("agg_min_max", "lineitem", "SELECT MIN(l_quantity) AS low, MAX(l_quantity) AS high, MIN(l_orderkey) AS first FROM lineitem")
_sql("agg_min_string", "part", "SELECT MIN(p_name) AS low, MAX(p_brand) AS high FROM part WHERE p_size > 10")
_sql("agg_count_distinct", "lineitem", "SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem")
_sql("agg_date_range", "orders", "SELECT MIN(o_orderdate) AS low, MAX(o_orderdate) AS high FROM orders")


@query("SELECT true AS within, count(DISTINCT l_partkey) AS exact FROM lineitem")
def agg_approx_bound(spark: SparkSession, folder: str) -> DataFrame:
    df = read_table(spark, folder, "lineitem").agg(sketch.approx_distinct("l_partkey").alias("a"), F.count_distinct("l_partkey").alias("exact"))
    return df.select((F.abs(F.col("a") - F.col("exact")) <= F.col("exact") * 6 * sketch.STANDARD_ERROR + 1).alias("within"), "exact")


@query("SELECT " + ", ".join(f"sum(l_linenumber + {k})::BIGINT AS sum_{k}" for k in range(90)) + " FROM lineitem")
def agg_sum_shift_90(spark: SparkSession, folder: str) -> DataFrame:
    return sums.shifted_sums(read_table(spark, folder, "lineitem"), "l_linenumber", list(range(90)))


# Groups.
_plan("group_one", "lineitem", {"groupBy": {"keys": ["l_returnflag"], "value": "l_quantity"}})
_plan("group_two", "lineitem", {"groupBy": {"keys": ["l_returnflag", "l_linestatus"], "value": "l_extendedprice"}})
_plan("group_topk_count", "lineitem", {"groupBy": {"keys": ["l_partkey"], "value": "l_quantity"}, "groupOrderByCount": True, "limit": 10, "filters": [{"column": "l_returnflag", "value": "R"}, {"column": "l_shipdate", "op": ">=", "value": "1996-01-01"}]})
_plan("group_topk_sum", "lineitem", {"groupBy": {"keys": ["l_suppkey"], "value": "l_linenumber"}, "orderBy": [{"column": "sum", "descending": True}], "limit": 15})
_plan("group_offset", "lineitem", {"groupBy": {"keys": ["l_partkey"]}, "groupOrderByCount": True, "limit": 10, "offset": 30})
_plan("group_first_seen", "events", {"groupBy": {"keys": ["user_id"], "value": "value"}, "limit": 25})
_plan("group_null_keys", "crates_versions", {"groupBy": {"keys": ["license", "edition"], "value": "downloads"}, "groupOrderByCount": True, "limit": 40})
_plan("group_null_keys_whole", "crates_versions", {"groupBy": {"keys": ["license", "edition"], "value": "downloads"}, "groupOrderByCount": True})
_plan("group_distinct_only", "part", {"groupBy": {"keys": ["p_brand", "p_type"]}})
_sql("group_distinct", "events", "SELECT event_type, COUNT(DISTINCT user_id) AS users, COUNT(*) AS n FROM events GROUP BY event_type ORDER BY users DESC, event_type")
_sql("group_multi_agg", "lineitem", "SELECT l_suppkey, SUM(l_linenumber) AS lines, COUNT(*) AS n, ROUND(AVG(l_quantity), 6) AS mean, COUNT(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 10")
ORACLES["group_multi_agg"] = ORACLES["group_multi_agg"].replace("SUM(l_linenumber)", "SUM(l_linenumber)::BIGINT")
_sql("group_having", "lineitem", "SELECT l_partkey, COUNT(*) AS n, ROUND(AVG(l_quantity), 6) AS mean FROM lineitem GROUP BY l_partkey HAVING COUNT(*) > 28 ORDER BY mean DESC LIMIT 1000")
_sql("group_having_whole", "lineitem", "SELECT l_partkey, COUNT(*) AS n, ROUND(AVG(l_quantity), 6) AS mean FROM lineitem GROUP BY l_partkey HAVING COUNT(*) > 28 ORDER BY mean DESC")
_sql("group_constant_key", "lineitem", "SELECT 1 AS one, l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY 1, l_returnflag ORDER BY n DESC", "SELECT 1 AS one, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag")
_sql("group_computed_key", "orders", "SELECT o_custkey, o_custkey - 1 AS a, o_custkey - 2 AS b, COUNT(*) AS n FROM orders GROUP BY o_custkey, o_custkey - 1, o_custkey - 2 ORDER BY n DESC, o_custkey LIMIT 10")
_sql("group_regexp", "part", r"SELECT REGEXP_REPLACE(p_type, '^([A-Za-z]+) .*$', '\1') AS k, AVG(STRLEN(p_type)) AS l, COUNT(*) AS n, MIN(p_type) AS low FROM part WHERE p_type <> '' GROUP BY k HAVING COUNT(*) > 3 ORDER BY l DESC LIMIT 100")
_sql("group_date_trunc", "events", "SELECT DATE_TRUNC('minute', ts) AS m, COUNT(*) AS n FROM events GROUP BY DATE_TRUNC('minute', ts) ORDER BY DATE_TRUNC('minute', ts) OFFSET 50 LIMIT 100")
_sql("group_extract_minute", "events", "SELECT user_id, extract('minute', ts) AS m, COUNT(*) AS n FROM events GROUP BY user_id, m ORDER BY n DESC, user_id, m LIMIT 50", "SELECT user_id, extract(minute FROM ts)::INTEGER AS m, count(*) AS n FROM events GROUP BY 1, 2 ORDER BY n DESC, user_id, m LIMIT 50")
_sql("group_case", "orders", "SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS src, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY src, o_orderstatus ORDER BY n DESC LIMIT 100")
_sql("like_documents", "documents", "SELECT lang, MIN(page_title) AS low, COUNT(*) AS n FROM documents WHERE text LIKE '%lighthouse%' AND page_title NOT LIKE '%bridge%' GROUP BY lang")
_sql("length_by_lang", "documents", "SELECT lang, ROUND(AVG(STRLEN(text)), 4) AS l, COUNT(*) AS n FROM documents WHERE text <> '' GROUP BY lang", "SELECT lang, round(avg(length(text)), 4) AS l, count(*) AS n FROM documents WHERE text <> '' GROUP BY lang")

# The catalog, with names and days that occur in the tables.
CATALOG = questions(crate="lisutece-rs", rival="reniteka", wanted="foheteti_io", owner="zimigufu0", piece="fohe", since="2026-02-20", until="2026-03-21")
for _name, _question in CATALOG.items():
    _plan(f"catalog_{_name}", _question.table, _question.plan)


# Denormalising joins and rollups, on the registry's normal form as far as the tables give it.
def _registry(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Crates, versions, dependencies and link tables with the columns of a registry dump."""
    versions, edges = read_table(spark, folder, "crates_versions"), read_table(spark, folder, "crates_dependencies")
    once = versions.groupBy("version_id").agg(*[F.max(c).alias(c) for c in ("crate_id", "crate_name", "version", "downloads", "crate_size", "published_date", "yanked", "edition", "license", "has_lib", "rust_version", "dep_count")])
    crates = versions.groupBy(F.col("crate_id").alias("id")).agg(F.max("crate_name").alias("name"), F.max("crate_total_downloads").alias("downloads"))
    dumped = once.select(F.col("version_id").alias("id"), "crate_id", F.concat(F.lit(" "), "version", F.lit("\t")).alias("num"), "downloads", "crate_size", F.col("published_date").alias("created_at"), "yanked", "edition", "license", "has_lib", "rust_version", F.col("dep_count").alias("num_no_build"))
    wanted = edges.groupBy(F.col("dependency_id").alias("id")).agg(F.max("version_id").alias("version_id"), F.max("dep_crate_name").alias("name"), F.max("kind").alias("kind"), F.max("optional").alias("optional"))
    # Every third edge names what it needs in its own column, the others in front of the version they need.
    own = F.when(F.col("id") % 3 == 0, F.col("name")).otherwise(F.lit(""))
    wanted = wanted.select("id", "version_id", own.alias("explicit_name"), F.concat("name", F.lit(" ^1.0")).alias("req"), "kind", "optional")
    maintainers, categories = read_table(spark, folder, "crate_maintainers"), read_table(spark, folder, "crates_categories")
    users = maintainers.where("owner_login IS NOT NULL").groupBy(F.col("owner_login").alias("gh_login")).agg(F.max("owner_name").alias("name"))
    owners = maintainers.where("owner_login IS NOT NULL").select("crate_id", F.col("owner_login").alias("owner_id"), "owner_kind").distinct()
    slugs = categories.groupBy(F.col("category_slug").alias("slug")).agg(F.max("category_name").alias("category"))
    return {
        "crates": crates, "versions": dumped, "dependencies": wanted, "users": users.withColumn("id", F.col("gh_login")), "crate_owners": owners,
        "categories": slugs.withColumn("id", F.col("slug")), "crates_categories": categories.select("crate_id", F.col("category_slug").alias("category_id")).distinct(),
        "crate_downloads": crates.where("downloads > 1000").select(F.col("id").alias("crate_id"), "downloads"),
    }


_DUMP = """WITH v AS (SELECT version_id AS id, max(crate_id) AS crate_id, max(version) AS num, max(downloads) AS downloads, max(crate_size) AS crate_size, max(published_date) AS created_at, max(yanked) AS yanked,
    max(edition) AS edition, max(license) AS license, max(has_lib) AS has_lib, max(rust_version) AS rust_version, max(dep_count) AS dep_count FROM crates_versions GROUP BY 1),
  c AS (SELECT crate_id AS id, max(crate_name) AS name, max(crate_total_downloads) AS downloads FROM crates_versions GROUP BY 1),
  t AS (SELECT id AS crate_id, downloads FROM c WHERE downloads > 1000),
  d AS (SELECT dependency_id AS id, max(version_id) AS version_id, max(dep_crate_name) AS name, max(kind) AS kind, max(optional) AS optional FROM crates_dependencies GROUP BY 1)
"""


@query(_DUMP + """SELECT v.id AS version_id, v.crate_id, c.name AS crate_name, regexp_replace(num, '^\\s+|\\s+$', '', 'g') AS version, v.downloads, crate_size, created_at AS published_date, yanked, edition, license, has_lib, rust_version,
    c.downloads AS crate_total_downloads, dep_count FROM v JOIN c ON c.id = v.crate_id""")
def etl_version_table(spark: SparkSession, folder: str) -> DataFrame:
    dump = _registry(spark, folder)
    return etl.version_table(dump["versions"], dump["crates"])


@query(_DUMP + """, e AS (SELECT d.*, CASE WHEN id % 3 = 0 THEN nullif(name, '') END AS own, name || ' ^1.0' AS req FROM d)
    SELECT e.id AS dependency_id, e.version_id, v.crate_id AS parent_crate_id, p.name AS parent_crate_name, n.id AS dep_crate_id, coalesce(own, req) AS dep_crate_name, kind, optional
    FROM e JOIN v ON v.id = e.version_id JOIN c p ON p.id = v.crate_id LEFT JOIN c n ON n.name = coalesce(own, split_part(req, ' ', 1))""")
def etl_dependency_table(spark: SparkSession, folder: str) -> DataFrame:
    dump = _registry(spark, folder)
    return etl.dependency_table(dump["dependencies"], dump["versions"], dump["crates"])


@query(_DUMP + """SELECT c.id AS crate_id, c.name AS crate_name, category_slug, category_name, coalesce(t.downloads, 0) AS crate_downloads FROM (SELECT DISTINCT crate_id, category_slug FROM crates_categories) k
    JOIN c ON c.id = k.crate_id JOIN (SELECT category_slug, max(category_name) AS category_name FROM crates_categories GROUP BY 1) USING (category_slug) LEFT JOIN t ON t.crate_id = c.id""")
def etl_category_table(spark: SparkSession, folder: str) -> DataFrame:
    dump = _registry(spark, folder)
    return etl.category_table(dump["crates"], dump["crates_categories"], dump["categories"], dump["crate_downloads"])


@query(_DUMP + """SELECT c.id AS crate_id, c.name AS crate_name, owner_login, u.owner_name, owner_kind, coalesce(t.downloads, 0) AS crate_downloads
    FROM (SELECT DISTINCT crate_id, owner_login, owner_kind FROM crate_maintainers WHERE owner_login IS NOT NULL) k
    JOIN c ON c.id = k.crate_id JOIN (SELECT owner_login, max(owner_name) AS owner_name FROM crate_maintainers GROUP BY 1) u USING (owner_login) LEFT JOIN t ON t.crate_id = c.id""")
def etl_maintainer_table(spark: SparkSession, folder: str) -> DataFrame:
    dump = _registry(spark, folder)
    return etl.maintainer_table(dump["crates"], dump["crate_owners"], dump["users"], dump["crate_downloads"])


@query("""SELECT n_nationkey AS crate_id, n_name AS crate_name, r_name AS region, coalesce(t.total, 0) AS crate_downloads FROM nation
    JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS total FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) t ON c_nationkey = n_nationkey""")
def etl_bridge(spark: SparkSession, folder: str) -> DataFrame:
    nations, regions, customers = (read_table(spark, folder, t) for t in ("nation", "region", "customer"))
    crates = nations.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    links = nations.select(F.col("n_nationkey").alias("crate_id"), F.col("n_regionkey").alias("region_id"))
    totals = customers.where("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("crate_id")).agg(F.count("*").alias("downloads"))
    other = regions.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("region_name"))
    return etl.bridge_table(crates, links, other, totals, link="region_id", columns={"region": "region_name"})


@query("SELECT o_orderkey AS version_id, o_custkey AS crate_id, o_orderpriority AS crate_name, o_orderstatus AS version, CAST(l_shipdate AS DATE) AS date, l_quantity AS downloads FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def etl_daily_facts(spark: SparkSession, folder: str) -> DataFrame:
    facts = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("version_id"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_quantity").alias("downloads"))
    names = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("crate_id"), F.col("o_orderpriority").alias("crate_name"), F.col("o_orderstatus").alias("version"))
    return etl.daily_table(facts, names)


@query("SELECT crate_name, sum(downloads)::BIGINT AS downloads FROM version_downloads_daily WHERE date >= DATE '2026-03-02' GROUP BY 1")
def rollup_30d(spark: SparkSession, folder: str) -> DataFrame:
    return etl.recent_totals(read_table(spark, folder, "version_downloads_daily"), "2026-03-02")


@query("SELECT version, sum(downloads)::BIGINT AS downloads FROM version_downloads_daily WHERE crate_name = 'vavitezu' GROUP BY 1")
def rollup_single_entity(spark: SparkSession, folder: str) -> DataFrame:
    return etl.version_totals(read_table(spark, folder, "version_downloads_daily"), "vavitezu")


# Joins over several crate tables.
@query("""SELECT owner_login, count(*) AS crates, coalesce(sum(total), 0)::BIGINT AS downloads FROM (SELECT DISTINCT owner_login, crate_id FROM crate_maintainers) m
    LEFT JOIN (SELECT crate_id, sum(downloads) AS total FROM (SELECT version_id, max(crate_id) AS crate_id, max(downloads) AS downloads FROM crates_versions GROUP BY 1) GROUP BY 1) USING (crate_id)
    GROUP BY 1""")
def join_portfolio(spark: SparkSession, folder: str) -> DataFrame:
    return relations.portfolios(read_table(spark, folder, "crate_maintainers"), read_table(spark, folder, "crates_versions"))


@query("""SELECT category_slug, sum(CASE WHEN date >= DATE '2026-03-01' THEN downloads END)::BIGINT AS late, sum(CASE WHEN date < DATE '2026-01-01' THEN downloads END)::BIGINT AS early
    FROM version_downloads_daily JOIN (SELECT DISTINCT crate_id, category_slug FROM crates_categories) USING (crate_id) GROUP BY 1""")
def join_category_growth(spark: SparkSession, folder: str) -> DataFrame:
    daily, categories = read_table(spark, folder, "version_downloads_daily"), read_table(spark, folder, "crates_categories")
    return relations.category_sums(daily, categories, late=F.col("date") >= "2026-03-01", early=F.col("date") < "2026-01-01")


@query("""WITH lic AS (SELECT version_id, min(license) AS license FROM crates_versions GROUP BY 1)
    SELECT v.license, count(DISTINCT e.parent_crate_id) AS crates FROM crates_dependencies e JOIN lic v ON v.version_id = e.version_id
    WHERE e.dep_crate_id IN (SELECT crate_id FROM crates_versions WHERE license LIKE 'GPL%') GROUP BY 1""")
def join_semi_audit(spark: SparkSession, folder: str) -> DataFrame:
    return relations.users_of_license(read_table(spark, folder, "crates_dependencies"), read_table(spark, folder, "crates_versions"), F.col("license").startswith("GPL"))


@query("""SELECT crate_id, wanted, downloads::BIGINT AS downloads FROM (SELECT dep_crate_id AS crate_id, count(*) AS wanted FROM crates_dependencies WHERE dep_crate_id IS NOT NULL GROUP BY 1)
    JOIN (SELECT crate_id, sum(downloads) AS downloads FROM version_downloads_daily GROUP BY 1) USING (crate_id)""")
def join_popularity_vs_volume(spark: SparkSession, folder: str) -> DataFrame:
    return relations.wanted_and_downloaded(read_table(spark, folder, "crates_dependencies"), read_table(spark, folder, "version_downloads_daily"))


@query("""WITH RECURSIVE edges AS (SELECT DISTINCT parent_crate_id AS source, dep_crate_id AS target FROM crates_dependencies WHERE parent_crate_id IS NOT NULL AND dep_crate_id IS NOT NULL),
    found(node, depth) AS (SELECT DISTINCT crate_id, 0 FROM crates_categories WHERE category_slug = 'clock-sync' AND crate_id IS NOT NULL
      UNION SELECT target, depth + 1 FROM edges JOIN found ON source = node WHERE depth < 5)
    SELECT node, min(depth) AS depth FROM found GROUP BY 1""")
def closure_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    edges = read_table(spark, folder, "crates_dependencies").select(F.col("parent_crate_id").alias("source"), F.col("dep_crate_id").alias("target"))
    starts = read_table(spark, folder, "crates_categories").where(F.col("category_slug") == "clock-sync").select(F.col("crate_id").alias("node"))
    return reachable(edges, starts, 5)


@query("""WITH RECURSIVE place(kind, id, name, depth) AS (SELECT 'region', r_regionkey, r_name, 0 FROM region WHERE r_name IN ('ASIA', 'EUROPE')
    UNION ALL SELECT 'nation', n_nationkey, n_name, depth + 1 FROM nation JOIN place ON kind = 'region' AND n_regionkey = id) SELECT kind, id, name, depth FROM place""")
def recursive_closure(spark: SparkSession, folder: str) -> DataFrame:
    regions, nations = read_table(spark, folder, "region"), read_table(spark, folder, "nation")
    edges = nations.select(F.concat(F.lit("r"), "n_regionkey").alias("source"), F.concat(F.lit("n"), "n_nationkey").alias("target"))
    starts = regions.where(F.col("r_name").isin("ASIA", "EUROPE")).select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    names = regions.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("region").alias("kind"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).unionByName(
        nations.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit("nation").alias("kind"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    )
    return reachable(edges, starts).join(names, "node").select("kind", "id", "name", "depth")


# Explorer.
DRAFT_TABLES = {"crates": "crates_versions", "dependencies": "crates_dependencies", "categories": "crates_categories", "maintainers": "crate_maintainers", "trends": "version_downloads_daily"}
for _kind in drafts.KINDS:
    if _kind in DRAFT_TABLES:
        _plan(f"draft_default_{_kind}", DRAFT_TABLES[_kind], drafts.build_query_plan(drafts.default_draft(_kind)))
for _name in ("license_shares", "category_sizes", "rivals"):
    _plan(f"draft_of_{_name}", CATALOG[_name].table, drafts.build_query_plan(drafts.draft_of(CATALOG[_name].plan)))
_plan("draft_search", "crates_versions", drafts.build_query_plan(drafts.QueryDraft("search", "fohe", "crate_name", (drafts.FilterDraft("downloads", ">", "100"),))))
_plan("draft_aggregate", "crates_versions", drafts.build_query_plan(drafts.QueryDraft("aggregate", filters=(drafts.FilterDraft("edition", "in", "2018, 2021"),), group_keys=("license",), agg_column="downloads")))
_plan("draft_table", "crates_dependencies", drafts.build_query_plan(drafts.QueryDraft("table", filters=(drafts.FilterDraft("kind", "between", "1,2"),), select_columns=("parent_crate_name", "dep_crate_name"))))


@query("SELECT license, count(*) AS count, round(sum(downloads::DOUBLE), 4) AS sum FROM crates_versions WHERE license IS NOT NULL GROUP BY 1 ORDER BY coalesce(sum(downloads::DOUBLE), 0) DESC, license LIMIT 14")
def summary_rank(spark: SparkSession, folder: str) -> DataFrame:
    groups = execute(_table(spark, folder, "crates_versions"), build_plan(groupBy={"keys": ["license"], "value": "downloads"})).groups
    return summary.ranked_groups(groups, ["license"]).select("license", "count", F.round("sum", 4).alias("sum"))


@query("""SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_linenumber END)::DOUBLE AS "F", sum(CASE WHEN l_linestatus = 'O' THEN l_linenumber END)::DOUBLE AS "O" FROM lineitem GROUP BY 1""")
def summary_pivot(spark: SparkSession, folder: str) -> DataFrame:
    groups = execute(_table(spark, folder, "lineitem"), build_plan(groupBy={"keys": ["l_returnflag", "l_linestatus"], "value": "l_linenumber"})).groups
    return summary.pivoted(groups, ["l_returnflag", "l_linestatus"])


@query("""WITH per AS (SELECT crate_name, license, count(*) AS n, sum(downloads) AS total, count(*) FILTER (WHERE yanked) AS flagged FROM crates_versions WHERE crate_name IS NOT NULL GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY crate_name ORDER BY license IS NULL, n DESC, license) AS rn FROM per)
    SELECT crate_name, sum(n)::BIGINT AS rows, coalesce(sum(total), 0)::BIGINT AS total, sum(flagged)::BIGINT AS flagged, max(license) FILTER (WHERE rn = 1) AS top_category FROM best GROUP BY 1""")
def detail_profile(spark: SparkSession, folder: str) -> DataFrame:
    return summary.entity_profile(read_table(spark, folder, "crates_versions"), "crate_name", "downloads", "yanked", "license")


# Sketches, days, skew.
@query("SELECT event_type, true AS within FROM events GROUP BY 1")
def hll_rollup_bound(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    merged = sketch.merged(sketch.sketches(events, ["event_type", "day"], "user_id"), ["event_type"])
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return merged.join(exact, "event_type").select("event_type", (F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 6 * sketch.STANDARD_ERROR + 1).alias("within"))


_sql("hll_grouped_exact", "events", "SELECT event_type, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type")


@query("SELECT date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day, count(*) AS n FROM orders GROUP BY 1")
def epoch_days(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").groupBy(as_epoch_day(F.col("o_orderdate")).alias("day")).agg(F.count("*").alias("n"))


@query("SELECT dep_crate_name, count(*) AS n FROM crates_dependencies GROUP BY 1")
def skewed_counts(spark: SparkSession, folder: str) -> DataFrame:
    from quarry.synth import salted_counts

    return salted_counts(read_table(spark, folder, "crates_dependencies"), "dep_crate_name")
