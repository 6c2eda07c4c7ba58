"""Data-quality and skew queries over the crate tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import heavy_keys, packed, references, rolling, snapshots
from quarry.sources.tables import read_table

HEAVY_SHARE = 0.02


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_references(
        read_table(spark, folder, "crates_dependencies"),
        read_table(spark, folder, "crates_versions"),
        read_table(spark, folder, "crate_deletions"),
        record="dependency_id", at="recorded_at", ref_id="dep_crate_id", ref_name="dep_crate_name",
        parent=("crate_id", "crate_name", "published_date"), removal=("crate_id", "crate_name", "deleted_at"),
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("dependency_id", F.date_format("recorded_at", "yyyy-MM").alias("period"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return references.orphan_report(_orphans(spark, folder), "crates_dependencies", "recorded_at")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return packed.split_packed(read_table(spark, folder, "crates_versions"), key="version_id", field="license", at_least=2)


def p3_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many versions carry each single license name, and at which first position at the earliest."""
    items = packed.split_packed(read_table(spark, folder, "crates_versions"), key="version_id", field="license")
    return items.groupBy("item").agg(F.count_distinct("version_id").alias("versions"), F.min("pos").alias("first_pos"))


def _series(spark: SparkSession, folder: str) -> DataFrame:
    fields = ["snapshot_date", "version_id", "downloads", "yanked"]
    old, new = (read_table(spark, folder, t).select(*fields) for t in ("crates_versions_snapshots", "crates_versions"))
    return old.unionByName(new)


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.diff_snapshots(_series(spark, folder), snapshot="snapshot_date", key="version_id", compare=["downloads", "yanked"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _changes(spark, folder).select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "version_id", "change")


def p5_values(spark: SparkSession, folder: str) -> DataFrame:
    changes = snapshots.with_values(
        _changes(spark, folder), _series(spark, folder), snapshot="snapshot_date", key="version_id", fields=["downloads", "yanked"]
    )
    return changes.withColumn("snapshot_date", F.date_format("snapshot_date", "yyyy-MM-dd"))


SKEWED = (("crates_dependencies", "dep_crate_name", None), ("version_downloads_daily", "crate_name", "downloads"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    first, second = (
        heavy_keys.heavy_keys(read_table(spark, folder, table), key, HEAVY_SHARE).select(F.lit(table).alias("table_name"), F.col("key").alias("key_value"))
        for table, key, _ in SKEWED
    )
    return first.unionByName(second)


def p6_totals(spark: SparkSession, folder: str) -> DataFrame:
    first, second = (
        heavy_keys.key_totals(read_table(spark, folder, table), key, value).select(F.lit(table).alias("table_name"), F.col("key").alias("key_value"), "rows", "total")
        for table, key, value in SKEWED
    )
    return first.unionByName(second)


def _rolling(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "version_downloads_daily")
    latest = rolling.latest_rows(rows, ["version_id", "date"], "recorded_at", "downloads", "crate_name")
    return rolling.rolling_totals(rolling.daily_totals(latest, entity="crate_name", day="date", value="downloads"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    idle = _rolling(spark, folder).where((F.col("total_7") == 0) & (F.col("total_30") > 0))
    return idle.select(F.col("entity").alias("crate_name"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def p7_rolling(spark: SparkSession, folder: str) -> DataFrame:
    return _rolling(spark, folder).select(
        F.col("entity").alias("crate_name"), F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "total_7",
        F.round("average_7", 6).alias("average_7"), "total_30", F.round("average_30", 6).alias("average_30"),
    )


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_report, p3_found, p3_items, p5_found, p5_values, p6_found, p6_totals, p7_found, p7_rolling)
}

_NORM = "nullif(replace(lower(regexp_extract({0}, '^\\s*(\\S+)', 1)), '_', '-'), '')"
_ORPHANS = f"""
WITH refs AS (
  SELECT dependency_id, min(recorded_at) AS recorded_at,
         arg_min(coalesce('#' || dep_crate_id, '@' || {_NORM.format("dep_crate_name")}), recorded_at) AS k
  FROM crates_dependencies GROUP BY dependency_id),
crates AS (SELECT crate_id, min(published_date) AS since FROM crates_versions GROUP BY crate_id),
names AS (
  SELECT DISTINCT crate_id, {_NORM.format("crate_name")} AS nm FROM crates_versions WHERE crate_name IS NOT NULL
  UNION SELECT DISTINCT crate_id, {_NORM.format("crate_name")} FROM crate_deletions WHERE crate_name IS NOT NULL),
keys AS (SELECT crate_id, '#' || crate_id AS k FROM (SELECT crate_id FROM crates UNION SELECT crate_id FROM crate_deletions)
  UNION SELECT crate_id, '@' || nm FROM names),
facts AS (SELECT k, bool_or(c.crate_id IS NOT NULL) AS known, min(c.since) AS since, min(d.deleted_at) AS gone
  FROM keys LEFT JOIN crates c USING (crate_id) LEFT JOIN crate_deletions d USING (crate_id) GROUP BY k),
orphans AS (SELECT dependency_id, recorded_at, refs.k,
  CASE WHEN known IS NOT TRUE THEN 'missing' WHEN since > recorded_at THEN 'later' WHEN gone <= recorded_at THEN 'removed' END AS reason
  FROM refs LEFT JOIN facts USING (k) WHERE refs.k IS NOT NULL)
"""
_TOKEN = r"""'"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[A-Za-z0-9][A-Za-z0-9.+''-]*|[^A-Za-z0-9 \t"'']'"""
_ITEMS = f"""
WITH once AS (SELECT version_id, min(license) AS license FROM crates_versions GROUP BY version_id),
tokens AS (SELECT version_id, unnest(t) AS tok, generate_subscripts(t, 1) AS nth FROM (
  SELECT version_id, regexp_extract_all(license, {_TOKEN}) AS t FROM once WHERE license IS NOT NULL)),
kinds AS (SELECT *, tok[1] IN ('"', '''') AS quoted, lower(tok) IN ('and', 'or') OR NOT regexp_matches(tok, '[A-Za-z0-9]') AS sep FROM tokens),
grouped AS (SELECT *, sum(CASE WHEN sep OR quoted THEN 1 ELSE 0 END) OVER (PARTITION BY version_id ORDER BY nth) AS grp FROM kinds),
pieces AS (SELECT version_id, grp, quoted, min(nth) AS nth, string_agg(tok, ' ' ORDER BY nth) AS piece
  FROM grouped WHERE NOT sep GROUP BY version_id, grp, quoted),
items AS (SELECT version_id, row_number() OVER (PARTITION BY version_id ORDER BY nth) AS pos,
  CASE WHEN quoted THEN trim(replace(piece[2:-2], repeat(piece[1], 2), piece[1])) ELSE piece END AS item FROM pieces)
"""
_CHANGES = """
WITH rows AS (SELECT DISTINCT snapshot_date, version_id, downloads, yanked FROM (
  SELECT snapshot_date, version_id, downloads, yanked FROM crates_versions_snapshots
  UNION ALL SELECT snapshot_date, version_id, downloads, yanked FROM crates_versions)),
steps AS (SELECT snapshot_date AS later, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS earlier FROM (SELECT DISTINCT snapshot_date FROM rows)),
a AS (SELECT s.later, r.* FROM rows r JOIN steps s ON r.snapshot_date = s.later WHERE s.earlier IS NOT NULL),
b AS (SELECT s.later, r.* FROM rows r JOIN steps s ON r.snapshot_date = s.earlier),
changes AS (SELECT strftime(coalesce(a.later, b.later), '%Y-%m-%d') AS snapshot_date, coalesce(a.version_id, b.version_id) AS version_id,
  CASE WHEN b.version_id IS NULL THEN 'added' WHEN a.version_id IS NULL THEN 'removed' ELSE 'changed' END AS change, a.downloads, a.yanked
  FROM a FULL JOIN b ON a.later = b.later AND a.version_id = b.version_id
  WHERE a.version_id IS NULL OR b.version_id IS NULL OR a.downloads IS DISTINCT FROM b.downloads OR a.yanked IS DISTINCT FROM b.yanked)
"""
_ROLLING = """
WITH latest AS (SELECT version_id, date, arg_max(crate_name, recorded_at) AS crate_name,
  max(struct_pack(r := recorded_at, d := coalesce(downloads, -1))).d AS downloads FROM version_downloads_daily GROUP BY version_id, date),
daily AS (SELECT crate_name, date AS day, sum(greatest(downloads, 0)) AS total FROM latest WHERE crate_name IS NOT NULL GROUP BY 1, 2),
days AS (SELECT crate_name, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::date AS day FROM daily GROUP BY 1),
filled AS (SELECT crate_name, day, coalesce(total, 0) AS total FROM days LEFT JOIN daily USING (crate_name, day)),
rolled AS (SELECT crate_name, strftime(day, '%Y-%m-%d') AS day, total::BIGINT AS total,
  sum(total) OVER (PARTITION BY crate_name ORDER BY filled.day ROWS 6 PRECEDING)::BIGINT AS total_7,
  sum(total) OVER (PARTITION BY crate_name ORDER BY filled.day ROWS 29 PRECEDING)::BIGINT AS total_30 FROM filled)
"""
_TOTALS = """
SELECT 'crates_dependencies' AS table_name, dep_crate_name AS key_value, count(*) AS rows, 0::BIGINT AS total FROM crates_dependencies GROUP BY 2
UNION ALL SELECT 'version_downloads_daily', crate_name, count(*), coalesce(sum(downloads), 0)::BIGINT FROM version_downloads_daily GROUP BY 2
"""

ORACLES = {
    "p2_found": _ORPHANS + "SELECT dependency_id, strftime(recorded_at, '%Y-%m') AS period FROM orphans WHERE reason IS NOT NULL",
    "p2_report": _ORPHANS
    + """SELECT 'crates_dependencies' AS table_name, strftime(recorded_at, '%Y-%m') AS period, reason, count(*) AS orphans,
         count(DISTINCT k) AS keys FROM orphans WHERE reason IS NOT NULL GROUP BY ALL""",
    "p3_found": _ITEMS + "SELECT version_id, pos::INTEGER AS pos, item FROM items WHERE version_id IN (SELECT version_id FROM items WHERE pos = 2)",
    "p3_items": _ITEMS + "SELECT item, count(DISTINCT version_id) AS versions, min(pos)::INTEGER AS first_pos FROM items GROUP BY item",
    "p5_found": _CHANGES + "SELECT snapshot_date, version_id, change FROM changes",
    "p5_values": _CHANGES + "SELECT snapshot_date, version_id, change, downloads, yanked FROM changes",
    "p6_found": f"""WITH t AS ({_TOTALS}), w AS (SELECT table_name, sum(rows) AS whole FROM t GROUP BY 1)
        SELECT table_name, key_value FROM t JOIN w USING (table_name) WHERE key_value IS NOT NULL AND rows >= {HEAVY_SHARE} * whole""",
    "p6_totals": _TOTALS,
    "p7_found": _ROLLING + "SELECT crate_name, day FROM rolled WHERE total_7 = 0 AND total_30 > 0",
    "p7_rolling": _ROLLING
    + "SELECT crate_name, day, total, total_7, round(total_7 / 7.0, 6) AS average_7, total_30, round(total_30 / 30.0, 6) AS average_30 FROM rolled",
}
