import pytest

from quarry import UnsupportedSqlError
from quarry.plans.sql import check_strict, normalise
from quarry.sources.tables import Table

HITS = [
    (i, 1000 + i % 7, 435090932899640449 + i % 3, i % 4, i % 3, 15887 + i % 30, 1373000000 + 37 * i, ["", "http://www.google.com/a/b", "https://x.org/p"][i % 3], ["", "cats", "dogs", None][i % 4], 800 + i % 5, i % 2)
    for i in range(400)
]
SCHEMA = "WatchID long, ClientIP int, UserID long, CounterID int, AdvEngineID int, EventDate int, EventTime long, URL string, SearchPhrase string, ResolutionWidth int, IsRefresh int"


@pytest.fixture(scope="module")
def hits(spark):
    return Table("hits", spark.createDataFrame(HITS, SCHEMA).coalesce(1))


def test_dialect_rewrites():
    assert normalise("SELECT a FROM t OFFSET 10 LIMIT 5;") == "SELECT a FROM t LIMIT 5 OFFSET 10"
    assert normalise("SELECT STRLEN(a) FROM t") == "SELECT length(a) FROM t"
    assert normalise("SELECT extract('minute', toDateTime(x)) FROM t", {"x"}) == "SELECT extract(minute FROM (TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, x))) FROM t"
    assert normalise("SELECT 1, u, COUNT(*) FROM t GROUP BY 1, u ORDER BY u") == "SELECT 1, u, COUNT(*) FROM t GROUP BY u ORDER BY u"
    assert normalise("SELECT a FROM t WHERE d >= '2013-07-01'", {"d"}) == "SELECT a FROM t WHERE d >= 15887"
    assert normalise("SELECT a FROM t WHERE d = '2013-07-01'") == "SELECT a FROM t WHERE d = '2013-07-01'"
    assert normalise(r"SELECT REGEXP_REPLACE(a, '^(x)\.', '\1') FROM t") == r"SELECT regexp_replace(a, '^(x)\\.', '$1') FROM t"
    assert normalise("SELECT 'it''s', \"A b\" FROM t") == r"SELECT 'it\'s', `A b` FROM t"


# Fixed values, some as published: shapes of the public web-analytics statements, in their dialect, with the answers by plain Python.
STATEMENTS = [
    ("SELECT COUNT(*) FROM hits", lambda h: [(len(h),)]),
    ("SELECT COUNT(*) FROM hits WHERE AdvEngineID <> 0", lambda h: [(sum(r[4] != 0 for r in h),)]),
    ("SELECT COUNT(DISTINCT UserID) FROM hits", lambda h: [(len({r[2] for r in h}),)]),
    ("SELECT MIN(EventDate), MAX(EventDate) FROM hits", lambda h: [(min(r[5] for r in h), max(r[5] for r in h))]),
    ("SELECT UserID FROM hits WHERE UserID = 435090932899640450 LIMIT 1", lambda h: [(435090932899640450,)]),
    ("SELECT COUNT(*) FROM hits WHERE URL LIKE '%google%'", lambda h: [(sum("google" in r[7] for r in h),)]),
    ("SELECT SearchPhrase, COUNT(*) AS c FROM hits WHERE SearchPhrase <> '' GROUP BY SearchPhrase ORDER BY c DESC, SearchPhrase LIMIT 10", lambda h: [("cats", 100), ("dogs", 100)]),
    ("SELECT SearchPhrase, MIN(URL), COUNT(*) AS c FROM hits WHERE URL NOT LIKE '%.google.%' AND SearchPhrase <> '' GROUP BY SearchPhrase ORDER BY SearchPhrase LIMIT 1", lambda h: [("cats", "", sum(r[8] == "cats" and "google" not in r[7] for r in h))]),
    ("SELECT CounterID, AVG(STRLEN(URL)) AS l, COUNT(*) AS c FROM hits WHERE URL <> '' GROUP BY CounterID HAVING COUNT(*) > 1000 ORDER BY l DESC LIMIT 25", lambda h: []),
    (r"SELECT REGEXP_REPLACE(URL, '^https?://(?:www\.)?([^/]+)/.*$', '\1') AS k, COUNT(*) AS c FROM hits WHERE URL <> '' GROUP BY k ORDER BY k", lambda h: [("google.com", 133), ("x.org", 133)]),
    ("SELECT 1, URL, COUNT(*) AS c FROM hits GROUP BY 1, URL ORDER BY c DESC, URL LIMIT 1", lambda h: [(1, "", 134)]),
    ("SELECT ClientIP, ClientIP - 1, COUNT(*) AS c FROM hits GROUP BY ClientIP, ClientIP - 1 ORDER BY c DESC, ClientIP LIMIT 1", lambda h: [(1000, 999, 58)]),
    ("SELECT COUNT(*) FROM hits WHERE EventDate >= '2013-07-01' AND EventDate <= '2013-07-02' AND IsRefresh = 0", lambda h: [(sum(15887 <= r[5] <= 15888 and r[10] == 0 for r in h),)]),
    ("SELECT URL, COUNT(*) AS PageViews FROM hits GROUP BY URL ORDER BY PageViews DESC, URL OFFSET 1 LIMIT 1", lambda h: [("http://www.google.com/a/b", 133)]),
    ("SELECT CASE WHEN (CounterID = 0 AND AdvEngineID = 0) THEN URL ELSE '' END AS Src, COUNT(*) AS c FROM hits GROUP BY Src ORDER BY c DESC LIMIT 1 OFFSET 0", lambda h: [("", 400)]),
    ("SELECT DATE_TRUNC('minute', toDateTime(EventTime)) AS M, COUNT(*) AS c FROM hits GROUP BY DATE_TRUNC('minute', toDateTime(EventTime)) ORDER BY c DESC LIMIT 0", lambda h: []),
    ("SELECT extract(minute FROM toDateTime(EventTime)) AS m, COUNT(*) AS c FROM hits GROUP BY m ORDER BY m LIMIT 0", lambda h: []),
    ("SELECT extract(hour FROM toDateTime(EventTime)) AS h, extract(minute FROM toDateTime(EventTime)) AS m FROM hits WHERE WatchID = 5", lambda h: [(4, 56)]),
    ("SELECT SUM(ResolutionWidth), SUM(ResolutionWidth + 1) FROM hits", lambda h: [(sum(r[9] for r in h), sum(r[9] + 1 for r in h))]),
]


@pytest.mark.parametrize(("text", "answer"), STATEMENTS)
def test_statement(hits, text, answer):
    assert [tuple(r) for r in hits.sql(text).collect()] == answer(HITS)


def test_any_table_name_and_row_ids(hits):
    from quarry.plans.sql import run_sql

    assert hits.sql("SELECT COUNT(*) FROM anything").collect()[0][0] == 400
    assert [r[0] for r in run_sql(Table("hits", hits.df.withColumn("__row_id", hits.df.WatchID)), "SELECT __row_id FROM h WHERE CounterID = 3 LIMIT 2", row_ids=True).collect()] == [3, 7]


@pytest.mark.parametrize(
    ("text", "answer"),
    [
        ("SELECT COUNT(*) FROM hits WHERE SearchPhrase = 'from hits'", 0),
        ("SELECT COUNT(*) FROM hits WHERE SearchPhrase <> 'FROM hits AS x' AND URL <> 'x from  hits'", 300),
        ("SELECT COUNT(*), 'a from hits' AS b FROM hits", 400),
        ("SELECT COUNT(*) FROM hits AS h WHERE h.CounterID = 1", 100),
        ("SELECT COUNT(*) FROM hits h WHERE h.CounterID = 1", 100),
        ("SELECT COUNT(hits.CounterID) FROM hits WHERE hits.CounterID = 1", 100),
        ("SELECT COUNT(*) FROM hits WHERE UserID IN (SELECT UserID FROM hits WHERE CounterID = 1 AND WatchID < 2)", 133),
        ("SELECT COUNT(*) FROM hits WHERE extract(minute FROM toDateTime(EventTime)) >= 0", 400),
    ],
)
def test_table_names_in_odd_places(spark, hits, text, answer):
    before = len(spark.catalog.listTables())
    assert hits.sql(text).collect()[0][0] == answer
    assert len(spark.catalog.listTables()) == before


@pytest.mark.parametrize("text", ["SELECT a FROM t", "SELECT COUNT(*), SUM(a + 1) FROM t WHERE a = 1 AND b LIKE '%x%' GROUP BY c ORDER BY c LIMIT 3", "SELECT * FROM t WHERE a IN (1, -2) OFFSET 2 LIMIT 1;", "SELECT 1"])
def test_strict_accepts(text):
    if "FROM" in text:
        check_strict(text)
    else:
        with pytest.raises(UnsupportedSqlError):
            check_strict(text)


@pytest.mark.parametrize("text", ["SELECT a FROM t JOIN u ON a = b", "SELECT a FROM t WHERE a = 1 OR b = 2", "SELECT a FROM (SELECT b FROM t)", "SELECT CASE WHEN a THEN b END FROM t", "SELECT a FROM t WHERE a > 1.5", "SELECT a * 2 FROM t", "SELECT approx_count_distinct(DISTINCT a) FROM t", "DELETE FROM t"])
def test_strict_rejects(text):
    with pytest.raises(UnsupportedSqlError):
        check_strict(text)


def test_seconds_do_not_depend_on_the_session_zone(spark, hits):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        assert tuple(hits.sql("SELECT extract(hour FROM toDateTime(EventTime)), extract(minute FROM toDateTime(EventTime)) FROM hits WHERE WatchID = 5").collect()[0]) == (4, 56)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
