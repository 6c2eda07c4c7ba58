"""The shapes of the public web-analytics statements, on a table of page visits made from the order lines.

The statements are in the analytics dialect the SQL front door takes: STRLEN, OFFSET before LIMIT, constants as
group keys, ISO days for integer days, seconds by toDateTime. Ties are broken so that every result is defined.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.schema import epoch_day
from quarry.sources.tables import Table, read_table

#: The columns of a visit, in SQL that both engines read; {day} is the day number of the shipping date.
COLUMNS = """
  l_orderkey * 8 + l_linenumber AS visit, 435090932899640000 + l_partkey * 7 AS visitor, l_partkey % 90 AS site, l_suppkey % 37 AS region,
  CASE WHEN l_linenumber = 7 THEN CAST(l_suppkey % 20 AS INTEGER) ELSE 0 END AS campaign, CAST(l_partkey * 7919 % 60000 AS INTEGER) AS address,
  {day} AS day, CAST({day} AS BIGINT) * 86400 + l_orderkey * 37 % 86400 AS moment,
  CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE 'http://' || CASE WHEN l_suppkey % 3 = 0 THEN 'www.' ELSE '' END || 'shop' || CAST(l_suppkey % 25 AS VARCHAR(9)) || '.org/part/' || CAST(l_partkey % 400 AS VARCHAR(9)) END AS url,
  CASE WHEN l_linenumber = 1 THEN '' ELSE 'Part ' || CAST(l_partkey % 300 AS VARCHAR(9)) || ' of ' || l_returnflag END AS title,
  CASE WHEN l_linenumber % 4 = 1 THEN '' ELSE 'https://' || CASE WHEN l_partkey % 2 = 0 THEN 'www.' ELSE '' END || 'find' || CAST(l_partkey % 11 AS VARCHAR(9)) || '.net/q/' || CAST(l_suppkey % 60 AS VARCHAR(9)) END AS referrer,
  CASE WHEN l_linenumber > 2 THEN '' ELSE 'word ' || CAST(l_partkey % 120 AS VARCHAR(9)) END AS phrase,
  CASE WHEN l_suppkey % 6 = 0 THEN 'model ' || CAST(l_suppkey % 14 AS VARCHAR(9)) ELSE '' END AS phone_model, CAST(l_suppkey % 5 AS INTEGER) AS phone,
  CAST(l_partkey % 9 AS INTEGER) AS engine, CAST(l_suppkey % 8 AS INTEGER) - 1 AS source, CAST(l_quantity AS INTEGER) * 16 AS width, CAST(l_linenumber AS INTEGER) * 120 AS height,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS refresh, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS link, CASE WHEN l_linenumber = 6 THEN 1 ELSE 0 END AS download, CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END AS hidden,
  2868770270353813622 + l_partkey % 400 AS url_hash, 3594120000172545465 + l_suppkey % 60 AS referrer_hash
"""
_SPARK_DAY, _DUCK_DAY = "unix_date(CAST(l_shipdate AS DATE))", "CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INTEGER)"

_SPAN = "day >= '1997-07-01' AND day <= '1998-06-30'"
# The shapes are those of the published statements, one by one; columns and values are of this table.
STATEMENTS = {
    "count": "SELECT COUNT(*) AS n FROM visits",
    "count_where": "SELECT COUNT(*) AS n FROM visits WHERE campaign <> 0",
    "sum_count_avg": "SELECT SUM(campaign) AS s, COUNT(*) AS n, ROUND(AVG(width), 6) AS w FROM visits",
    "avg_large": "SELECT ROUND(AVG(visitor) / 1000000, 0) AS v FROM visits",
    "distinct_numbers": "SELECT COUNT(DISTINCT visitor) AS n FROM visits",
    "distinct_texts": "SELECT COUNT(DISTINCT phrase) AS n FROM visits",
    "first_last_day": "SELECT MIN(day) AS low, MAX(day) AS high FROM visits",
    "by_campaign": "SELECT campaign, COUNT(*) AS n FROM visits WHERE campaign <> 0 GROUP BY campaign ORDER BY COUNT(*) DESC, campaign",
    "region_visitors": "SELECT region, COUNT(DISTINCT visitor) AS u FROM visits GROUP BY region ORDER BY u DESC, region LIMIT 10",
    "region_figures": "SELECT region, SUM(campaign) AS s, COUNT(*) AS c, ROUND(AVG(width), 6) AS w, COUNT(DISTINCT visitor) AS u FROM visits GROUP BY region ORDER BY c DESC, region LIMIT 10",
    "models": "SELECT phone_model, COUNT(DISTINCT visitor) AS u FROM visits WHERE phone_model <> '' GROUP BY phone_model ORDER BY u DESC, phone_model LIMIT 10",
    "phones_and_models": "SELECT phone, phone_model, COUNT(DISTINCT visitor) AS u FROM visits WHERE phone_model <> '' GROUP BY phone, phone_model ORDER BY u DESC, phone, phone_model LIMIT 10",
    "phrases": "SELECT phrase, COUNT(*) AS c FROM visits WHERE phrase <> '' GROUP BY phrase ORDER BY c DESC, phrase LIMIT 10",
    "phrase_visitors": "SELECT phrase, COUNT(DISTINCT visitor) AS u FROM visits WHERE phrase <> '' GROUP BY phrase ORDER BY u DESC, phrase LIMIT 10",
    "engines_and_phrases": "SELECT engine, phrase, COUNT(*) AS c FROM visits WHERE phrase <> '' GROUP BY engine, phrase ORDER BY c DESC, engine, phrase LIMIT 10",
    "visitors": "SELECT visitor, COUNT(*) AS c FROM visits GROUP BY visitor ORDER BY COUNT(*) DESC, visitor LIMIT 10",
    "visitors_and_phrases": "SELECT visitor, phrase, COUNT(*) AS c FROM visits GROUP BY visitor, phrase ORDER BY COUNT(*) DESC, visitor, phrase LIMIT 10",
    "visitors_and_phrases_any": "SELECT visitor, phrase, COUNT(*) AS c FROM visits GROUP BY visitor, phrase",
    "visitors_by_minute": "SELECT visitor, extract(minute FROM toDateTime(moment)) AS m, phrase, COUNT(*) AS c FROM visits GROUP BY visitor, m, phrase ORDER BY COUNT(*) DESC, visitor, m, phrase LIMIT 10",
    "one_visitor": "SELECT visitor FROM visits WHERE visitor = 435090932899640700",
    "url_contains": "SELECT COUNT(*) AS n FROM visits WHERE url LIKE '%shop7%'",
    "first_url_of_phrase": "SELECT phrase, MIN(url) AS first, COUNT(*) AS c FROM visits WHERE url LIKE '%shop7%' AND phrase <> '' GROUP BY phrase ORDER BY c DESC, phrase LIMIT 10",
    "titles_but_not_urls": "SELECT phrase, MIN(url) AS first, MIN(title) AS named, COUNT(*) AS c, COUNT(DISTINCT visitor) AS u FROM visits WHERE title LIKE '%Part 1%' AND url NOT LIKE '%.shop1.%' AND phrase <> '' GROUP BY phrase ORDER BY c DESC, phrase LIMIT 10",
    "whole_rows": "SELECT * FROM visits WHERE url LIKE '%shop7%' ORDER BY moment, visit LIMIT 10",
    "phrases_by_time": "SELECT phrase FROM visits WHERE phrase <> '' ORDER BY moment, visit LIMIT 10",
    "phrases_by_text": "SELECT phrase FROM visits WHERE phrase <> '' ORDER BY phrase LIMIT 10",
    "phrases_by_time_and_text": "SELECT phrase FROM visits WHERE phrase <> '' ORDER BY moment, phrase LIMIT 10",
    "url_lengths": "SELECT site, ROUND(AVG(STRLEN(url)), 6) AS l, COUNT(*) AS c FROM visits WHERE url <> '' GROUP BY site HAVING COUNT(*) > 50 ORDER BY l DESC, site LIMIT 25",
    "referring_hosts": r"SELECT REGEXP_REPLACE(referrer, '^https?://(?:www\.)?([^/]+)/.*$', '\1') AS k, ROUND(AVG(STRLEN(referrer)), 6) AS l, COUNT(*) AS c, MIN(referrer) AS low FROM visits WHERE referrer <> '' GROUP BY k HAVING COUNT(*) > 50 ORDER BY l DESC, k LIMIT 25",
    "ninety_sums": "SELECT " + ", ".join(f"SUM(width + {k}) AS s{k}" for k in range(90)) + " FROM visits",
    "engines_and_addresses": "SELECT engine, address, COUNT(*) AS c, SUM(refresh) AS r, ROUND(AVG(width), 6) AS w FROM visits WHERE phrase <> '' GROUP BY engine, address ORDER BY c DESC, engine, address LIMIT 10",
    "visits_and_addresses_searched": "SELECT visit, address, COUNT(*) AS c, SUM(refresh) AS r, ROUND(AVG(width), 6) AS w FROM visits WHERE phrase <> '' GROUP BY visit, address ORDER BY c DESC, visit, address LIMIT 10",
    "visits_and_addresses": "SELECT visit, address, COUNT(*) AS c, SUM(refresh) AS r, ROUND(AVG(width), 6) AS w FROM visits GROUP BY visit, address ORDER BY c DESC, visit, address LIMIT 10",
    "urls": "SELECT url, COUNT(*) AS c FROM visits GROUP BY url ORDER BY c DESC, url LIMIT 10",
    "one_and_urls": "SELECT 1 AS one, url, COUNT(*) AS c FROM visits GROUP BY 1, url ORDER BY c DESC, url LIMIT 10",
    "shifted_addresses": "SELECT address, address - 1 AS a, address - 2 AS b, address - 3 AS d, COUNT(*) AS c FROM visits GROUP BY address, address - 1, address - 2, address - 3 ORDER BY c DESC, address LIMIT 10",
    "page_views": f"SELECT url, COUNT(*) AS views FROM visits WHERE site = 62 AND {_SPAN} AND hidden = 0 AND refresh = 0 AND url <> '' GROUP BY url ORDER BY views DESC, url LIMIT 10",
    "title_views": f"SELECT title, COUNT(*) AS views FROM visits WHERE site = 62 AND {_SPAN} AND hidden = 0 AND refresh = 0 AND title <> '' GROUP BY title ORDER BY views DESC, title LIMIT 10",
    "links_later_page": f"SELECT url, COUNT(*) AS views FROM visits WHERE site < 62 AND {_SPAN} AND refresh = 0 AND link <> 0 AND download = 0 GROUP BY url ORDER BY views DESC, url OFFSET 30 LIMIT 10",
    "sources_and_targets": f"SELECT source, engine, campaign, CASE WHEN (engine = 0 AND campaign = 0) THEN referrer ELSE '' END AS src, url AS dst, COUNT(*) AS views FROM visits WHERE site < 62 AND {_SPAN} AND refresh = 0 GROUP BY source, engine, campaign, src, dst ORDER BY views DESC, source, engine, campaign, src, dst OFFSET 100 LIMIT 10",
    "hashes_by_day": f"SELECT url_hash, day, COUNT(*) AS views FROM visits WHERE site < 62 AND {_SPAN} AND refresh = 0 AND source IN (-1, 6) AND referrer_hash = 3594120000172545472 GROUP BY url_hash, day ORDER BY views DESC, url_hash, day OFFSET 1 LIMIT 10",
    "window_sizes": f"SELECT width, height, COUNT(*) AS views FROM visits WHERE site < 62 AND {_SPAN} AND refresh = 0 AND hidden = 0 AND url_hash = 2868770270353813630 GROUP BY width, height ORDER BY views DESC, width, height OFFSET 1 LIMIT 10",
    "minutes": f"SELECT DATE_TRUNC('minute', toDateTime(moment)) AS m, COUNT(*) AS views FROM visits WHERE site < 62 AND {_SPAN} AND refresh = 0 AND hidden = 0 GROUP BY DATE_TRUNC('minute', toDateTime(moment)) ORDER BY DATE_TRUNC('minute', toDateTime(moment)) OFFSET 100 LIMIT 10",
}


def visits(spark: SparkSession, folder: str) -> Table:
    columns = COLUMNS.format(day=_SPARK_DAY).split("\n")
    text = " ".join(columns).replace("VARCHAR(9)", "STRING")
    lines = read_table(spark, folder, "lineitem")
    return Table("visits", spark.sql("SELECT " + text + " FROM {lines}", lines=lines))


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: visits(spark, folder).sql(text)


def _oracle(text: str) -> str:
    """The same statement in the other engine's words."""
    text = re.sub(r"toDateTime\((\w+)\)", r"make_timestamp(\1 * 1000000)", text)
    text = re.sub(r"(day [<>=]+ )'([\d-]+)'", lambda m: m[1] + str(epoch_day(m[2])), text)
    text = re.sub(r"\bSUM\(([^)]*)\)", r"CAST(SUM(\1) AS BIGINT)", text)
    text = re.sub(r"(extract\(minute FROM [^)]*\)\))", r"CAST(\1 AS INTEGER)", text)
    text = re.sub(r"(OFFSET \d+) (LIMIT \d+)", r"\2 \1", text)
    return f"WITH visits AS (SELECT {COLUMNS.format(day=_DUCK_DAY)} FROM lineitem) {text}"


QUERIES = {f"visits_{name}": _query(text) for name, text in STATEMENTS.items()}
ORACLES = {f"visits_{name}": _oracle(text) for name, text in STATEMENTS.items()}
