"""Queries of the operators in this package, each with the SQL it must agree with where SQL can express it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import distinct, leakage, residue, tokenize, topn
from quarry.sources.tables import read_table

#: Where the public vocabularies lie on every machine.
TOKENIZERS = os.environ.get("QUARRY_TOKENIZERS", "/opt/tokenizers")
DIMS, IDS = ["kind", "optional"], ["parent_crate_id", "dep_crate_name"]


def _distinct(spark: SparkSession, folder: str, months: bool) -> tuple[DataFrame, distinct.Groups]:
    """The mergeable state, per day or merged into months."""
    edges = read_table(spark, folder, "crates_dependencies")
    groups = distinct.number_groups(edges, DIMS)
    state = distinct.partials(edges, at="recorded_at", ids=IDS, groups=groups)
    return distinct.merge(state, period=F.trunc("period", "month")) if months else state, groups


def _distinct_counts(spark: SparkSession, folder: str, months: bool) -> DataFrame:
    state, groups = _distinct(spark, folder, months)
    # The SQL states the bound to six digits.
    return distinct.counts(state, ids=IDS, groups=groups).withColumn("error_bound", F.round("error_bound", 6))


def p1_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct identifiers per day and combination of kind and optional."""
    days = _distinct_counts(spark, folder, months=False)
    return days.withColumn("day", F.date_format("period", "yyyy-MM-dd")).drop("period")


def p1_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """The same per month, merged from the days' partial results."""
    months = _distinct_counts(spark, folder, months=True)
    return months.withColumn("month", F.date_format("period", "yyyy-MM")).drop("period")


def p1_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Per day, the totals over all groups with the error bound as it is, unrounded."""
    state, groups = _distinct(spark, folder, months=False)
    days = distinct.counts(state, ids=IDS, groups=groups).where("all_kind AND all_optional")
    return days.select(F.date_format("period", "yyyy-MM-dd").alias("day"), *[f"{c}s" for c in IDS], "error_bound")


def p1_state(spark: SparkSession, folder: str) -> DataFrame:
    """The partial results themselves, by which days or files are combined: the groups of every identifier and day as bits."""
    state, _ = _distinct(spark, folder, months=False)
    return state.select("bucket", "field", "hash", F.date_format("period", "yyyy-MM-dd").alias("day"), "word", "mask")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    best = topn.top_items(read_table(spark, folder, "crates_versions"), groups=["license", "crate_name"], item="version_id", score="downloads", n=3)
    return best.select("group_field", "group_value", "version_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokenize.encode_documents(
        read_table(spark, folder, "documents"), key="doc_id", text="text", vocabulary=os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
    )


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(
        read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"),
        key="doc_id", text="text", item="item_id", item_text="text", answer="answer",
    )


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """Which items leaked: in how many documents, the longest run, and the largest share of the item in one document. Items only leaked reworded are in `p9_paraphrases`."""
    share = F.round(F.max(F.col("common") / F.col("item_words")), 6).alias("largest_share")
    return _leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("run").alias("longest_run"), share)


def p9_paraphrases(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that repeat an item, reworded or not: decided by the longest common subsequence and the answer."""
    return leakage.find_paraphrases(
        read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"),
        key="doc_id", text="text", item="item_id", item_text="text", answer="answer",
    ).select("doc_id", "item_id", "run", "common", "item_words", "answer")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.find_residue(read_table(spark, folder, "documents"), key="doc_id", text="text").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_daily, p1_monthly, p1_bounds, p1_state, p4_found, p8_ids, p9_found, p9_items, p9_paraphrases, p10_found)}

_COUNTS = """
WITH edges AS (SELECT strftime(recorded_at, '{0}') AS {1}, kind, optional, parent_crate_id, dep_crate_name FROM crates_dependencies),
counted AS (SELECT {1}, grouping(kind) = 1 AS all_kind, kind, grouping(optional) = 1 AS all_optional, optional,
  count(DISTINCT parent_crate_id) AS parent_crate_ids, count(DISTINCT dep_crate_name) AS dep_crate_names
  FROM edges GROUP BY GROUPING SETS (({1}, kind, optional), ({1}, kind), ({1}, optional), ({1})))
SELECT *, round(greatest(parent_crate_ids, dep_crate_names)::DOUBLE * greatest(parent_crate_ids, dep_crate_names) / pow(2, 65), 6) AS error_bound FROM counted
WHERE parent_crate_ids + dep_crate_names > 0
"""

ORACLES = {
    "p1_daily": _COUNTS.format("%Y-%m-%d", "day"),
    "p1_monthly": _COUNTS.format("%Y-%m", "month"),
    "p1_bounds": """
WITH counted AS (SELECT strftime(recorded_at, '%Y-%m-%d') AS day, count(DISTINCT parent_crate_id) AS parent_crate_ids, count(DISTINCT dep_crate_name) AS dep_crate_names
  FROM crates_dependencies GROUP BY 1)
SELECT *, greatest(parent_crate_ids, dep_crate_names)::DOUBLE * greatest(parent_crate_ids, dep_crate_names) / pow(2, 65) AS error_bound FROM counted
WHERE parent_crate_ids + dep_crate_names > 0""",
    "p4_found": """
WITH once AS (SELECT version_id, min(license) AS license, min(crate_name) AS crate_name, max(downloads) AS downloads FROM crates_versions
  WHERE downloads IS NOT NULL GROUP BY version_id),
long AS (SELECT 'license' AS group_field, license AS group_value, version_id, downloads FROM once
  UNION ALL SELECT 'crate_name', crate_name, version_id, downloads FROM once)
SELECT group_field, group_value, version_id FROM long WHERE group_value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY group_field, group_value ORDER BY downloads DESC, version_id) <= 3""",
}
