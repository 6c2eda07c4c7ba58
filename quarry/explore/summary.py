"""Chart-ready summaries of results, and the profile of one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.compiler import QueryResult
from quarry.schema import quoted

BARS, GROUPED_BARS = 14, 16


def ranked_groups(groups: DataFrame, keys: list[str], at_most: int = BARS) -> DataFrame:
    """Groups by the sum of their value (by count without one), the largest first, ties by key."""
    measure = "sum" if "sum" in groups.columns else "count"
    return groups.orderBy(F.desc(measure), *keys).limit(at_most)


def pivoted(groups: DataFrame, keys: list[str], at_most: int = GROUPED_BARS) -> DataFrame:
    """Two-key groups as one row per first key and a column per second key (of the groups shown)."""
    measure = "sum" if "sum" in groups.columns else "count"
    shown = ranked_groups(groups, keys, at_most)
    return shown.groupBy(keys[0]).pivot(keys[1]).agg(F.first(measure)).orderBy(keys[0])


def chart_kind(result: QueryResult, hint: str | None = None) -> str:
    """table, grouped, bar or rows, unless a hint says."""
    if hint:
        return hint
    if result.projection is not None:
        return "table"
    if result.groups is not None:
        keys = [c for c in result.groups.columns if c not in ("count", "sum", "min", "max", "mean")]
        return "grouped" if len(keys) == 2 else "bar"
    return "rows"


def entity_versions(df: DataFrame, entity: str, name: str, measure: str = "downloads") -> DataFrame:
    """The rows of one entity by its measure, the largest first."""
    return df.where(quoted(entity) == name).orderBy(quoted(measure).desc_nulls_last())


def entity_profile(df: DataFrame, entity: str, measure: str, flag: str, category: str) -> DataFrame:
    """Per entity: rows, total, flagged rows and most frequent category (ties: the smallest), over all entities at once."""
    per = df.where(quoted(entity).isNotNull()).groupBy(quoted(entity).alias(entity), quoted(category).alias(category)).agg(
        F.count("*").alias("n"), F.sum(measure).alias("total"), F.count_if(quoted(flag)).alias("flagged")
    )
    best = Window.partitionBy(entity).orderBy(quoted(category).isNull(), F.desc("n"), category)
    top = per.withColumn("first", F.row_number().over(best) == 1)
    return top.groupBy(entity).agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.sum("flagged").alias("flagged"),
        F.max(F.when(F.col("first"), quoted(category))).alias("top_category"),
    )
