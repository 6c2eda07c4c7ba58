"""Rolling totals over trailing periods, days without activity included.

Rows are reduced to one total per entity and day (map-side combined, so an entity that holds a third
of all rows shrinks to at most one row a day before the window). Prefix sums per entity are carried
forward over the days up to the next active one; a trailing total is the difference of two prefixes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.schema import exact


def latest_rows(df: DataFrame, keys: list[str], at: str, value: str, entity: str) -> DataFrame:
    """Per ``keys`` the value and entity of the row with the greatest ``at`` (a null time comes first; ties take the greatest value)."""
    order = F.struct(F.col(at).alias("at"), F.col(value).alias("value"), F.col(entity).alias("entity"))
    return exact(df, *keys, at, value, entity).groupBy(*keys).agg(F.max(order).alias("best")).select(*keys, F.col("best.value").alias(value), F.col("best.entity").alias(entity))


def daily_totals(df: DataFrame, *, entity: str, day: str, value: str) -> DataFrame:
    """``(entity, day, total)``: null values count 0; rows without entity or day are left out."""
    return (
        exact(df, entity, day, value).where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity).alias("entity"), F.col(day).cast("date").alias("day"))
        .agg(F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total"))
    )


def rolling_totals(daily: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """``(entity, day, total, total_W, average_W, ...)`` for each day from an entity's first to its last.

    ``daily`` has one row per entity and active day. Days without a row have total 0; days before the
    first count 0 and the averages divide by W throughout. An empty input gives no rows.
    """
    by_day = Window.partitionBy("entity").orderBy("day")
    prefix = daily.select(
        "entity",
        "day",
        F.sum("total").over(by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("prefix"),
        F.lead("day").over(by_day).alias("next_day"),
    )
    last = F.coalesce(F.date_sub("next_day", 1), F.col("day"))
    filled = prefix.select("entity", F.explode(F.sequence("day", last)).alias("day"), "prefix")
    total = lambda back: F.col("prefix") - F.lag("prefix", back, 0).over(by_day)
    columns = [total(1).alias("total")]
    for width in windows:
        columns += [total(width).alias(f"total_{width}"), (total(width) / F.lit(float(width))).alias(f"average_{width}")]
    return filled.select("entity", "day", *columns)
