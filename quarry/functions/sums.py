"""Many shifted sums from one pass: sum(c + k) = sum(c) + k * count(c)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import PlanError


def shifted_sums(df: DataFrame, column: str, shifts: list[int]) -> DataFrame:
    """One row with ``sum_<k>`` for each shift; integer columns only (sums of floats would round differently)."""
    if not isinstance(df.schema[column].dataType, T.IntegralType):
        raise PlanError(f"{column} is not an integer column")
    once = df.agg(F.sum(column).alias("s"), F.count(column).alias("n"))
    return once.select(*[(F.col("s") + F.lit(k) * F.col("n")).cast("long").alias(f"sum_{k}") for k in shifts])
