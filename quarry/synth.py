"""Synthetic skewed keys, and plain against salted aggregation of them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def skewed_keys(spark: SparkSession, rows: int, distinct_keys: int, hot_keys: int = 0, hot_probability: float = 0.0, seed: int = 1) -> DataFrame:
    """``(row, key)``: hashed keys, a share of them redirected to a few hot ones; the same for a seed on every run."""
    row = spark.range(rows).withColumnRenamed("id", "row")
    key = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(distinct_keys))
    if not hot_keys or hot_probability <= 0:
        return row.select("row", key.alias("key"))
    draw = F.pmod(F.xxhash64("row", F.lit(seed + 1)), F.lit(1_000_000)) / 1e6
    hot = F.pmod(F.xxhash64("row", F.lit(seed + 2)), F.lit(hot_keys))
    return row.select("row", F.when(draw < hot_probability, hot).otherwise(key).alias("key"))


def plain_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def salted_counts(df: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Counts in two steps, the first spread over ``salts`` parts per key."""
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))
    return df.groupBy(key, salt.alias("salt")).agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("n"))


def timed(spark: SparkSession, rows: int, distinct_keys: int, hot_keys: int, hot_probability: float, runs: int = 3) -> list[dict]:
    """Seconds of both aggregations over the same keys."""
    out = []
    for name, count in (("plain", plain_counts), ("salted", salted_counts)):
        for run in range(runs):
            began = time.time()
            count(skewed_keys(spark, rows, distinct_keys, hot_keys, hot_probability), "key").write.format("noop").mode("overwrite").save()
            out.append({"engine": name, "run": run, "seconds": round(time.time() - began, 3)})
    return out
