"""Questions over several registry tables at once: owners, categories, licenses and use.

Facts are summed per crate before they are joined, so that a crate with a third of all rows joins as one row.
Repeated rows of bridge tables count once. Nulls: crates, owners or categories without an id or name are kept
as a null group where they are what is asked for, and match nothing where they are joined on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def version_rows(versions: DataFrame, *columns: str) -> DataFrame:
    """One row per version with the greatest value of each column."""
    return versions.groupBy("version_id").agg(*[F.max(c).alias(c) for c in columns])


def portfolios(owners: DataFrame, versions: DataFrame) -> DataFrame:
    """``(owner_login, crates, downloads)``: how many crates an owner has, and the downloads of all their versions (0 if none)."""
    totals = version_rows(versions, "crate_id", "downloads").groupBy("crate_id").agg(F.sum("downloads").alias("total"))
    held = owners.select("owner_login", "crate_id").distinct().join(totals, "crate_id", "left")
    return held.groupBy("owner_login").agg(F.count("*").alias("crates"), F.coalesce(F.sum("total"), F.lit(0)).alias("downloads"))


def category_sums(daily: DataFrame, categories: DataFrame, **spans: Column) -> DataFrame:
    """``(category_slug, <span>, ...)``: downloads per category within each span of days, a condition on ``daily``; null if there are none."""
    sums = daily.groupBy("crate_id").agg(*[F.sum(F.when(inside, F.col("downloads"))).alias(name) for name, inside in spans.items()])
    slugs = categories.select("crate_id", "category_slug").distinct()
    return slugs.join(sums, "crate_id").groupBy("category_slug").agg(*[F.sum(name).alias(name) for name in spans])


def users_of_license(edges: DataFrame, versions: DataFrame, license_is: Column) -> DataFrame:
    """``(license, crates)``: under which licenses crates stand that need one for which ``license_is`` holds."""
    such = versions.where(license_is).select(F.col("crate_id").alias("dep_crate_id")).distinct()
    needed = edges.join(such, "dep_crate_id", "left_semi").select("version_id", "parent_crate_id").distinct()
    licenses = versions.groupBy("version_id").agg(F.min("license").alias("license"))
    return needed.join(licenses, "version_id").groupBy("license").agg(F.count_distinct("parent_crate_id").alias("crates"))


def wanted_and_downloaded(edges: DataFrame, daily: DataFrame) -> DataFrame:
    """``(crate_id, wanted, downloads)`` of the crates that are both: edges to them and their downloads."""
    wanted = edges.where(F.col("dep_crate_id").isNotNull()).groupBy(F.col("dep_crate_id").alias("crate_id")).agg(F.count("*").alias("wanted"))
    return wanted.join(daily.groupBy("crate_id").agg(F.sum("downloads").alias("downloads")), "crate_id")
