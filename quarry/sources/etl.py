"""Denormalised tables and rollups from a normalised registry dump."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def read_dump(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """``folder/name.csv`` with a header; give a schema to save the inference pass."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(f"{folder}/{name}.csv") if schema else reader.option("inferSchema", True).csv(f"{folder}/{name}.csv")


def version_table(versions: DataFrame, crates: DataFrame) -> DataFrame:
    """Versions with the name and totals of their crate (inner)."""
    v, c = versions.alias("v"), crates.alias("c")
    return v.join(c, F.col("c.id") == F.col("v.crate_id")).select(
        F.col("v.id").alias("version_id"), "v.crate_id", F.col("c.name").alias("crate_name"),
        F.regexp_replace("v.num", r"^\s+|\s+$", "").alias("version"), "v.downloads", "v.crate_size",
        F.col("v.created_at").alias("published_date"), "v.yanked", "v.edition", "v.license", "v.has_lib", "v.rust_version",
        F.col("c.downloads").alias("crate_total_downloads"), F.col("v.num_no_build").alias("dep_count"),
    )


def dependency_table(dependencies: DataFrame, versions: DataFrame, crates: DataFrame) -> DataFrame:
    """Edges with the parent's name (inner) and the wanted crate's id where its name is known (left)."""
    given = F.nullif(F.col("d.explicit_name"), F.lit(""))
    wanted = F.coalesce(given, F.split_part(F.col("d.req"), F.lit(" "), F.lit(1)))
    d = dependencies.alias("d").join(versions.select(F.col("id").alias("vid"), "crate_id").alias("v"), F.col("v.vid") == F.col("d.version_id"))
    d = d.join(crates.select(F.col("id").alias("pid"), F.col("name").alias("pname")), F.col("pid") == F.col("v.crate_id"))
    d = d.withColumn("__wanted", wanted)
    named = crates.select(F.col("id").alias("did"), F.col("name").alias("dname"))
    return d.join(named, F.col("dname") == F.col("__wanted"), "left").select(
        F.col("d.id").alias("dependency_id"), "d.version_id", F.col("v.crate_id").alias("parent_crate_id"), F.col("pname").alias("parent_crate_name"),
        F.col("did").alias("dep_crate_id"), F.coalesce(given, F.col("d.req")).alias("dep_crate_name"), "d.kind", "d.optional",
    )


def bridge_table(crates: DataFrame, links: DataFrame, other: DataFrame, totals: DataFrame, *, link: str, columns: dict[str, str], link_columns: list[str] | None = None) -> DataFrame:
    """crates joined to ``other`` through ``links(crate_id, link)``, with totals that are 0 where unknown."""
    rows = links.select(F.col("crate_id").alias("lc"), F.col(link).alias("lo"), *(link_columns or []))
    rows = rows.join(crates.select(F.col("id").alias("crate_id"), F.col("name").alias("crate_name")), F.col("crate_id") == F.col("lc"))
    rows = rows.join(other.select(F.col("id").alias("oid"), *[F.col(old).alias(new) for new, old in columns.items()]), F.col("oid") == F.col("lo"))
    rows = rows.join(totals.select(F.col("crate_id").alias("tc"), F.col("downloads").alias("__t")), F.col("tc") == F.col("crate_id"), "left")
    return rows.select("crate_id", "crate_name", *columns, *(link_columns or []), F.coalesce("__t", F.lit(0)).alias("crate_downloads"))


def category_table(crates: DataFrame, links: DataFrame, categories: DataFrame, totals: DataFrame) -> DataFrame:
    return bridge_table(crates, links, categories, totals, link="category_id", columns={"category_slug": "slug", "category_name": "category"})


def maintainer_table(crates: DataFrame, owners: DataFrame, users: DataFrame, totals: DataFrame) -> DataFrame:
    return bridge_table(crates, owners, users, totals, link="owner_id", columns={"owner_login": "gh_login", "owner_name": "name"}, link_columns=["owner_kind"])


def daily_table(downloads: DataFrame, versions: DataFrame) -> DataFrame:
    """Daily facts with the version's names, clustered by day so that day filters skip files."""
    names = versions.select("version_id", "crate_id", "crate_name", "version")
    rows = downloads.join(names, "version_id").select("version_id", "crate_id", "crate_name", "version", "date", "downloads")
    return rows.repartitionByRange("date", "version_id").sortWithinPartitions("date", "version_id")


def recent_totals(daily: DataFrame, since: str) -> DataFrame:
    """Downloads per crate from a day on, the largest first."""
    sums = daily.where(F.col("date") >= F.lit(since).cast("date")).groupBy("crate_name").agg(F.sum("downloads").cast("long").alias("downloads"))
    return sums.orderBy(F.desc("downloads"), "crate_name")


def version_totals(daily: DataFrame, crate: str) -> DataFrame:
    """Downloads per version of one crate, the largest first."""
    sums = daily.where(F.col("crate_name") == crate).groupBy("version").agg(F.sum("downloads").cast("long").alias("downloads"))
    return sums.orderBy(F.desc("downloads"), "version")
