"""Parquet tables as DataFrames, with stable global row numbers on request."""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW_ID = "__row_id"
BROADCAST_FILES = 100_000


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``folder/name.parquet`` as it lies there, one file or a directory of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_row_ids(df: DataFrame, column: str = ROW_ID) -> DataFrame:
    """Add the 0-based position of every row in file order.

    The reader numbers rows inside each file; files are put in name order by a prefix sum over one small
    row per file, whose row counts come from the footers (no column is read). They are joined back by
    broadcast, or by shuffle if there are more than BROADCAST_FILES of them.
    """
    numbered = df.withColumn("__file", F.col("_metadata.file_path")).withColumn("__at", F.col("_metadata.row_index"))
    files = len(df.inputFiles())
    if files <= 1:
        return numbered.withColumn(column, F.col("__at")).drop("__file", "__at")
    sizes = df.select(F.col("_metadata.file_path").alias("__file")).groupBy("__file").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = numbered.join(F.broadcast(starts) if files <= BROADCAST_FILES else starts, "__file")
    return joined.withColumn(column, F.col("__start") + F.col("__at")).drop("__file", "__at", "__start")


def first_files(df: DataFrame, predicate: Column | None, rows: int) -> DataFrame:
    """``df`` over its first files in name order that hold ``rows`` matching rows, all of them if they hold fewer.

    The number of files looked at is doubled until it suffices, so that a short page of a large table opens a
    few of its files. Frames that are not a plain scan of several Parquet files come back as they are.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().toString().lower() != "parquet":
        return df
    if plan.relation().partitionSchema().length() or len(files := sorted(df.inputFiles())) < 2:
        return df
    taken = 1
    while taken < len(files):
        part = df.sparkSession.read.schema(df.schema).parquet(*files[:taken])
        if (part if predicate is None else part.where(predicate)).limit(rows).count() >= rows:
            return part
        taken *= 2
    return df


@dataclass(frozen=True)
class Table:
    """One table: its rows without helper columns, and a variant that carries row ids."""

    name: str
    df: DataFrame

    @property
    def numbered(self) -> DataFrame:
        return self.df if ROW_ID in self.df.columns else with_row_ids(self.df)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW_ID]

    def column(self, ref: str | int) -> str:
        from quarry.schema import resolve_column

        return resolve_column(self.df.schema, ref)

    def distinct_values(self, ref: str | int) -> DataFrame:
        """Distinct non-null values of a column, in value order."""
        name = self.column(ref)
        return self.df.select(name).where(F.col(f"`{name}`").isNotNull()).distinct().orderBy(name)

    def query(self, plan):
        from quarry.plans.compiler import execute

        return execute(self, plan)

    def sql(self, text: str, strict: bool = False) -> DataFrame:
        from quarry.plans.sql import run_sql

        return run_sql(self, text, strict=strict)


def open_table(spark: SparkSession, path: str, name: str | None = None) -> Table:
    """Open a Parquet, ORC, CSV or JSON path or .sav path (by its extension; Parquet by default), or a Parquet file behind HTTP."""
    kind = posixpath.splitext(path.rstrip("/"))[1].lower()
    if path.startswith(("http://", "https://")):
        from quarry.sources.http import read_http

        df = read_http(spark, path)
    elif kind == ".csv":
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    elif kind in (".json", ".jsonl", ".ndjson"):
        df = spark.read.json(path)
    elif kind == ".orc":
        df = spark.read.orc(path)
    elif kind == ".sav":
        from quarry.sources.spss import register

        register(spark)
        df = spark.read.format("sav").load(path)
    else:
        df = spark.read.parquet(path)
    return Table(name or posixpath.basename(path.rstrip("/")).split(".")[0], df)
