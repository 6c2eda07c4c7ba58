"""Compiled plans over streams: the same filters and groups, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import PlanError
from quarry.plans.compiler import _measure, statistics
from quarry.plans.model import QueryPlan, validate
from quarry.plans.predicates import where
from quarry.schema import quoted, resolve_column


def stream_table(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def stream_plan(stream: DataFrame, plan: QueryPlan, *, time: str | None = None, window: str | None = None, lateness: str = "1 day") -> DataFrame:
    """The streaming frame of a plan: a projection (append mode) or groups (update or complete mode).

    Order, limit and offset have no meaning on an unbounded stream and are rejected. With ``time`` and
    ``window`` groups are counted per time window and state older than ``lateness`` is dropped.
    """
    validate(plan)
    if plan.limit or plan.offset or plan.order_by or plan.group_order_by_count or plan.aggregates:
        raise PlanError("limit, order and global aggregates need a finite table")
    predicate = where(stream.schema, plan.filters, plan.combine)
    df = stream if predicate is None else stream.where(predicate)
    if not plan.group_by:
        return df.select(*[quoted(resolve_column(stream.schema, c)) for c in plan.select]) if plan.select else df
    keys = [quoted(resolve_column(stream.schema, k)) for k in plan.group_by.keys]
    for key in plan.group_by.keys:
        df = df.where(quoted(resolve_column(stream.schema, key)).isNotNull())
    if window:
        df = df.withWatermark(time, lateness)
        keys.append(F.window(quoted(time), window))
    columns = [F.count("*").alias("count")]
    if plan.group_by.value is not None:
        columns += statistics(_measure(stream.schema, plan.group_by.value)[1], ("sum", "min", "max", "mean"))
    return df.groupBy(*keys).agg(*columns)
