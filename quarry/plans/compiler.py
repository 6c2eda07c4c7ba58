"""Plans compiled to lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import PlanError
from quarry.plans.model import STATISTICS, AggregateSpec, QueryPlan, validate
from quarry.plans.predicates import where
from quarry.schema import is_floating, is_numeric, quoted, resolve_column
from quarry.sources.tables import ROW_ID, Table, first_files


@dataclass(frozen=True)
class QueryResult:
    """Lazy parts of a result; those a plan does not ask for are None."""

    rows: DataFrame | None = None
    projection: DataFrame | None = None
    aggregates: DataFrame | None = None
    groups: DataFrame | None = None


def _measure(schema: T.StructType, ref: str | int) -> tuple[str, Column, bool]:
    """Name of a numeric or boolean column, its values with NaN as null, and whether sums are floating."""
    name = resolve_column(schema, ref)
    kind = schema[name].dataType
    column = quoted(name)
    if isinstance(kind, T.BooleanType):
        return name, column.cast("int"), False
    if not is_numeric(kind):
        raise PlanError(f"{name} is {kind.simpleString()}; statistics need a number")
    return name, F.when(~F.isnan(column), column) if is_floating(kind) else column, is_floating(kind)


def statistics(column: Column, names: tuple[str, ...] = STATISTICS, prefix: str = "") -> list[Column]:
    """count, sum, min, max and mean, each 0 where nothing was counted; sums are double."""
    zero = F.lit(0)
    every = {
        "count": F.count(column),
        "sum": F.coalesce(F.sum(column.cast("double")), F.lit(0.0)),
        "min": F.coalesce(F.min(column), zero),
        "max": F.coalesce(F.max(column), zero),
        "mean": F.coalesce(F.avg(column.cast("double")), F.lit(0.0)),
    }
    return [every[n].alias(prefix + n) for n in names]


def filtered(table: Table, plan: QueryPlan, numbered: bool) -> DataFrame:
    predicate = where(table.df.schema, plan.filters, plan.combine)
    df = table.numbered if numbered else table.df
    return df if predicate is None else df.where(predicate)


def group_frame(table: Table, plan: QueryPlan) -> DataFrame:
    """Groups with ``count`` and the value's statistics.

    Rows with a null key are left out. By count descending (ties: keys ascending) if the plan asks for it
    and has a limit, else in the order groups are first seen in the file. A limit of 0 or none gives all groups.
    """
    schema = table.df.schema
    keys = [resolve_column(schema, k) for k in plan.group_by.keys]
    by_order = bool(plan.order_by) or (plan.group_order_by_count and plan.limit)
    df = filtered(table, plan, numbered=not by_order).dropna(subset=keys)
    columns = [F.count("*").alias("count")]
    if plan.group_by.value is not None:
        _, value, _ = _measure(schema, plan.group_by.value)
        columns += statistics(value, ("sum", "min", "max", "mean"))
    if not by_order:
        columns.append(F.min(ROW_ID).alias(ROW_ID))
    groups = df.groupBy(*[quoted(k) for k in keys]).agg(*columns)
    ties = [quoted(k).asc() for k in keys]
    if plan.order_by:
        for name, _ in plan.order_by:
            if name not in groups.columns:
                raise PlanError(f"no group column {name!r}")
        groups = groups.orderBy(*[quoted(n).desc() if d else quoted(n).asc() for n, d in plan.order_by], *ties)
    elif by_order:
        groups = groups.orderBy(F.desc("count"), *ties)
    else:
        groups = groups.orderBy(ROW_ID).drop(ROW_ID)
    if plan.offset:
        groups = groups.offset(plan.offset)
    return groups.limit(plan.limit) if plan.limit else groups


def aggregate_frame(table: Table, plan: QueryPlan) -> DataFrame:
    """One row; columns ``<column>_<statistic>`` for every aggregate, each 0 on empty input."""
    df = filtered(table, plan, numbered=False)
    columns: list[Column] = []
    wanted: dict[tuple[str, str], None] = {}
    for spec in plan.aggregates:
        name, value, _ = _measure(table.df.schema, spec.column)
        for one in (spec.op,) if spec.op else STATISTICS:
            if (name, one) not in wanted:
                wanted[name, one] = None
                columns += statistics(value, (one,), f"{name}_")
    return df.agg(*columns)


def row_frame(table: Table, plan: QueryPlan) -> DataFrame:
    """Matching rows with their row id, in file order (or ``order_by``: nulls last, ties in file order).

    Without a limit, or with 0, no rows come back. A page in file order reads the first files that fill it.
    """
    if not plan.limit:
        return filtered(table, plan, numbered=True).where(F.lit(False))
    if not plan.order_by and ROW_ID not in table.df.columns:
        predicate = where(table.df.schema, plan.filters, plan.combine)
        table = Table(table.name, first_files(table.df, predicate, plan.limit + plan.offset))
    df = filtered(table, plan, numbered=True)
    order = []
    for name, descending in plan.order_by:
        column = quoted(resolve_column(table.df.schema, name))
        order.append(column.desc_nulls_last() if descending else column.asc_nulls_last())
    df = df.orderBy(*order, ROW_ID)
    if plan.offset:
        df = df.offset(plan.offset)
    return df.limit(plan.limit)


def execute(table: Table, plan: QueryPlan) -> QueryResult:
    """Compile a plan; groups and aggregates may be asked for together and see the same filter."""
    validate(plan)
    if plan.group_by or plan.aggregates:
        return QueryResult(
            groups=group_frame(table, plan) if plan.group_by else None,
            aggregates=aggregate_frame(table, plan) if plan.aggregates else None,
        )
    rows = row_frame(table, plan)
    if plan.select:
        names = [resolve_column(table.df.schema, c) for c in plan.select]
        return QueryResult(projection=rows.select(*[quoted(n) for n in names]), rows=rows.select(F.col(ROW_ID).alias("row_id")))
    return QueryResult(rows=rows.select(F.col(ROW_ID).alias("row_id")))


def main_frame(table: Table, plan: QueryPlan) -> DataFrame:
    """The part of the result a reader looks at first: projection, groups, aggregates or row ids."""
    result = execute(table, plan)
    return next(x for x in (result.projection, result.groups, result.aggregates, result.rows) if x is not None)


__all__ = ["AggregateSpec", "QueryResult", "execute", "main_frame", "statistics"]
