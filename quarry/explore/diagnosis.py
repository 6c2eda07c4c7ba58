"""Why a query takes its time: what filters could skip in the files, and what a run read and did."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.model import FilterSpec
from quarry.plans.predicates import leaf
from quarry.schema import quoted, resolve_column
from quarry.sources.convert import storage_report

#: What a row group can hold, by the column's bounds: the condition under which a filter may match there.
_MAY = {
    "eq": lambda low, high, v: (low <= v[0]) & (high >= v[0]),
    "neq": lambda low, high, v: (low != v[0]) | (high != v[0]),
    "lt": lambda low, high, v: low < v[0],
    "lte": lambda low, high, v: low <= v[0],
    "gt": lambda low, high, v: high > v[0],
    "gte": lambda low, high, v: high >= v[0],
    "between": lambda low, high, v: (low <= v[1]) & (high >= v[0]),
}


def pruning_report(df: DataFrame, filters: list[FilterSpec] | tuple[FilterSpec, ...]) -> DataFrame:
    """``(column, op, row_groups, skipped, rows, rows_skipped, overlap)``: one row per filter on Parquet files.

    ``skipped`` row groups cannot match by their bounds; ``overlap`` is the mean share of the column's whole
    span that a row group's bounds cover: near 1, the files are not sorted by it and no filter can skip any
    (null where bounds are not numbers). ``in`` skips what all its values skip; ``like`` skips nothing. Row
    groups without bounds are never skipped.
    """
    report = storage_report(df)
    parts = []
    for number, spec in enumerate(filters):
        name = resolve_column(df.schema, spec.column)
        kind = df.schema[name].dataType
        bounds = report.where(F.col("column") == name).select("rows", F.col("low").cast(kind).alias("low"), F.col("high").cast(kind).alias("high"))
        values = spec.value if spec.operator == "in" else [spec.value]
        may = F.lit(spec.operator not in _MAY and spec.operator != "in")
        for value in values if spec.operator != "like" and spec.operator != "not_like" else []:
            op = "eq" if spec.operator == "in" else spec.operator
            literals = [F.lit(x).cast(kind) for x in ([value, spec.value2] if op == "between" else [value])]
            may = may | _MAY[op](F.col("low"), F.col("high"), literals)
        skipped = ~F.coalesce(may, F.lit(True))
        span = F.lit(None).cast("double")
        if isinstance(kind, (T.NumericType, T.DateType)):
            low, high = ((F.unix_date(F.col(c)) if isinstance(kind, T.DateType) else F.col(c)).cast("double") for c in ("low", "high"))
            whole = bounds.select(low.alias("low"), high.alias("high")).agg(F.min("low").alias("whole_low"), F.max("high").alias("whole_high"))
            bounds = bounds.crossJoin(F.broadcast(whole))  # one row
            width = F.col("whole_high") - F.col("whole_low")
            span = F.when(width > 0, (high - low) / width)
        parts.append(
            bounds.agg(F.count("*").alias("row_groups"), F.count_if(skipped).alias("skipped"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(skipped, F.col("rows"))), F.lit(0)).alias("rows_skipped"), F.round(F.avg(span), 4).alias("overlap"))
            .select(F.lit(number).alias("filter"), F.lit(name).alias("column"), F.lit(spec.op).alias("op"), "row_groups", "skipped", "rows", "rows_skipped", "overlap")
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def selectivity(df: DataFrame, filters: list[FilterSpec] | tuple[FilterSpec, ...]) -> DataFrame:
    """``(rows, matching_1, matching_2, ..., matching)``: how many rows each filter keeps, and all of them together, in one pass."""
    tests = [leaf(df.schema, f) for f in filters]
    together = F.lit(True)
    for test in tests:
        together = together & test
    return df.agg(F.count("*").alias("rows"), *[F.count_if(t).alias(f"matching_{n}") for n, t in enumerate(tests, 1)], F.count_if(together).alias("matching"))


def distinct_values(df: DataFrame, column: str) -> int:
    """How many values a group-by on this column would give."""
    return df.agg(F.count_distinct(quoted(resolve_column(df.schema, column)))).first()[0]


def run_statistics(df: DataFrame) -> dict[str, Any]:
    """Run ``df`` to its end, keeping no rows, and tell what it did.

    ``seconds`` and ``rows`` of the run, and ``steps``: for every physical operator, from the result down, its
    name and Spark's own metrics (rows, files and bytes read, times in milliseconds, bytes shuffled and spilled).
    """
    execution = df._jdf.queryExecution()
    began = time.perf_counter()
    rows = execution.toRdd().count()
    seconds = time.perf_counter() - began
    steps: list[dict[str, Any]] = []
    pending = [execution.executedPlan()]
    while pending:
        node = pending.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            pending.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            pending.append(node.plan())
            continue
        metrics, entries = {}, node.metrics().iterator()
        while entries.hasNext():
            entry = entries.next()
            if value := entry._2().value():
                metrics[entry._1()] = value
        steps.append({"operator": node.nodeName(), "metrics": metrics})
        children = node.children()
        pending += [children.apply(i) for i in reversed(range(children.length()))]
    return {"seconds": round(seconds, 4), "rows": rows, "steps": steps}
