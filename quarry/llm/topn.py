"""The N best items of every group, by lower bounds of the partitions.

A slice of any input split already holding N items of a group proves that the group's N-th best is at least
the slice's N-th best. Each split sends only its own best N per group with that bound; the greatest bound
per group then removes what cannot win, and only the survivors are ranked. A group of any size costs at
most N rows per slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.schema import exact
from quarry.session import written

#: Rows of a split that are cut down together (bounds a task's memory).
SLICE_ROWS = 200_000
LOCAL = "field string, value string, item long, score long, low_score long, low_item long"


def best_of_slice(codes: np.ndarray, items: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row indices of each code's n best distinct items, and per such row the index of the n-th best (-1: fewer).

    Higher scores win, equal scores the smaller item; an item counts once, with its best score.
    """
    order = np.lexsort((-scores, items, codes))
    once = np.ones(len(order), bool)
    once[1:] = (codes[order][1:] != codes[order][:-1]) | (items[order][1:] != items[order][:-1])
    order = order[once]
    order = order[np.lexsort((items[order], -scores[order], codes[order]))]
    held = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(held)))
    rank = np.arange(len(held)) - np.repeat(starts, sizes)
    nth = np.where(sizes >= n, starts + n - 1, -1)
    nth = np.repeat(nth, sizes)
    kept = rank < n
    return order[kept], np.where(nth[kept] >= 0, order[np.maximum(nth[kept], 0)], -1)


def top_items(df: DataFrame, *, groups: list[str], item: str, score: str, n: int) -> DataFrame:
    """``(group_field, group_value, item, score, rank)``: per value of each field of ``groups`` its n best items.

    Group values are compared as stored, as text; the empty text is a value, null is none. Rows with null
    score or item are left out. Ties: the smaller item first. Repeated items count once per group, with
    their best score. Groups with fewer items give fewer rows; an empty table none. Other columns are not read.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            items, scores = (np.asarray(table.column(i)) for i in (0, 1))
            for at, field in enumerate(groups):
                values = table.column(2 + at).combine_chunks()
                values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
                encoded = values.dictionary_encode()
                known = np.flatnonzero(np.asarray(values.is_valid()))
                codes = np.asarray(encoded.indices.fill_null(0))[known]
                best, low = best_of_slice(codes, items[known], scores[known], n)
                rows, low = known[best], np.where(low >= 0, known[np.maximum(low, 0)] if len(known) else 0, -1)
                none = pa.array(low < 0)
                pick = lambda a: pa.compute.if_else(none, pa.scalar(None, pa.int64()), pa.array(a[np.maximum(low, 0)]))  # noqa: E731, B023
                if len(rows):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([field] * len(rows)), values.take(pa.array(rows)), pa.array(items[rows]), pa.array(scores[rows]), pick(scores), pick(items)],
                        ["field", "value", "item", "score", "low_score", "low_item"],
                    )

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SLICE_ROWS:
                yield from cut()
                size = 0
        if size:
            yield from cut()

    rows = exact(df, item, score, *groups).select(F.col(item).cast("long").alias("item"), F.col(score).cast("long").alias("score"), *[F.col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)])
    rows = rows.where(F.col("item").isNotNull() & F.col("score").isNotNull())
    # Read twice below; the local winners are far fewer than the rows.
    local = written(rows.mapInArrow(split, LOCAL), "topn")
    bounds = (
        local.where(F.col("low_score").isNotNull())
        .groupBy("field", "value")
        .agg(F.max(F.struct("low_score", (-F.col("low_item")).alias("minus"))).alias("low"))
    )
    survivors = (
        local.drop("low_score", "low_item")
        .join(bounds, ["field", "value"], "left")
        .where(F.col("low").isNull() | (F.struct(F.col("score").alias("low_score"), (-F.col("item")).alias("minus")) >= F.col("low")))
        .groupBy("field", "value", "item")
        .agg(F.max("score").alias("score"))
    )
    by_score = Window.partitionBy("field", "value").orderBy(F.desc("score"), "item")
    return (
        survivors.withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= n)
        .select(F.col("field").alias("group_field"), F.col("value").alias("group_value"), F.col("item").alias(item), F.col("score").alias(score), "rank")
    )
