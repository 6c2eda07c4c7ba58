"""Per-key counts and sums where a few keys hold most rows.

Every input split encodes its keys by dictionary and adds into dense arrays (``bincount``); only the
arrays travel, one entry per key and split, and are summed by a distributed reduction. A key that holds
a third of all rows is therefore as cheap as any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.schema import exact

#: Entries and bytes of keys after which a split sends its arrays and starts anew (bounds memory, drops nothing).
FLUSH_KEYS, FLUSH_BYTES = 500_000, 256 << 20
#: Entries of batches that are gathered before they are united.
GATHER_KEYS = 100_000


class DenseSums:
    """Counts and integer sums per dictionary code of one split: every batch by itself, united from time to time."""

    def __init__(self) -> None:
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.entries = self.bytes = 0

    def add(self, keys: pa.Array, values: pa.Array | None) -> None:
        encoded = keys.dictionary_encode(null_encoding="encode")
        index, size = np.asarray(encoded.indices), len(encoded.dictionary)
        sums = np.zeros(size, np.int64)
        if values is not None:
            np.add.at(sums, index, np.asarray(pc.fill_null(values, 0)))
        self._hold(encoded.dictionary, np.bincount(index, minlength=size), sums)
        if self.entries >= GATHER_KEYS and len(self.parts) > 1:
            self.unite()

    def _hold(self, keys: pa.Array, counts: np.ndarray, sums: np.ndarray) -> None:
        self.parts.append((keys, counts, sums))
        self.entries += len(keys)
        self.bytes += keys.nbytes

    def unite(self) -> None:
        """One code per key over all parts."""
        encoded = pa.concat_arrays([k for k, _, _ in self.parts]).dictionary_encode(null_encoding="encode")
        index = np.asarray(encoded.indices)
        counts, sums = np.zeros(len(encoded.dictionary), np.int64), np.zeros(len(encoded.dictionary), np.int64)
        np.add.at(counts, index, np.concatenate([c for _, c, _ in self.parts]))
        np.add.at(sums, index, np.concatenate([s for _, _, s in self.parts]))
        self.__init__()
        self._hold(encoded.dictionary, counts, sums)

    @property
    def full(self) -> bool:
        return self.bytes >= FLUSH_BYTES or (len(self.parts) == 1 and self.entries >= FLUSH_KEYS)

    def take(self) -> pa.RecordBatch:
        self.unite()
        batch = pa.RecordBatch.from_arrays([self.parts[0][0], pa.array(self.parts[0][1]), pa.array(self.parts[0][2])], ["key", "rows", "total"])
        self.__init__()
        return batch


def key_totals(df: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """``(key, rows, total)`` per value of ``key``, null being a key of its own.

    ``rows`` counts all rows, repeated ones included; ``total`` sums the integer ``value`` (null counts 0;
    0 throughout without a value). Keys compare as text. An empty table gives no rows; other columns are not read.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = DenseSums()
        for batch in batches:
            if batch.num_rows:
                held.add(batch.column(0), batch.column(1) if value else None)
            if held.full:
                yield held.take()
        if held.parts:
            yield held.take()

    columns = [F.col(key).cast("string").alias("key")] + ([F.col(value).cast("long").alias("value")] if value else [])
    return (
        exact(df, key, *([value] if value else [])).select(*columns)
        .mapInArrow(split, "key string, rows long, total long")
        .groupBy("key")
        .agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))
    )


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """``(key, rows, total)`` of the non-null keys holding at least ``share`` of all rows of ``df``.

    The row total includes rows with a null key. At most ``1 / share`` rows come out.
    """
    # A scan without columns: answered from the files' row counts.
    least = df.count() * share
    totals = key_totals(df, key)
    return totals.where(F.col("key").isNotNull() & (F.col("rows") >= F.lit(least))).select("key", "rows", "total")
