"""What changed between consecutive full snapshots.

Only compact triples (place of the snapshot in the series, key, hash of the compared fields) are shuffled, into
hash buckets of the key, repeated ones once. Each bucket is sorted once in numpy and consecutive
snapshots are compared by ``searchsorted``; full values are fetched afterwards for the differing keys alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.schema import exact
from quarry.session import durable

#: Bytes of compact triples a bucket should hold, by the size Spark estimates from the files: a task keeps some tens of megabytes.
BUCKET_BYTES = 32_000_000
#: Spark gives frames that are no files a size beyond this.
UNKNOWN_BYTES = 1 << 55
#: A series of at most so many snapshots (counted before) is broadcast; a longer one is joined by shuffle.
BROADCAST_SERIES = 100_000
CHANGES = ("added", "removed", "changed")


def row_hash(*columns: str) -> Column:
    """64-bit hash in which null differs from every value and equals null (two in 2^64 rows collide)."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def compare_sorted(before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and codes (index into CHANGES) that differ between two (sorted unique keys, hashes) pairs."""
    keys_b, hash_b = before
    keys_a, hash_a = after
    place = np.searchsorted(keys_b, keys_a)
    inside = place < len(keys_b)
    held = np.zeros(len(keys_a), bool)
    held[inside] = keys_b[place[inside]] == keys_a[inside]
    altered = held.copy()
    altered[held] = hash_b[place[held]] != hash_a[held]
    back = np.searchsorted(keys_a, keys_b)
    inside = back < len(keys_a)
    stays = np.zeros(len(keys_b), bool)
    stays[inside] = keys_a[back[inside]] == keys_b[inside]
    keys = np.concatenate([keys_a[~held], keys_b[~stays], keys_a[altered]])
    codes = np.repeat(np.arange(3, dtype=np.int8), [int((~held).sum()), int((~stays).sum()), int(altered.sum())])
    return keys, codes


def unique_sorted(snaps: np.ndarray, keys: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by snapshot and key, one entry per key (the smallest hash where repeated rows disagree)."""
    order = np.lexsort((hashes, keys, snaps))
    snaps, keys, hashes = snaps[order], keys[order], hashes[order]
    first = np.ones(len(keys), bool)
    first[1:] = (keys[1:] != keys[:-1]) | (snaps[1:] != snaps[:-1])
    return snaps[first], keys[first], hashes[first]


def bucket_changes(snaps: np.ndarray, keys: np.ndarray, hashes: np.ndarray, series: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(place, keys, codes)`` of the changes of one bucket, from one sort; snapshots without rows in it are empty."""
    snaps, keys, hashes = unique_sorted(snaps, keys, hashes)
    present, starts = np.unique(snaps, return_index=True)
    part = {int(at): (keys[a:b], hashes[a:b]) for at, a, b in zip(present, starts, np.append(starts[1:], len(keys)), strict=True)}
    none = keys[:0], hashes[:0]
    for at in sorted(part.keys() | {at + 1 for at in part}):
        if 0 < at < series:
            found, codes = compare_sorted(part.get(at - 1, none), part.get(at, none))
            if len(found):
                yield at, found, codes


def planned_bytes(df: DataFrame) -> int:
    """The size of ``df`` as its plan states it for files; rows are counted only where it states none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else 24 * df.count()


def diff_snapshots(snapshots: DataFrame, *, snapshot: str, key: str, compare: list[str], buckets: int | None = None) -> DataFrame:
    """``(snapshot, key, change)`` for every pair of consecutive snapshots.

    ``snapshot`` may be of any orderable type; ``key`` must be an integer. change is ``added`` (in the
    later only), ``removed`` (in the earlier only) or ``changed`` (any compared field differs; null differs
    from every value and equals null). A key counts once per snapshot; if its repeated rows disagree, the
    one with the smallest field hash stands for it. Rows with null key or snapshot belong to no snapshot
    and are left out. One snapshot or none gives no rows. Other columns are never read.
    """
    rows = exact(snapshots, snapshot, key, *compare).where(F.col(f"`{snapshot}`").isNotNull() & F.col(f"`{key}`").isNotNull())
    # One row per snapshot; the only pass besides the comparison reads this column alone.
    names = rows.select(F.col(f"`{snapshot}`").alias("snap")).distinct()
    series = durable(names.select("snap", (F.row_number().over(Window.orderBy("snap")) - 1).alias("at")))
    n_series = series.count()
    small = n_series <= BROADCAST_SERIES
    compact = rows.select(F.col(f"`{snapshot}`").alias("snap"), F.col(f"`{key}`").cast("long").alias("key"), row_hash(*compare).alias("hash"))
    compact = compact.join(F.broadcast(series) if small else series, "snap")
    # Repeated rows are one before they are gathered by key, so a key that holds a third of all rows is as cheap as any other.
    compact = compact.groupBy("at", "key").agg(F.min("hash").alias("hash"))
    buckets = buckets or max(int(snapshots.sparkSession.sparkContext.defaultParallelism), planned_bytes(rows) // BUCKET_BYTES)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(b.column(i)) for i in range(3)] for b in batches if b.num_rows]
        if not parts:
            return
        triples = [np.concatenate([p[i] for p in parts]) for i in range(3)]
        del parts
        for at, found, codes in bucket_changes(*triples, n_series):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), at, np.int32)), pa.array(found), pa.array(codes.astype(np.int32))], ["at", "key", "code"])

    kind = "at int, key long"
    found = compact.repartition(buckets, "key").mapInArrow(bucket, f"{kind}, code int")
    named = found.join(F.broadcast(series) if small else series, "at")
    change = F.element_at(F.array(*[F.lit(c) for c in CHANGES]), F.col("code") + 1)
    return named.select(F.col("snap").alias(snapshot), F.col("key").alias(key), change.alias("change"))


def with_values(changes: DataFrame, snapshots: DataFrame, *, snapshot: str, key: str, fields: list[str]) -> DataFrame:
    """The changes with the later snapshot's full values; only keys that differ are fetched.

    ``removed`` rows have null fields. Repeated rows of a key are reduced to the smallest field tuple.
    """
    wanted = changes.where(F.col("change") != "removed").select(snapshot, key)
    values = (
        exact(snapshots, snapshot, key, *fields).select(F.col(snapshot), F.col(key).cast("long").alias(key), *[F.col(f) for f in fields])
        .join(wanted, [snapshot, key], "left_semi")
        .groupBy(snapshot, key)
        .agg(F.min(F.struct(*fields)).alias("values"))
    )
    return changes.join(values, [snapshot, key], "left").select(snapshot, key, "change", *[F.col(f"values.{f}").alias(f) for f in fields])
