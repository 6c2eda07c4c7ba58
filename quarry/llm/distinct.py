"""Distinct counts over identifier sets too large to hold, by hash-range decomposition.

Identifiers are reduced to 64-bit hashes and deduplicated, with the groups they occur in, inside disjoint
ranges of the hash. Groups are numbered once, every combination of dimension values and totals being one; the
groups of one identifier and period are bits of (word, mask) rows, one row per 63 numbers that occur. Every
combination is therefore counted exactly inside a range, and the ranges' counts add up. The deduplicated rows
are the mergeable state: partials of other days or files are united and combined by OR.

Error: only two identifiers with one hash are mistaken for one, on average ``n * n / 2**65`` of n; integers
of up to 64 bits never collide.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.schema import exact
from quarry.session import durable

#: Hash ranges are this many leading bits of the hash.
RANGE_BITS = 10
#: Bits of one mask.
WORD = 63
#: A table of at most so many groups (counted before) is broadcast; a larger one is joined by shuffle.
BROADCAST_GROUPS = 200_000


@dataclass(frozen=True)
class Groups:
    """The numbered combinations of some dimensions: ``labels(number, t0, d0, ...)`` and what each cell adds, ``entries(d0, ..., entries)``."""

    dims: tuple[str, ...]
    labels: DataFrame
    entries: DataFrame
    small: bool

    def joined(self, rows: DataFrame, table: DataFrame, on) -> DataFrame:
        return rows.join(F.broadcast(table) if self.small else table, on)


def number_groups(df: DataFrame, dims: list[str]) -> Groups:
    """Number every combination of values and totals of ``dims`` that occurs in ``df`` (null is a value of its own).

    States can be merged if they were made with the same numbers; nothing of the tables is sent to the driver.
    """
    d = [f"d{i}" for i in range(len(dims))]
    cells = exact(df, *dims).select(*[F.col(c).alias(x) for c, x in zip(dims, d, strict=True)]).distinct()
    cells = durable(cells.select(*d, F.monotonically_increasing_id().alias("cell")))
    combos = []
    for totals in product((False, True), repeat=len(dims)):
        flags = [F.lit(t).alias(f"t{i}") for i, t in enumerate(totals)]
        values = [F.when(F.lit(not t), F.col(x)).alias(x) for t, x in zip(totals, d, strict=True)]
        combos.append(F.struct(*flags, *values))
    keys = [f"t{i}" for i in range(len(dims))] + d
    spread = cells.select("cell", F.explode(F.array(*combos)).alias("c")).select("cell", "c.*")
    # Sorted, so that the numbers of one partition follow each other and few words are touched.
    labels = durable(spread.select(*keys).distinct().orderBy(*keys).select(F.monotonically_increasing_id().alias("number"), *keys))
    small = labels.count() <= BROADCAST_GROUPS
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    of_cell = spread.alias("s").join(labels.alias("l"), same).select("cell", F.expr(f"number div {WORD}").alias("word"), F.expr(f"shiftleft(1L, cast(number % {WORD} as int))").alias("mask"))
    words = of_cell.groupBy("cell", "word").agg(F.bit_or("mask").alias("mask"))
    entries = words.groupBy("cell").agg(F.collect_list(F.struct("word", "mask")).alias("entries"))
    return Groups(tuple(dims), labels, durable(cells.join(entries, "cell").drop("cell")), small)


def partials(df: DataFrame, *, at: str, ids: list[str], groups: Groups, period=F.to_date) -> DataFrame:
    """``(bucket, field, hash, period, word, mask)``: the groups of every identifier and period (a function of ``at``).

    Bit i of word w tells that the identifier occurs in group ``63 * w + i``. Null identifiers are not counted;
    a null period or dimension value is a value of its own. Rows whose dimension values were not numbered are
    left out. An identifier that holds a third of all rows shrinks to its few rows per task before the shuffle.
    """
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(f"`{c}`")).alias("hash")) for c in ids])
    d = [F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(groups.dims)]
    rows = exact(df, at, *groups.dims, *ids).select(period(F.col(f"`{at}`")).alias("period"), *d, fields.alias("fields"))
    same = [F.col(f"r.d{i}").eqNullSafe(F.col(f"e.d{i}")) for i in range(len(groups.dims))]
    rows = groups.joined(rows.alias("r"), groups.entries.alias("e"), same if same else F.lit(True)).select("period", "fields", "entries")
    rows = rows.select("period", "entries", F.explode("fields").alias("x")).where(F.col("x.hash").isNotNull())
    rows = rows.select("period", "x.field", "x.hash", F.explode("entries").alias("e")).select("period", "field", "hash", "e.word", "e.mask")
    bucket = F.shiftrightunsigned("hash", 64 - RANGE_BITS).cast("int").alias("bucket")
    return rows.groupBy(bucket, "field", "hash", "period", "word").agg(F.bit_or("mask").alias("mask"))


def merge(state: DataFrame, *others: DataFrame, period: Column | None = None) -> DataFrame:
    """The state of several states over the same groups, or of longer periods (``period`` maps the old one)."""
    for other in others:
        state = state.unionByName(other)
    period = F.col("period") if period is None else period
    return state.groupBy("bucket", "field", "hash", period.alias("period"), "word").agg(F.bit_or("mask").alias("mask"))


def counts(state: DataFrame, *, ids: list[str], groups: Groups) -> DataFrame:
    """``(period, all_<dim>, <dim>, ..., <id>s, error_bound)`` for every combination of values and totals that occurs.

    ``all_<dim>`` is true where the row is a total over that dimension (its value is then null). ``error_bound``
    is n * n / 2**65 for the largest n of the fields, unrounded: no less than the expected number of pairs of equal
    hashes, hence than the expected loss of identifiers and (by Markov's inequality) than the probability that the
    count of any one field is not exact. An empty table gives no rows.
    """
    # Exact counts inside each hash range, one row per range and mask, then added up: few rows leave this stage.
    per_range = state.groupBy("bucket", "period", "field", "word", "mask").count()
    per_mask = per_range.groupBy("period", "field", "word", "mask").agg(F.sum("count").alias("n"))
    # Each mask is laid out into its own bits only.
    bits = F.expr(f"filter(sequence(0, {WORD - 1}), i -> (shiftright(mask, i) & 1L) = 1L)")
    spread = per_mask.select("period", "field", "n", "word", F.explode(bits).alias("bit")).select("period", "field", "n", (F.col("word") * WORD + F.col("bit")).alias("number"))
    sums = [F.coalesce(F.sum(F.when(F.col("field") == c, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, c in enumerate(ids)]
    labelled = groups.joined(spread.groupBy("period", "number").agg(*sums), groups.labels, "number")
    columns = []
    for i, name in enumerate(groups.dims):
        columns += [F.col(f"t{i}").alias(f"all_{name}"), F.col(f"d{i}").alias(name)]
    largest = F.greatest(*[F.col(f"n{i}") for i in range(len(ids))]) if len(ids) > 1 else F.col("n0")
    bound = (largest.cast("double") * largest / F.lit(2.0**65)).alias("error_bound")
    return labelled.select("period", *columns, *[F.col(f"n{i}").alias(f"{c}s") for i, c in enumerate(ids)], bound)
