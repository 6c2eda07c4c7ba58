"""References to records that do not exist.

Distinct non-null foreign keys are anti-joined against the parent keys; the offending keys are joined
back to the references. Only distinct keys meet the parent table, so a key that holds a third of all
references costs one row there; on the way back such keys are spread over salted join buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.schema import exact
from quarry.session import written

#: At most so many keys are salted; the list that is broadcast has this proven bound.
HOT_KEYS = 256
#: Join buckets of a salted key.
SALTS = 64


def name_key(column: Column) -> Column:
    """First blank-separated word, lower case, with ``_`` written as ``-``; null for a null or blank text."""
    word = F.regexp_extract(column, r"(?U)^\s*(\S+)", 1)
    return F.nullif(F.translate(F.lower(word), "_", "-"), F.lit(""))


def reference_key(key_id: Column, key_name: Column) -> Column:
    """One comparable key: the id where there is one, else the normalised name, else null."""
    return F.when(key_id.isNotNull(), F.concat(F.lit("#"), key_id.cast("string"))).otherwise(
        F.concat(F.lit("@"), name_key(key_name))
    )


def parent_facts(parents: DataFrame, removals: DataFrame) -> DataFrame:
    """(key, known, since, gone) per key of ``parents(id, name, since)`` and ``removals(id, name, gone)``.

    ``since`` is the earliest date of the record whatever rows carry it, ``gone`` its earliest removal.
    A record is found under its id and under every name it ever had in either table.
    """
    both = parents.select("id", "name", "since", F.lit(None).cast("timestamp_ntz").alias("gone"), F.lit(True).alias("known")).unionByName(
        removals.select("id", "name", F.lit(None).cast("timestamp_ntz").alias("since"), "gone", F.lit(False).alias("known"))
    )
    named = both.groupBy("id", name_key(F.col("name")).alias("name")).agg(
        F.min("since").alias("since"), F.min("gone").alias("gone"), F.max("known").alias("known")
    )
    by_id = named.where(F.col("id").isNotNull()).groupBy("id").agg(
        F.min("since").alias("id_since"), F.min("gone").alias("id_gone"), F.max("known").alias("id_known")
    )
    names = (
        named.where(F.col("name").isNotNull())
        .join(by_id, "id", "left")
        .groupBy(F.concat(F.lit("@"), F.col("name")).alias("key"))
        .agg(
            F.min(F.least("since", "id_since")).alias("since"),
            F.min(F.least("gone", "id_gone")).alias("gone"),
            F.max(F.coalesce(F.col("id_known"), F.col("known"))).alias("known"),
        )
    )
    ids = by_id.select(
        F.concat(F.lit("#"), F.col("id").cast("string")).alias("key"),
        F.col("id_since").alias("since"), F.col("id_gone").alias("gone"), F.col("id_known").alias("known"),
    )
    return ids.unionByName(names)


def first_records(df: DataFrame, record: str, at: str, keep: list[str]) -> DataFrame:
    """One row per ``record``: that with the earliest ``at`` (nulls last; equal times by the smallest values)."""
    best = F.min(F.struct(F.col(at).isNull().alias("late"), F.col(at).alias("at"), *[F.col(c) for c in keep])).alias("best")
    return df.groupBy(record).agg(best).select(record, F.col("best.at").alias(at), *[F.col(f"best.{c}").alias(c) for c in keep])


def orphan_references(
    references: DataFrame,
    parents: DataFrame,
    removals: DataFrame,
    *,
    record: str,
    at: str,
    ref_id: str,
    ref_name: str,
    parent: tuple[str, str, str],
    removal: tuple[str, str, str],
) -> DataFrame:
    """Rows ``(record, at, key, reason)`` of the references that lead nowhere at the time they were recorded.

    ``parent`` names the id, name and first-seen columns of ``parents``; ``removal`` the id, name and time
    columns of ``removals``. reason is ``missing``, ``later`` (first seen after ``at``) or ``removed``
    (removed at or before ``at``), the first that holds.

    Nulls: a reference with neither id nor a non-blank name refers to nothing and is no orphan; a null
    record id is one record of its own; a null ``at`` can only be ``missing``; a parent without any date
    is never ``later``; parents without id are known by name alone. Repeated records count once, by their
    earliest row. Empty tables give every keyed reference as missing, or no rows. Other columns, whatever
    their names, are not looked at.
    """
    p_id, p_name, p_since = parent
    r_id, r_name, r_gone = removal
    rows = exact(references, record, at, ref_id, ref_name).select(
        F.col(record).alias("record"), F.col(at).alias("at"), reference_key(F.col(ref_id), F.col(ref_name)).alias("key")
    )
    # Both are read more than once below: the records once per pass over them, the offenders as keys and as hot keys.
    rows = written(first_records(rows, "record", "at", ["key"]).where(F.col("key").isNotNull()), "references")
    facts = parent_facts(
        exact(parents, p_id, p_name, p_since).select(F.col(p_id).alias("id"), F.col(p_name).alias("name"), F.col(p_since).alias("since")),
        exact(removals, r_id, r_name, r_gone).select(F.col(r_id).alias("id"), F.col(r_name).alias("name"), F.col(r_gone).alias("gone")),
    )
    keys = rows.groupBy("key").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n"))
    # One outer join tells both: what it leaves without a known parent is the anti-join, dates tell the rest.
    joined = keys.join(facts.where("known").drop("known").withColumn("held", F.lit(True)), "key", "left")
    missing = F.col("held").isNull()
    untimely = (F.col("since") > F.col("first_at")) | (F.col("gone") <= F.col("last_at"))
    offenders = written(joined.where(missing | untimely).select("key", "n", missing.alias("missing"), "since", "gone"), "offenders")
    hot = F.broadcast(offenders.orderBy(F.desc("n"), "key").limit(HOT_KEYS).select("key", F.lit(True).alias("hot")))
    salted = rows.join(hot, "key", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("record"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    )
    spread = offenders.join(hot, "key", "left").withColumn(
        "salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    )
    found = salted.drop("hot").join(spread.drop("hot", "n"), ["key", "salt"])
    reason = (
        F.when(F.col("missing"), F.lit("missing"))
        .when(F.col("since") > F.col("at"), F.lit("later"))
        .when(F.col("gone") <= F.col("at"), F.lit("removed"))
    )
    return found.select(F.col("record").alias(record), F.col("at").alias(at), "key", reason.alias("reason")).where(F.col("reason").isNotNull())


def orphan_report(orphans: DataFrame, table: str, at: str) -> DataFrame:
    """Counts per table, month of ``at`` and reason, and how many different keys were wanted."""
    return (
        orphans.groupBy(F.date_format(F.col(at), "yyyy-MM").alias("period"), "reason")
        .agg(F.count("*").alias("orphans"), F.count_distinct("key").alias("keys"))
        .select(F.lit(table).alias("table_name"), "period", "reason", "orphans", "keys")
    )
