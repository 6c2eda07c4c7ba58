"""Columns by name or position, and literals coerced to a column's type before Spark sees them."""

from __future__ import annotations

import datetime
import decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import PlanError

EPOCH = datetime.date(1970, 1, 1)
TRUE, FALSE = {"true", "t", "1", "yes"}, {"false", "f", "0", "no"}


def resolve_column(schema: T.StructType, ref: str | int) -> str:
    """Exact, case-sensitive name, or position in the schema."""
    names = schema.fieldNames()
    if isinstance(ref, bool) or not isinstance(ref, (str, int)):
        raise PlanError(f"not a column reference: {ref!r}")
    if isinstance(ref, int):
        if not 0 <= ref < len(names):
            raise PlanError(f"no column number {ref}")
        return names[ref]
    if ref not in names:
        raise PlanError(f"no column {ref!r}")
    return ref


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def epoch_day(text: str) -> int:
    """Days since 1970-01-01 of an ISO date."""
    return (datetime.date.fromisoformat(text) - EPOCH).days


def as_epoch_day(column: Column) -> Column:
    """A date, timestamp or ISO text column as a number of days."""
    return F.unix_date(column.cast("date")).cast("long")


def _number(value: object) -> int | float | decimal.Decimal:
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return value
    text = str(value).strip()
    try:
        return int(text)
    except ValueError:
        pass
    try:
        return epoch_day(text)
    except ValueError:
        pass
    try:
        return float(text)
    except ValueError:
        raise PlanError(f"not a number: {value!r}") from None


def coerce(value: object, kind: T.DataType) -> Column:
    """A literal for comparing with a column of ``kind``; numbers stay exact, ISO dates become days on numbers."""
    if value is None:
        raise PlanError("a filter value may not be null")
    if isinstance(kind, T.BooleanType):
        if isinstance(value, (bool, int, float)):
            return F.lit(bool(value))
        text = str(value).strip().lower()
        if text in TRUE | FALSE:
            return F.lit(text in TRUE)
        raise PlanError(f"not a boolean: {value!r}")
    if is_numeric(kind):
        return F.lit(_number(value))
    if isinstance(kind, T.DateType):
        if isinstance(value, datetime.date):
            return F.lit(value)
        if isinstance(value, int) and not isinstance(value, bool):
            return F.lit(EPOCH + datetime.timedelta(days=value))
        try:
            return F.lit(datetime.date.fromisoformat(str(value).strip()))
        except ValueError:
            raise PlanError(f"not a date: {value!r}") from None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        try:
            moment = value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(str(value).strip())
        except ValueError:
            raise PlanError(f"not a timestamp: {value!r}") from None
        return F.lit(moment.isoformat(sep=" ")).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit(str(value))
    raise PlanError(f"columns of type {kind.simpleString()} cannot be filtered")


def exact(df, *names: str):
    """Only the named columns, matched in exact case (the first of equal names), whatever else the frame holds.

    Columns are addressed by position, so that twins differing in case or not at all are no ambiguity.
    """
    have = df.columns
    if missing := [n for n in names if n not in have]:
        raise PlanError(f"no columns {missing}")
    wanted = list(dict.fromkeys(names))
    places = [f"__c{i}" for i in range(len(have))]
    return df.toDF(*places).select(*[F.col(places[have.index(n)]).alias(n) for n in wanted])
