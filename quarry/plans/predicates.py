"""Filters as two-valued Spark predicates, and their combination in reverse Polish order."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import PlanError
from quarry.plans.model import AND, COMBINERS, NOT, OR, FilterSpec
from quarry.schema import coerce, is_floating, quoted, resolve_column

_COMPARE = {
    "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
}


def leaf(schema: T.StructType, spec: FilterSpec, two_valued: bool = True) -> Column:
    """One filter. A null or NaN field matches no operator, not even ``!=``.

    With ``two_valued`` the result is never null, so that NOT turns it around (without, a leaf can reach the scan).
    """
    name = resolve_column(schema, spec.column)
    kind, column, op = schema[name].dataType, quoted(name), spec.operator
    if op in _COMPARE:
        test = _COMPARE[op](column, coerce(spec.value, kind))
    elif op == "between":
        test = column.between(coerce(spec.value, kind), coerce(spec.value2, kind))
    elif op == "in":
        values = spec.value if isinstance(spec.value, (list, tuple, set)) else [spec.value]
        test = column.isin([coerce(v, kind) for v in values]) if values else F.lit(False)
    else:
        if not isinstance(kind, T.StringType):
            raise PlanError(f"{spec.op} needs a text column, {name} is {kind.simpleString()}")
        if spec.value is None:
            raise PlanError("a filter value may not be null")
        test = column.contains(str(spec.value))
        test = ~test if op == "not_like" else test
    if is_floating(kind) and op in ("neq", "gt", "gte"):
        # NaN is above every number; said by a comparison, since that reaches the scan.
        test = test & (column <= F.lit(float("inf")))
    return F.coalesce(test, F.lit(False)) if two_valued else test


def tokens(combine: tuple[int | str, ...]) -> list[int]:
    out = []
    for token in combine:
        if isinstance(token, str):
            if token.strip().upper() not in COMBINERS:
                raise PlanError(f"unknown combine token {token!r}")
            out.append(COMBINERS[token.strip().upper()])
        else:
            out.append(int(token))
    return out


def where(schema: T.StructType, filters: tuple[FilterSpec, ...], combine: tuple[int | str, ...] = ()) -> Column | None:
    """The predicate of a plan, or None without filters.

    No combination means AND; a list of only AND or only OR folds all filters; otherwise numbers push
    filters and AND (-1), OR (-2), NOT (-3) reduce the stack, which must end with one entry.
    """
    if not filters:
        if combine:
            raise PlanError("combine without filters")
        return None
    numbers = tokens(combine)
    # AND and OR are true for the same rows in two-valued and in SQL's logic: only below NOT must a leaf not be null.
    leaves = [leaf(schema, f, two_valued=NOT in numbers) for f in filters]
    if not numbers or all(n == AND for n in numbers):
        return reduce(and_, leaves)
    if all(n == OR for n in numbers):
        return reduce(or_, leaves)
    stack: list[Column] = []
    for number in numbers:
        if number >= 0:
            if number >= len(leaves):
                raise PlanError(f"combine names filter {number} of {len(leaves)}")
            stack.append(leaves[number])
        elif number == NOT:
            if not stack:
                raise PlanError("NOT without operand")
            stack.append(~stack.pop())
        elif number in (AND, OR):
            if len(stack) < 2:
                raise PlanError("AND/OR without two operands")
            right, left = stack.pop(), stack.pop()
            stack.append(left & right if number == AND else left | right)
        else:
            raise PlanError(f"unknown combine token {number}")
    if len(stack) != 1:
        raise PlanError("combine does not reduce to one predicate")
    return stack[0]
