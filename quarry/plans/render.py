"""Plans as ANSI SQL text: to read, to run elsewhere, and to check results against another engine."""

from __future__ import annotations

from quarry.errors import PlanError
from quarry.plans.model import AND, NOT, OR, STATISTICS, FilterSpec, QueryPlan, validate
from quarry.plans.predicates import tokens

_SIGNS = {"eq": "=", "neq": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}


def literal(value: object) -> str:
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def _name(ref: str | int) -> str:
    if not isinstance(ref, str):
        raise PlanError("column numbers cannot be written as SQL without a schema")
    return '"' + ref.replace('"', '""') + '"'


def predicate(spec: FilterSpec) -> str:
    name, op = _name(spec.column), spec.operator
    if op in _SIGNS:
        test = f"{name} {_SIGNS[op]} {literal(spec.value)}"
    elif op == "between":
        test = f"{name} BETWEEN {literal(spec.value)} AND {literal(spec.value2)}"
    elif op == "in":
        values = spec.value if isinstance(spec.value, (list, tuple)) else [spec.value]
        test = f"{name} IN ({', '.join(map(literal, values))})" if values else "FALSE"
    else:
        test = f"strpos({name}, {literal(spec.value)}) {'=' if op == 'not_like' else '>'} 0"
    return f"coalesce({test}, FALSE)"


def condition(plan: QueryPlan) -> str:
    leaves = [predicate(f) for f in plan.filters]
    if not leaves:
        return "TRUE"
    numbers = tokens(plan.combine)
    if all(n == AND for n in numbers):
        return " AND ".join(leaves)
    if all(n == OR for n in numbers):
        return "(" + " OR ".join(leaves) + ")"
    stack: list[str] = []
    for n in numbers:
        if n >= 0:
            stack.append(leaves[n])
        elif n == NOT:
            stack.append(f"(NOT {stack.pop()})")
        else:
            right, left = stack.pop(), stack.pop()
            stack.append(f"({left} {'AND' if n == AND else 'OR'} {right})")
    return stack.pop()


def _statistic(column: str, name: str) -> str:
    return {
        "count": f"count({column})",
        "sum": f"round(coalesce(sum({column}::DOUBLE), 0), 4)",
        "min": f"coalesce(min({column}), 0)",
        "max": f"coalesce(max({column}), 0)",
        "mean": f"round(coalesce(avg({column}::DOUBLE), 0), 4)",
    }[name]


def _page(plan: QueryPlan) -> str:
    return (f" LIMIT {plan.limit}" if plan.limit else "") + (f" OFFSET {plan.offset}" if plan.offset else "")


def to_sql(table: str, plan: QueryPlan, part: str | None = None) -> str:
    """SQL of one part of a plan (projection, groups, aggregates or rows; by default the main one), sums and means rounded to 4 digits."""
    validate(plan)
    part = part or ("groups" if plan.group_by else "aggregates" if plan.aggregates else "projection" if plan.select else "rows")
    source = f"(SELECT *, row_number() OVER () - 1 AS row_id FROM {table}) AS numbered"
    where = condition(plan)
    if part == "groups":
        keys = [_name(k) for k in plan.group_by.keys]
        columns = [*keys, 'count(*) AS "count"']
        if plan.group_by.value is not None:
            columns += [f'{_statistic(_name(plan.group_by.value), s)} AS "{s}"' for s in STATISTICS[1:]]
        if plan.order_by:
            order = [f'{_name(c)} {"DESC" if d else "ASC"}' for c, d in plan.order_by] + keys
        elif plan.group_order_by_count and plan.limit:
            order = ["count(*) DESC", *keys]
        else:
            order = ["min(row_id)"]
        known = "".join(f" AND {k} IS NOT NULL" for k in keys)
        return f"SELECT {', '.join(columns)} FROM {source} WHERE {where}{known} GROUP BY {', '.join(keys)} ORDER BY {', '.join(order)}{_page(plan)}"
    if part == "aggregates":
        columns = [f'{_statistic(_name(a.column), s)} AS "{a.column}_{s}"' for a in plan.aggregates for s in ((a.op,) if a.op else STATISTICS)]
        return f"SELECT {', '.join(dict.fromkeys(columns))} FROM {table} WHERE {where}"
    columns = [_name(c) for c in plan.select] if part == "projection" else ["row_id"]
    order = [f'{_name(c)} {"DESC" if d else "ASC"} NULLS LAST' for c, d in plan.order_by] + ["row_id"]
    limit = _page(plan) if plan.limit else " LIMIT 0"
    return f"SELECT {', '.join(columns)} FROM {source} WHERE {where} ORDER BY {', '.join(order)}{limit}"
