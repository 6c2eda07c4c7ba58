"""The declarative query plan: filters, boolean combination, groups, statistics, projection, limit."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from quarry.errors import PlanError

# Operator spellings a plan may use, by canonical name.
OPERATORS = {
    "=": "eq", "==": "eq", "eq": "eq", "!=": "neq", "<>": "neq", "neq": "neq", "<": "lt", "lt": "lt", "<=": "lte", "lte": "lte",
    ">": "gt", "gt": "gt", ">=": "gte", "gte": "gte", "between": "between", "in": "in", "like": "like", "not_like": "not_like", "not like": "not_like",
}
# Combination tokens by number and word.
AND, OR, NOT = -1, -2, -3
COMBINERS = {"AND": AND, "OR": OR, "NOT": NOT}
STATISTICS = ("count", "sum", "min", "max", "mean")
DEFAULT_TOP_K = 25


@dataclass(frozen=True)
class FilterSpec:
    column: str | int
    op: str = "="
    value: Any = None
    value2: Any = None

    @property
    def operator(self) -> str:
        name = OPERATORS.get(str(self.op).strip().lower())
        if name is None:
            raise PlanError(f"unknown operator {self.op!r}")
        return name


@dataclass(frozen=True)
class GroupBySpec:
    keys: tuple[str | int, ...]
    value: str | int | None = None


@dataclass(frozen=True)
class AggregateSpec:
    column: str | int
    op: str | None = None


@dataclass(frozen=True)
class QueryPlan:
    """``order_by`` and ``offset`` are extensions; everything else is the common plan shape."""

    limit: int | None = None
    filters: tuple[FilterSpec, ...] = ()
    combine: tuple[int | str, ...] = ()
    group_by: GroupBySpec | None = None
    aggregates: tuple[AggregateSpec, ...] = ()
    group_order_by_count: bool = False
    select: tuple[str | int, ...] = ()
    offset: int = 0
    order_by: tuple[tuple[str, bool], ...] = field(default=())

    def to_dict(self) -> dict:
        """The JSON shape, empty parts left out."""
        out: dict[str, Any] = {}
        if self.limit is not None:
            out["limit"] = self.limit
        if self.filters:
            out["filters"] = [{k: v for k, v in (("column", f.column), ("op", f.op), ("value", f.value), ("value2", f.value2)) if v is not None} for f in self.filters]
        if self.combine:
            out["combine"] = list(self.combine)
        if self.group_by:
            out["groupBy"] = {"keys": list(self.group_by.keys)} | ({"value": self.group_by.value} if self.group_by.value is not None else {})
        if self.aggregates:
            out["aggregates"] = [{"column": a.column} | ({"op": a.op} if a.op else {}) for a in self.aggregates]
        if self.group_order_by_count:
            out["groupOrderByCount"] = True
        if self.select:
            out["select"] = list(self.select)
        if self.offset:
            out["offset"] = self.offset
        if self.order_by:
            out["orderBy"] = [{"column": c, "descending": d} for c, d in self.order_by]
        return out

    def to_json(self) -> str:
        return json.dumps(self.to_dict())


def build_plan(spec: dict | str | None = None, **parts: Any) -> QueryPlan:
    """A plan from its JSON shape (dict or text); unknown parts are rejected, empty ones dropped."""
    shape = json.loads(spec) if isinstance(spec, str) else dict(spec or {})
    shape.update(parts)
    known = {"limit", "filters", "combine", "groupBy", "aggregates", "groupOrderByCount", "select", "offset", "orderBy"}
    if extra := set(shape) - known:
        raise PlanError(f"unknown plan parts: {sorted(extra)}")
    filters = tuple(FilterSpec(_reference(f), f.get("op", "="), f.get("value"), f.get("value2")) for f in shape.get("filters") or ())
    group = shape.get("groupBy")
    return QueryPlan(
        limit=shape.get("limit"),
        filters=filters,
        combine=tuple(shape.get("combine") or ()),
        group_by=GroupBySpec(tuple(group["keys"]), group.get("value")) if group else None,
        aggregates=tuple(AggregateSpec(_reference(a), a.get("op")) for a in shape.get("aggregates") or ()),
        group_order_by_count=bool(shape.get("groupOrderByCount")),
        select=tuple(shape.get("select") or ()),
        offset=int(shape.get("offset") or 0),
        order_by=tuple((o["column"], bool(o.get("descending"))) for o in shape.get("orderBy") or ()),
    )


def _reference(part: dict) -> str | int:
    for name in ("column", "col"):
        if part.get(name) is not None:
            return part[name]
    raise PlanError(f"no column in {part!r}")


EXAMPLE_PLAN = build_plan(
    {
        "limit": 10,
        "filters": [
            {"column": "CounterID", "op": "=", "value": 62},
            {"column": "EventDate", "op": "between", "value": "2013-07-01", "value2": "2013-07-31"},
            {"column": "TraficSourceID", "op": "in", "value": [-1, 6]},
        ],
        "combine": ["AND"],
        "groupBy": {"keys": ["URLHash", "EventDate"]},
        "aggregates": [{"column": "ResolutionWidth"}, {"column": "UserID"}],
    }
)


def validate(plan: QueryPlan) -> None:
    """Reject shapes that have no meaning."""
    if plan.select and (plan.group_by or plan.aggregates):
        raise PlanError("select cannot be combined with groupBy or aggregates")
    if plan.group_by and not 1 <= len(plan.group_by.keys) <= 2:
        raise PlanError("groupBy takes one or two keys")
    if plan.limit is not None and (isinstance(plan.limit, bool) or not isinstance(plan.limit, int) or plan.limit < 0):
        raise PlanError("limit must be a non-negative integer")
    if plan.offset < 0:
        raise PlanError("offset must not be negative")
    for spec in plan.aggregates:
        if spec.op is not None and spec.op not in STATISTICS:
            raise PlanError(f"unknown statistic {spec.op!r}")
