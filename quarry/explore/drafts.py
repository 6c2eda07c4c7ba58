"""Editable query drafts: what a person fills in, turned into plans."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from quarry.errors import PlanError
from quarry.plans.model import DEFAULT_TOP_K, OPERATORS, QueryPlan, build_plan

MODES = ("search", "aggregate", "table")
KINDS = ("crates", "dependencies", "categories", "maintainers", "trends", "hits")


@dataclass(frozen=True)
class FilterDraft:
    column: str
    op: str
    value: str


@dataclass(frozen=True)
class QueryDraft:
    mode: str = "search"
    search_text: str = ""
    search_column: str = ""
    filters: tuple[FilterDraft, ...] = field(default=())
    group_keys: tuple[str, ...] = ()
    agg_column: str = ""
    select_columns: tuple[str, ...] = ()
    top_k: int = DEFAULT_TOP_K


def parse_value(text: str) -> object:
    """A number or boolean where the text is one, else the text."""
    text = text.strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def draft_filter(draft: FilterDraft) -> dict:
    """``contains`` is like, ``in`` takes a comma list, ``between`` two values with a comma."""
    op = "like" if draft.op == "contains" else draft.op
    if op not in OPERATORS:
        raise PlanError(f"unknown operator {draft.op!r}")
    if op == "between":
        parts = [p.strip() for p in draft.value.split(",")]
        if len(parts) != 2:
            raise PlanError("between needs two values")
        return {"column": draft.column, "op": op, "value": parse_value(parts[0]), "value2": parse_value(parts[1])}
    if op == "in":
        return {"column": draft.column, "op": op, "value": [parse_value(p) for p in draft.value.split(",") if p.strip()]}
    if OPERATORS[op] in ("like", "not_like"):
        return {"column": draft.column, "op": op, "value": draft.value.strip()}
    return {"column": draft.column, "op": op, "value": parse_value(draft.value)}


def build_query_plan(draft: QueryDraft) -> QueryPlan:
    """The plan of a draft; empty filters are skipped and a search text comes first, all joined by AND."""
    if draft.mode not in MODES:
        raise PlanError(f"unknown mode {draft.mode!r}")
    filters = [draft_filter(f) for f in draft.filters if f.column and f.value.strip()]
    if draft.search_text.strip() and draft.search_column:
        filters.insert(0, {"column": draft.search_column, "op": "like", "value": draft.search_text.strip()})
    spec: dict = {"limit": draft.top_k if draft.top_k > 0 else DEFAULT_TOP_K, "filters": filters}
    if draft.mode == "aggregate":
        keys = [k for k in draft.group_keys if k][:2]
        if not keys:
            raise PlanError("pick at least one group-by column")
        value = draft.agg_column or "downloads"
        spec |= {"groupBy": {"keys": keys, "value": value}, "aggregates": [{"column": value}], "groupOrderByCount": True}
    elif draft.mode == "table" and draft.select_columns:
        spec["select"] = list(draft.select_columns)
    return build_plan(spec)


# Per kind of table its mode, search column, group key, measure and shown columns.
DEFAULTS = {
    "crates": ("search", "crate_name", "crate_name", "downloads", ("crate_name", "version", "license", "downloads")),
    "dependencies": ("aggregate", "parent_crate_name", "dep_crate_name", "dependency_id", ("parent_crate_name", "dep_crate_name", "optional")),
    "categories": ("aggregate", "crate_name", "category_name", "crate_downloads", ("crate_name", "category_name", "crate_downloads")),
    "maintainers": ("search", "owner_login", "crate_name", "crate_downloads", ("crate_name", "owner_login", "crate_downloads")),
    "trends": ("aggregate", "crate_name", "crate_name", "downloads", ("date", "crate_name", "version", "downloads")),
    "hits": ("search", "URL", "CounterID", "ResolutionWidth", ("CounterID", "EventDate", "URL", "ResolutionWidth")),
}


def default_draft(kind: str, columns: list[str] | None = None) -> QueryDraft:
    """What to show first; rollups without dates are ranked by the one name column they have."""
    mode, search, key, value, shown = DEFAULTS.get(kind, DEFAULTS["crates"])
    if kind == "trends" and columns is not None and "date" not in columns:
        key = "crate_name" if "crate_name" in columns else "version"
        search, shown = key, (key, "downloads")
    return QueryDraft(mode=mode, search_column=search, group_keys=(key,), agg_column=value, select_columns=shown)


def draft_of(plan: QueryPlan) -> QueryDraft:
    """An editable draft of a plan."""
    filters = []
    for f in plan.filters:
        op = "contains" if f.operator == "like" else f.op
        if f.operator == "in":
            value = ",".join(str(v) for v in f.value)
        elif f.operator == "between":
            value = f"{f.value},{f.value2}"
        else:
            value = str(f.value).lower() if isinstance(f.value, bool) else str(f.value)
        filters.append(FilterDraft(str(f.column), op, value))
    draft = QueryDraft(filters=tuple(filters), top_k=plan.limit or DEFAULT_TOP_K)
    if plan.group_by:
        measure = plan.group_by.value if plan.group_by.value is not None else (plan.aggregates[0].column if plan.aggregates else "")
        return replace(draft, mode="aggregate", group_keys=tuple(map(str, plan.group_by.keys)), agg_column=str(measure))
    if plan.select:
        return replace(draft, mode="table", select_columns=tuple(map(str, plan.select)))
    return draft


def detect_kind(columns: list[str]) -> str:
    """The kind of a table by its column names; the first rule that holds."""
    has = set(columns).issuperset
    if has({"dep_crate_name", "parent_crate_name"}):
        return "dependencies"
    if has({"category_slug", "category_name"}):
        return "categories"
    if has({"owner_login", "owner_kind"}):
        return "maintainers"
    if has({"license"}):
        return "crates"
    if has({"downloads"}) and (has({"date"}) or has({"crate_name"}) or has({"version"})):
        return "trends"
    return "hits" if has({"CounterID"}) or has({"EventDate"}) else "crates"


def narrative(draft: QueryDraft) -> str:
    """A sentence saying what a draft asks for."""
    parts = [f'{draft.search_column} contains "{draft.search_text.strip()}"'] if draft.search_text.strip() and draft.search_column else []
    parts += [f"{f.column} {f.op} {f.value}" for f in draft.filters if f.column and f.value.strip()]
    condition = " where " + " and ".join(parts) if parts else ""
    if draft.mode == "aggregate":
        return f"Top {draft.top_k} groups of {' and '.join(draft.group_keys)} with {draft.agg_column or 'downloads'} statistics{condition}"
    if draft.mode == "table":
        return f"First {draft.top_k} rows of {', '.join(draft.select_columns) or 'all columns'}{condition}"
    return f"First {draft.top_k} matching rows{condition}"
