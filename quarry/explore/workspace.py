"""Shareable workspaces: a draft and its table as the query part of an address, and back."""

from __future__ import annotations

import json
from urllib.parse import parse_qs, urlencode

from quarry.errors import PlanError
from quarry.explore.drafts import MODES, FilterDraft, QueryDraft
from quarry.plans.model import DEFAULT_TOP_K


def encode(table: str, draft: QueryDraft) -> str:
    """The parts that differ from an empty draft."""
    parts = {"table": table, "mode": draft.mode, "q": draft.search_text, "qc": draft.search_column, "agg": draft.agg_column}
    parts |= {"by": ",".join(draft.group_keys), "show": ",".join(draft.select_columns)}
    if draft.filters:
        parts["f"] = json.dumps([[f.column, f.op, f.value] for f in draft.filters], separators=(",", ":"))
    if draft.top_k != DEFAULT_TOP_K:
        parts["top"] = str(draft.top_k)
    return urlencode({k: v for k, v in parts.items() if v})


def decode(text: str) -> tuple[str, QueryDraft]:
    """Table and draft of an encoded workspace; PlanError where it makes none."""
    parts = {k: v[-1] for k, v in parse_qs(text.lstrip("?#")).items()}
    try:
        filters = tuple(FilterDraft(*map(str, f)) for f in json.loads(parts.get("f", "[]")))
        top = int(parts.get("top", DEFAULT_TOP_K))
    except (ValueError, TypeError) as error:
        raise PlanError(f"not a workspace: {error}") from None
    mode = parts.get("mode", "search")
    if mode not in MODES:
        raise PlanError(f"unknown mode {mode!r}")
    names = lambda key: tuple(n for n in parts.get(key, "").split(",") if n)
    return parts.get("table", ""), QueryDraft(mode, parts.get("q", ""), parts.get("qc", ""), filters, names("by"), parts.get("agg", ""), names("show"), top)


class History:
    """Undo and redo over immutable states; a new state forgets what was undone."""

    def __init__(self, state: object, depth: int = 100):
        self.past, self.state, self.future, self.depth = [], state, [], depth

    def push(self, state: object) -> None:
        if state != self.state:
            self.past = [*self.past, self.state][-self.depth :]
            self.state, self.future = state, []

    def undo(self) -> object:
        if self.past:
            self.future.append(self.state)
            self.state = self.past.pop()
        return self.state

    def redo(self) -> object:
        if self.future:
            self.past.append(self.state)
            self.state = self.future.pop()
        return self.state
