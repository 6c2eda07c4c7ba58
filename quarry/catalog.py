"""A catalog of questions about the tables, each a plan with a time budget and the least rows it should give.

A question names its table, what it asks, how it is asked, how long it may take there (seconds, warm session,
one machine) and how many rows come back at least where the table holds data. Those with a place are presets of
the explorer, in that order per kind of table. Values that depend on the data (names, days) are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from quarry.plans.model import QueryPlan, build_plan


@dataclass(frozen=True)
class Question:
    table: str
    asks: str
    plan: QueryPlan
    seconds: float
    rows: int
    #: Place among the presets of its kind of table, 0 if it is none.
    place: int = 0

    @property
    def kind(self) -> str:
        return KINDS[self.table]


#: Kind of table (see the explorer's drafts) per table.
KINDS = {
    "crates_versions": "crates", "crates_dependencies": "dependencies", "crates_categories": "categories", "crate_maintainers": "maintainers",
    "version_downloads_daily": "trends", "events": "hits", "lineitem": "hits",
}


def questions(*, crate: str, rival: str, wanted: str, owner: str, piece: str, since: str, until: str) -> dict[str, Question]:
    """The catalog by name.

    ``crate`` and ``rival`` are crates with many rows, ``wanted`` a crate many depend on, ``owner`` a login, ``piece`` a part
    of crate names, ``since`` and ``until`` days (ISO) within the downloads.
    """
    found: dict[str, Question] = {}

    def ask(name: str, table: str, asks: str, seconds: float, rows: int, place: int = 0, **plan: object) -> None:
        found[name] = Question(table, asks, build_plan(plan), seconds, rows, place)

    def by(*keys: str, value: str | None = None) -> dict:
        return {"keys": list(keys)} | ({"value": value} if value else {})

    def where(column: str, op: str, value: object, value2: object = None) -> dict:
        return {"column": column, "op": op, "value": value} | ({} if value2 is None else {"value2": value2})

    t = "crates_versions"
    ask("license_shares", t, "How are versions and downloads spread over licenses?", 5, 5, 1, groupBy=by("license", value="downloads"), groupOrderByCount=True, limit=15)
    ask("largest_versions", t, "Which versions are the largest?", 5, 20, 2, select=["crate_name", "version", "crate_size"], orderBy=[{"column": "crate_size", "descending": True}], limit=20)
    ask("newest_versions", t, "What was published last?", 5, 30, 3, select=["crate_name", "version", "published_date"], orderBy=[{"column": "published_date", "descending": True}, {"column": "version_id"}], limit=30)
    ask("withdrawn_by_edition", t, "How many versions of each edition were withdrawn?", 5, 2, 4, groupBy=by("edition", "yanked", value="crate_size"))
    ask("libraries_and_programs", t, "Do libraries need more crates than programs?", 5, 2, 5, groupBy=by("has_lib", value="dep_count"))
    ask("compiler_floor", t, "Which compiler do the most used versions ask for?", 5, 2, 6, groupBy=by("rust_version", value="downloads"), orderBy=[{"column": "sum", "descending": True}], limit=12)
    ask("large_withdrawn", t, "Which large versions were withdrawn?", 5, 0, 7, filters=[where("yanked", "=", True), where("crate_size", ">=", 200_000)], select=["crate_name", "version", "crate_size", "published_date"], limit=35)
    ask("busiest_crates", t, "Which crates sum up the most downloads?", 5, 10, groupBy=by("crate_name", value="downloads"), orderBy=[{"column": "sum", "descending": True}], limit=18)
    ask("unlicensed_or_old", t, "What is without a license text or of an early edition?", 5, 1, filters=[where("license", "=", ""), where("edition", "<=", 2015)], combine=["OR"], aggregates=[{"column": "version_id"}, {"column": "downloads"}])
    ask("neither_new_nor_used", t, "How many versions are neither of a late edition nor used?", 5, 1, filters=[where("edition", ">=", 2021), where("downloads", ">", 100)], combine=[0, 1, "OR", "NOT"], aggregates=[{"column": "downloads", "op": "count"}, {"column": "crate_size"}])
    ask("middling_downloads", t, "What do versions with some hundred downloads look like?", 5, 1, filters=[where("downloads", "between", 200, 900)], aggregates=[{"column": "downloads"}, {"column": "dep_count"}, {"column": "crate_size"}])
    ask("names_with", t, "Which versions have a name like this?", 5, 0, filters=[where("crate_name", "like", piece)], limit=45)
    ask("names_without", t, "How are the others licensed?", 5, 5, filters=[where("crate_name", "not_like", piece)], groupBy=by("license"), groupOrderByCount=True, limit=9)
    ask("versions_of_one", t, "Which versions does one crate have?", 5, 1, filters=[where("crate_name", "=", crate)], select=["version", "published_date", "downloads", "license"], orderBy=[{"column": "published_date"}, {"column": "version_id"}], limit=500)
    ask("rivals", t, "How do two crates compare by edition?", 5, 1, filters=[where("crate_name", "in", [crate, rival])], groupBy=by("crate_name", "edition", value="downloads"))
    ask("year_of_versions", t, "How many versions came in one year?", 5, 1, filters=[where("published_date", ">=", "2024-01-01"), where("published_date", "<", "2025-01-01")], aggregates=[{"column": "version_id", "op": "count"}, {"column": "downloads"}])

    t = "crates_dependencies"
    ask("kinds_of_edges", t, "How many edges are there of each kind, optional or not?", 10, 4, 1, groupBy=by("kind", "optional"))
    ask("most_wanted", t, "Which names are wanted most?", 10, 12, 2, groupBy=by("dep_crate_name"), groupOrderByCount=True, limit=12)
    ask("most_needy", t, "Which crates want the most?", 10, 10, 3, groupBy=by("parent_crate_name"), groupOrderByCount=True, limit=16)
    ask("needed_to_build", t, "What is needed to build only?", 10, 5, 4, filters=[where("kind", "=", 2)], groupBy=by("dep_crate_name"), groupOrderByCount=True, limit=14)
    ask("users_of_one", t, "Who wants one crate, and how often is it optional?", 10, 1, 5, filters=[where("dep_crate_name", "=", wanted)], groupBy=by("parent_crate_name", "optional"), groupOrderByCount=True, limit=28)
    ask("needs_of_one", t, "What does one crate want?", 10, 1, filters=[where("parent_crate_name", "=", crate)], groupBy=by("dep_crate_name", "kind"))
    ask("edges_lately", t, "Which edges were recorded last?", 10, 20, select=["recorded_at", "parent_crate_name", "dep_crate_name"], orderBy=[{"column": "recorded_at", "descending": True}, {"column": "dependency_id"}], limit=20)
    ask("required_edges", t, "How many edges of normal use are required?", 10, 1, filters=[where("kind", "=", 0), where("optional", "=", False)], aggregates=[{"column": "dependency_id", "op": "count"}, {"column": "version_id"}])
    ask("tests_or_builds_of_one", t, "Where is one crate wanted for tests or builds?", 10, 0, filters=[where("dep_crate_name", "=", wanted), where("kind", "=", 1), where("kind", "=", 2)], combine=[1, 2, "OR", 0, "AND"], select=["parent_crate_name", "kind", "optional"], limit=26)
    ask("edges_without_id", t, "How many edges have a name but no known crate?", 10, 1, filters=[where("dep_crate_id", ">=", 0)], combine=[0, "NOT"], aggregates=[{"column": "dependency_id", "op": "count"}])

    t = "crates_categories"
    ask("category_sizes", t, "Which categories are the largest?", 3, 5, 1, groupBy=by("category_name", value="crate_downloads"), groupOrderByCount=True, limit=11)
    ask("category_downloads", t, "Which categories are downloaded most?", 3, 5, 2, groupBy=by("category_slug", value="crate_downloads"), orderBy=[{"column": "sum", "descending": True}], limit=13)
    ask("categories_of_one", t, "Which categories does one crate have?", 3, 0, 3, filters=[where("crate_name", "=", crate)], select=["category_slug", "category_name", "crate_downloads"], limit=22)
    ask("mapping_crates", t, "What is there on mapping?", 3, 1, filters=[where("category_slug", "like", "mapping")], groupBy=by("crate_name", value="crate_downloads"), orderBy=[{"column": "max", "descending": True}], limit=17)
    ask("without_known_total", t, "How many rows have no known total?", 3, 1, filters=[where("crate_downloads", "=", 0)], groupBy=by("category_slug"))

    t = "crate_maintainers"
    ask("busiest_owners", t, "Who owns the most crates?", 3, 5, 1, groupBy=by("owner_login", value="crate_downloads"), groupOrderByCount=True, limit=19)
    ask("teams_and_people", t, "How much do teams own, how much people?", 3, 1, 2, groupBy=by("owner_kind", value="crate_downloads"))
    ask("crates_of_one_owner", t, "What does one owner have?", 3, 1, 3, filters=[where("owner_login", "=", owner)], select=["crate_name", "crate_downloads"], orderBy=[{"column": "crate_downloads", "descending": True}, {"column": "crate_name"}], limit=200)
    ask("owners_of_used_crates", t, "Who owns crates that are used?", 3, 1, filters=[where("crate_downloads", ">", 10_000)], groupBy=by("owner_login", "owner_kind", value="crate_downloads"), groupOrderByCount=True, limit=21)
    ask("logins_with", t, "Which logins hold this piece?", 3, 0, filters=[where("owner_login", "like", piece[:2])], groupBy=by("owner_login"))

    t = "version_downloads_daily"
    ask("busiest_days", t, "On which days was most downloaded?", 15, 14, 1, groupBy=by("date", value="downloads"), orderBy=[{"column": "sum", "descending": True}], limit=14)
    ask("span_ranking", t, "Which crates lead between two days?", 15, 5, 2, filters=[where("date", "between", since, until)], groupBy=by("crate_name", value="downloads"), orderBy=[{"column": "sum", "descending": True}], limit=23)
    ask("days_of_one", t, "How did one crate fare day by day?", 15, 1, 3, filters=[where("crate_name", "=", crate), where("date", ">=", since)], groupBy=by("date", value="downloads"))
    ask("versions_in_use", t, "Which versions of one crate are in use?", 15, 1, 4, filters=[where("crate_name", "=", crate)], groupBy=by("version", value="downloads"), groupOrderByCount=True, limit=24)
    ask("two_side_by_side", t, "How do two crates compare since a day?", 15, 1, 5, filters=[where("date", ">=", since), where("crate_name", "in", [crate, rival])], groupBy=by("crate_name", "date", value="downloads"))
    ask("idle_rows", t, "Which crates have the most days without a download?", 15, 1, filters=[where("downloads", "=", 0)], groupBy=by("crate_name"), groupOrderByCount=True, limit=27)
    ask("largest_days", t, "What were the largest single days?", 15, 32, select=["date", "crate_name", "version", "downloads"], orderBy=[{"column": "downloads", "descending": True}, {"column": "version_id"}], limit=32)
    ask("late_records", t, "How large are rows recorded late?", 15, 0, filters=[where("recorded_at", ">", until)], aggregates=[{"column": "downloads"}])

    t = "events"
    ask("kinds_of_events", t, "What happens how often?", 3, 2, 1, groupBy=by("event_type", value="value"))
    ask("active_users", t, "Who is most active?", 3, 10, 2, groupBy=by("user_id", value="value"), groupOrderByCount=True, limit=29)
    ask("dearest_events", t, "Which events have the greatest value?", 3, 15, 3, select=["event_id", "event_type", "value"], orderBy=[{"column": "value", "descending": True}, {"column": "event_id"}], limit=15)
    ask("trail_of_one_user", t, "What did one user do?", 3, 0, filters=[where("user_id", "=", 7)], select=["ts", "event_type", "value"], orderBy=[{"column": "ts"}, {"column": "event_id"}], limit=1000)
    ask("errors_per_user", t, "Who meets errors?", 3, 1, filters=[where("event_type", "=", "error")], groupBy=by("user_id", "event_type"))

    t = "lineitem"
    ask("flags_and_status", t, "How do flags and status go together?", 5, 3, groupBy=by("l_returnflag", "l_linestatus", value="l_extendedprice"))
    ask("dear_or_plenty", t, "What is dear or comes in plenty?", 5, 1, filters=[where("l_extendedprice", ">", 95_000.5), where("l_quantity", ">=", 49)], combine=["OR"], aggregates=[{"column": "l_quantity"}, {"column": "l_discount"}])
    ask("suppliers_by_price", t, "Which suppliers charge most on average?", 5, 8, groupBy=by("l_suppkey", value="l_extendedprice"), orderBy=[{"column": "mean", "descending": True}], limit=8)
    return found


def presets(catalog: dict[str, Question]) -> dict[str, list[str]]:
    """The names of each kind's presets, in their order."""
    placed = sorted((q.place, name) for name, q in catalog.items() if q.place)
    return {kind: [name for _, name in placed if catalog[name].kind == kind] for kind in dict.fromkeys(KINDS.values())}


def over_budget(catalog: dict[str, Question], took: dict[str, tuple[float, int]]) -> dict[str, str]:
    """What is wrong with each measured question (seconds, rows), if anything."""
    out = {}
    for name, (seconds, rows) in took.items():
        if seconds > catalog[name].seconds:
            out[name] = f"{seconds:.1f} s of {catalog[name].seconds}"
        elif rows < catalog[name].rows:
            out[name] = f"{rows} rows of {catalog[name].rows}"
    return out
