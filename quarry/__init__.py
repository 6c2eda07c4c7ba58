"""A PySpark-native engine for exploring large fact tables and preparing data at scale."""

from quarry.errors import PlanError, UnsupportedSqlError
from quarry.plans.compiler import QueryResult, execute
from quarry.plans.model import EXAMPLE_PLAN, AggregateSpec, FilterSpec, GroupBySpec, QueryPlan, build_plan
from quarry.session import build_session
from quarry.sources.tables import Table, open_table

__all__ = [
    "EXAMPLE_PLAN", "AggregateSpec", "FilterSpec", "GroupBySpec", "PlanError", "QueryPlan", "QueryResult", "Table", "UnsupportedSqlError",
    "build_plan", "build_session", "execute", "open_table",
]
