"""Errors raised by the plan and SQL layers."""


class PlanError(ValueError):
    """A query plan that cannot be compiled against its table."""


class UnsupportedSqlError(ValueError):
    """A statement outside the strict dialect."""
