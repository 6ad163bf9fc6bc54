"""Predicates shared by the trace queries."""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import STATUS_ERROR


def all_of(*predicates: Column | None) -> Column:
    """Conjunction of the given predicates; None entries do not count."""
    return reduce(and_, [p for p in predicates if p is not None], F.lit(True))


def equals(column: str, value: str | None) -> Column | None:
    """Equality on a bound value, or nothing when no value is asked for."""
    return F.col(column) == F.lit(value) if value else None


def is_error() -> Column:
    return F.col("status_code") == STATUS_ERROR


def scoped(spans: DataFrame, project_id=None, service=None) -> DataFrame:
    """Rows of one project and one service. Filters come before any grouping,
    so counts and durations of a filtered list cover the matching spans only."""
    return spans.where(all_of(equals("project_id", project_id), equals("service_name", service)))


def tenant_scope(spans: DataFrame, caller_project: str | None, requested: str | None = None) -> DataFrame:
    """Restrict rows to what the caller may see.

    caller_project None is the administrator, who may name any project or none.
    Everyone else sees their own project and gets an error for another one.
    """
    if caller_project is None:
        return scoped(spans, project_id=requested)
    if requested and requested != caller_project:
        raise PermissionError("cross-project access forbidden")
    return spans.where(F.col("project_id") == F.lit(caller_project))


def checked_limit(limit: int) -> int:
    if not 1 <= limit <= 1000:
        raise ValueError("limit must lie between 1 and 1000")
    return limit
