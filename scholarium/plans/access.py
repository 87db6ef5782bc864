"""Row-level access by role."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The column that bounds each role, who may open each dashboard, and who may export.
SCOPE = {"admin": None, "analyst": "district_id", "principal": "school_id", "teacher": "class_id", "student": "student_key", "parent": "student_key"}
DASHBOARDS = {
    "chronic_absenteeism": ("admin", "principal", "analyst"),
    "wellbeing": ("admin", "principal", "analyst"),
    "equity_outcomes": ("admin", "principal", "analyst"),
    "class_effectiveness": ("admin", "principal", "teacher"),
    "performance_correlations": ("admin", "principal", "analyst"),
}
EXPORTERS = frozenset({"admin", "analyst", "principal"})


@dataclass(frozen=True)
class User:
    role: str
    values: tuple = ()


def predicate(user: User) -> Column:
    """What rows a user may see; unknown roles see none."""
    if user.role not in SCOPE:
        return F.lit(False)
    column = SCOPE[user.role]
    return F.lit(True) if column is None else F.coalesce(F.col(column).isin(list(user.values)), F.lit(False))


def secured(rows: DataFrame, user: User) -> DataFrame:
    return rows.where(predicate(user))


def may_export(user: User) -> bool:
    return user.role in EXPORTERS


def may_open(user: User, dashboard: str) -> bool:
    """Whether a role may open a dashboard; no one may open one that is not known."""
    return user.role in DASHBOARDS.get(dashboard, ())
