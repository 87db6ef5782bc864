"""The four metrics views over the state's dashboard indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.plans.metrics import MetricsView

# Dimensions that all views have, and the measures of each.
DIMENSIONS = "cds_code school_name district_name county_name aggregate_level academic_year student_group student_group_type performance_color status_level change_level is_charter is_dass".split()
AVERAGES = "status_value prior_status_value change_value".split()
MORE_AVERAGES = {"ela": ["status_value_without_prloss", "curr_participation_rate"]}
SUMS = {
    "chronic_absenteeism": ["curr_denominator", "curr_numerator"],
    "suspension": ["curr_denominator", "curr_numerator"],
    "ela": ["curr_denominator"],
    "elpac": ["curr_denominator", "curr_numerator", "curr_progressed", "curr_maintain_pl4", "curr_declined"],
}
COLORS = "Red Orange Yellow Green Blue".split()


def dashboard_view(exported: DataFrame, board: str) -> MetricsView:
    """The metrics view of an indicator over what ``state.dashboard_export`` gives for it."""
    measures = {a: F.avg(a) for a in AVERAGES + MORE_AVERAGES.get(board, [])} | {s: F.sum(s) for s in SUMS[board]}
    measures["school_count"] = F.count_distinct("cds_code")
    measures |= {f"{c.lower()}_count": F.sum(F.when(F.col("performance_color") == c, 1).otherwise(0)) for c in COLORS}
    return MetricsView(exported, {d: F.col(d) for d in DIMENSIONS}, measures)
