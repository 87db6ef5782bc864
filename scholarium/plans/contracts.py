"""The dashboards' contract queries: small aggregates and lists over the risk, equity, section and correlation views.

Each takes its view as a DataFrame and returns a DataFrame; ``SQL`` holds the
same question as text over a relation named ``v``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarium.functions.expr import mean_exact, rnd, sum_if
from scholarium.plans.surrogate import mean_sql, r

Contract = Callable[[DataFrame], DataFrame]
#: name: (view, query, SQL)
CONTRACTS: dict[str, tuple[str, Contract, str]] = {}


def contract(view: str, sql: str):
    def add(f: Contract) -> Contract:
        CONTRACTS[f.__name__] = (view, f, sql)
        return f

    return add


def _count(where: str) -> tuple[Contract, str]:
    return (lambda v: v.where(where).agg(F.count(F.lit(1)).alias("count"))), f"SELECT count(*) AS count FROM v WHERE {where}"


for _name, _view, _where in (
    ("chronic_students_at_risk", "chronic", "risk_level IN ('Critical', 'High')"),
    ("chronic_declining_attendance", "chronic", "attendance_trend_90d = 'declining' OR attendance_rate_30d < 85"),
    ("wellbeing_high_risk", "wellbeing", "wellbeing_risk_level = 'High'"),
    ("wellbeing_medium_risk", "wellbeing", "wellbeing_risk_level = 'Medium'"),
    ("wellbeing_multi_domain", "wellbeing", "high_risk_domain_count >= 2"),
    ("wellbeing_severe_risk", "wellbeing", "wellbeing_risk_score >= 70"),
):
    CONTRACTS[_name] = (_view, *_count(_where))


@contract("chronic", f"SELECT {r(mean_sql('CASE WHEN chronic_absence_flag = 1 THEN 100 ELSE 0 END', 0), 1)} AS rate FROM v")
def chronic_absence_rate(v):
    return v.agg(rnd(mean_exact(F.when(F.col("chronic_absence_flag") == 1, 100).otherwise(0), 0), 1).alias("rate"))


@contract("chronic", f"SELECT {r('chronic_absenteeism_risk_score * 10', 0)} / 10 AS risk_score, count(*) AS student_count FROM v GROUP BY 1 ORDER BY 1")
def chronic_risk_distribution(v):
    return v.groupBy((rnd(F.col("chronic_absenteeism_risk_score") * 10) / 10).alias("risk_score")).agg(F.count(F.lit(1)).alias("student_count")).orderBy("risk_score")


@contract("chronic", "SELECT risk_level AS risk_classification, count(*) AS count FROM v GROUP BY 1 ORDER BY 1")
def chronic_risk_breakdown(v):
    return v.groupBy(F.col("risk_level").alias("risk_classification")).agg(F.count(F.lit(1)).alias("count")).orderBy("risk_classification")


@contract(
    "chronic",
    f"""SELECT student_key AS student_id, grade, school, {r('chronic_absenteeism_risk_score', 2)} AS risk_score, risk_level, {r('attendance_rate_30d', 1)} AS attendance_30d, discipline_incidents_30d
 FROM v WHERE risk_level IN ('Critical', 'High') ORDER BY chronic_absenteeism_risk_score DESC, student_key LIMIT 50""",
)
def chronic_priority_list(v):
    """The fifty students of highest risk; equal scores go by student."""
    top = v.where(F.col("risk_level").isin("Critical", "High")).orderBy(F.desc("chronic_absenteeism_risk_score"), "student_key").limit(50)
    return top.select(F.col("student_key").alias("student_id"), "grade", "school", rnd("chronic_absenteeism_risk_score", 2).alias("risk_score"), "risk_level", rnd("attendance_rate_30d", 1).alias("attendance_30d"), "discipline_incidents_30d")


@contract("chronic", f"SELECT grade, {r(mean_sql('attendance_rate_30d', 2), 1)} AS avg_30d, {r(mean_sql('attendance_rate_90d', 2), 1)} AS avg_90d, {r(mean_sql('chronic_absenteeism_risk_score', 1), 1)} AS avg_risk FROM v GROUP BY 1 ORDER BY 1")
def chronic_trends_analysis(v):
    mean = lambda c, d: rnd(mean_exact(c, d), 1)
    return v.groupBy("grade").agg(mean("attendance_rate_30d", 2).alias("avg_30d"), mean("attendance_rate_90d", 2).alias("avg_90d"), mean("chronic_absenteeism_risk_score", 1).alias("avg_risk")).orderBy("grade")


@contract("equity", f"SELECT ethnicity, ell, sped, frl, cohort_size, {r('avg_gpa', 2)} AS avg_gpa, {r('pct_good_attendance', 1)} AS pct_good_attendance, {r('pct_no_discipline', 1)} AS pct_no_discipline FROM v WHERE cohort_size >= 5 ORDER BY avg_gpa DESC")
def equity_achievement_outcomes(v):
    return v.where("cohort_size >= 5").select("ethnicity", "ell", "sped", "frl", "cohort_size", rnd("avg_gpa", 2).alias("avg_gpa"), rnd("pct_good_attendance", 1).alias("pct_good_attendance"), rnd("pct_no_discipline", 1).alias("pct_no_discipline")).orderBy(F.desc("avg_gpa"))


@contract("equity", f"SELECT ethnicity AS category, {r('max(avg_gpa) - min(avg_gpa)', 2)} AS disparity_index FROM v WHERE cohort_size >= 5 GROUP BY 1 ORDER BY 2 DESC")
def equity_disparity_index(v):
    return v.where("cohort_size >= 5").groupBy(F.col("ethnicity").alias("category")).agg(rnd(F.max("avg_gpa") - F.min("avg_gpa"), 2).alias("disparity_index")).orderBy(F.desc("disparity_index"))


@contract("equity", f"SELECT ethnicity AS grp, {r(mean_sql('pct_gpa_2_5', 2), 1)} AS gpa_2_5_pct FROM v WHERE cohort_size >= 5 GROUP BY 1 ORDER BY 2 DESC")
def equity_gpa_2_5_by_race(v):
    return v.where("cohort_size >= 5").groupBy(F.col("ethnicity").alias("grp")).agg(rnd(mean_exact("pct_gpa_2_5", 2), 1).alias("gpa_2_5_pct")).orderBy(F.desc("gpa_2_5_pct"))


@contract("equity", f"SELECT ethnicity, count(*) AS groups, {r(mean_sql('cohort_size', 0), 1)} AS avg_cohort_size, {r(mean_sql('pct_gpa_below_2', 2), 1)} AS avg_below_c FROM v WHERE cohort_size >= 5 GROUP BY 1 ORDER BY avg_below_c DESC")
def equity_academic_risk(v):
    return v.where("cohort_size >= 5").groupBy("ethnicity").agg(F.count(F.lit(1)).alias("groups"), rnd(mean_exact("cohort_size", 0), 1).alias("avg_cohort_size"), rnd(mean_exact("pct_gpa_below_2", 2), 1).alias("avg_below_c")).orderBy(F.desc("avg_below_c"))


@contract("sections", f"SELECT course, school, {r('avg_grade', 2)} AS avg_grade, {r('course_avg_grade', 2)} AS course_avg_grade, {r('grade_diff_from_course_avg', 2)} AS diff, enrollment FROM v ORDER BY diff DESC")
def class_perf_vs_peer(v):
    return v.select("course", "school", rnd("avg_grade", 2).alias("avg_grade"), rnd("course_avg_grade", 2).alias("course_avg_grade"), rnd("grade_diff_from_course_avg", 2).alias("diff"), "enrollment").orderBy(F.desc("diff"))


@contract("sections", f"SELECT course, {r(mean_sql('grade_diff_from_course_avg', 2), 1)} AS learning_gain FROM v GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def class_top10(v):
    return v.groupBy("course").agg(rnd(mean_exact("grade_diff_from_course_avg", 2), 1).alias("learning_gain")).orderBy(F.desc("learning_gain"), "course").limit(10)


@contract("sections", f"SELECT {r('avg_grade / 0.5::DOUBLE', 0)} * 0.5::DOUBLE AS gain_range, count(*) AS class_count FROM v GROUP BY 1 ORDER BY 1")
def class_growth_trajectory(v):
    return v.groupBy((rnd(F.col("avg_grade") / 0.5) * 0.5).alias("gain_range")).agg(F.count(F.lit(1)).alias("class_count")).orderBy("gain_range")


@contract("correlations", f"SELECT correlation_pair, {r('correlation_coefficient', 3)} AS correlation_coefficient, data_points, expected_direction, strength FROM v ORDER BY abs(correlation_coefficient) DESC")
def perf_key_correlations(v):
    return v.orderBy(F.abs("correlation_coefficient").desc()).select("correlation_pair", rnd("correlation_coefficient", 3).alias("correlation_coefficient"), "data_points", "expected_direction", "strength")


@contract("correlations", "SELECT strength, count(*) AS correlations FROM v WHERE strength IS NOT NULL GROUP BY 1 ORDER BY 2 DESC")
def perf_intervention_status(v):
    return v.where("strength IS NOT NULL").groupBy("strength").agg(F.count(F.lit(1)).alias("correlations")).orderBy(F.desc("correlations"))


@contract("correlations", f"SELECT expected_direction, {r(mean_sql('abs(correlation_coefficient)', 3) + ' * 100.0::DOUBLE', 1)} AS completion_pct FROM v WHERE expected_direction IS NOT NULL GROUP BY 1 ORDER BY 2 DESC")
def perf_completion_rate(v):
    return v.where("expected_direction IS NOT NULL").groupBy("expected_direction").agg(rnd(mean_exact(F.abs("correlation_coefficient"), 3) * 100.0, 1).alias("completion_pct")).orderBy(F.desc("completion_pct"))


@contract(
    "correlations",
    f"SELECT expected_direction, count(*) AS n, {r(mean_sql('correlation_coefficient', 3), 3)} AS mean, {r(mean_sql('abs(correlation_coefficient)', 3) + ' * 100.0::DOUBLE', 1)} AS size FROM v WHERE expected_direction IS NOT NULL GROUP BY 1 ORDER BY 3 DESC",
)
def perf_roi(v):
    sums = v.where("expected_direction IS NOT NULL").groupBy("expected_direction").agg(F.count(F.lit(1)).alias("n"), rnd(mean_exact("correlation_coefficient", 3), 3).alias("mean"), rnd(mean_exact(F.abs("correlation_coefficient"), 3) * 100.0, 1).alias("size"))
    return sums.orderBy(F.desc("mean"))


_DOMAINS = {"Academic": "academic_risk_score >= 70", "Behavioral": "discipline_risk_score >= 70", "Attendance": "attendance_risk_score >= 70", "Multi-Domain": "high_risk_domain_count >= 2"}


@contract("wellbeing", " UNION ALL ".join(f"SELECT '{k}' AS domain, sum(CASE WHEN {c} THEN 1 ELSE 0 END)::BIGINT AS count FROM v" for k, c in _DOMAINS.items()))
def wellbeing_domain_breakdown(v):
    """Four counts from one aggregation, unpivoted."""
    counts = v.agg(*(sum_if(F.expr(c)).alias(k) for k, c in _DOMAINS.items()))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("domain"), F.col(f"`{k}`").alias("count")) for k in _DOMAINS))))


@contract("wellbeing", "SELECT wellbeing_risk_level, count(*) AS student_count FROM v GROUP BY 1 ORDER BY 1")
def wellbeing_caseload(v):
    return v.groupBy("wellbeing_risk_level").agg(F.count(F.lit(1)).alias("student_count")).orderBy("wellbeing_risk_level")


@contract(
    "wellbeing",
    f"SELECT wellbeing_risk_level, count(*) AS students, {r(mean_sql('attendance_risk_score', 1), 1)} AS attendance, {r(mean_sql('discipline_risk_score', 1), 1)} AS discipline, {r(mean_sql('academic_risk_score', 1), 1)} AS academic FROM v GROUP BY 1 ORDER BY 1 DESC",
)
def wellbeing_resource_allocation(v):
    mean = lambda d: rnd(mean_exact(f"{d}_risk_score", 1), 1).alias(d)
    return v.groupBy("wellbeing_risk_level").agg(F.count(F.lit(1)).alias("students"), mean("attendance"), mean("discipline"), mean("academic")).orderBy(F.desc("wellbeing_risk_level"))


# The dashboards' load queries

_RISKY = "risk_level IN ('High', 'Critical')"


@contract("chronic", f"SELECT count(DISTINCT student_key) AS count FROM v WHERE {_RISKY}")
def dash_at_risk_count(v):
    return v.where(_RISKY).agg(F.count_distinct("student_key").alias("count"))


@contract("chronic", f"SELECT {r('count(CASE WHEN risk_level <> ' + chr(39) + 'Low' + chr(39) + ' THEN 1 END) * 100.0::DOUBLE / count(DISTINCT student_key)', 1)} AS rate FROM v")
def dash_chronic_rate(v):
    return v.agg(rnd(F.count(F.when(F.col("risk_level") != "Low", 1)) * 100.0 / F.nullif(F.count_distinct("student_key"), F.lit(0)), 1).alias("rate"))


@contract("chronic", "SELECT risk_level, count(DISTINCT student_key) AS count FROM v GROUP BY 1")
def dash_risk_distribution(v):
    return v.groupBy("risk_level").agg(F.count_distinct("student_key").alias("count"))


@contract("chronic", f"SELECT student_key, risk_level, attendance_rate_30d FROM v WHERE {_RISKY} ORDER BY chronic_absenteeism_risk_score DESC, student_key LIMIT 50")
def dash_top_at_risk(v):
    """Fifty students; equal scores go by student."""
    return v.where(_RISKY).orderBy(F.desc("chronic_absenteeism_risk_score"), "student_key").limit(50).select("student_key", "risk_level", "attendance_rate_30d")


@contract("chronic", "SELECT grade, count(DISTINCT student_key) AS total, count(CASE WHEN risk_level = 'High' THEN 1 END) AS high_count FROM v GROUP BY 1")
def dash_by_grade(v):
    return v.groupBy("grade").agg(F.count_distinct("student_key").alias("total"), F.count(F.when(F.col("risk_level") == "High", 1)).alias("high_count"))


@contract("wellbeing", "SELECT count(*) AS count FROM v")
def dash_wellbeing_count(v):
    return v.agg(F.count(F.lit(1)).alias("count"))


@contract("wellbeing", "SELECT * FROM v ORDER BY student_key LIMIT 100")
def dash_wellbeing_sample(v):
    """The first hundred by student, so that the sample is always the same."""
    return v.orderBy("student_key").limit(100)


@contract("equity", "SELECT count(*) AS count FROM v")
def dash_equity_load(v):
    return v.agg(F.count(F.lit(1)).alias("count"))
