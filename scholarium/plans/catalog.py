"""The registered queries: each operator on the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.functions import expr as E
from scholarium.operators import academics, attendance, batch, matching, quality, schools, transform
from scholarium.plans import access, contracts, metrics
from scholarium.plans.surrogate import DAILY, GRADES, INCIDENTS, STUDENTS, count_if, daily, grades, incidents, mean_sql, mean_tenths, pct, r, students, t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SALT = "example-salt"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def case(x: str, names: dict[str, str], other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {other} END"


# Attendance

#: The events hold 30 days, so the windows of the surrogate are shorter than the library's defaults.
WINDOWS = (("7d", 7), ("14d", 14), ("21d", 21), ("term", 30))
SHORT = {"windows": WINDOWS, "short": "7d", "long": "21d"}

WINDOWS_SQL = f"""windows AS (
  WITH latest AS (SELECT max(d) AS latest_date FROM daily),
  window_defs(window_type, window_days) AS (VALUES ('7d', 7), ('14d', 14), ('21d', 21), ('term', 30)),
  metrics AS (
    SELECT student_key, window_type, count(*) AS total_school_days, {count_if("NOT absent")} AS present_days, {count_if("absent")} AS absent_days,
           {count_if("absent AND NOT unexcused")} AS excused_absences, {count_if("unexcused")} AS unexcused_absences, {count_if("tardy")} AS tardy_incidents,
           {pct("NOT absent")} AS attendance_rate, {pct("unexcused")} AS unexcused_absence_rate, {pct("tardy")} AS tardy_rate
    FROM daily CROSS JOIN window_defs JOIN latest ON d >= latest_date - window_days WHERE dayofweek(d) NOT IN (0, 6) GROUP BY 1, 2),
  trend AS (
    SELECT a.student_key, CASE WHEN a.attendance_rate < b.attendance_rate - 2 THEN 'declining' WHEN a.attendance_rate > b.attendance_rate + 2 THEN 'improving' ELSE 'stable' END AS pattern_direction
    FROM metrics a JOIN metrics b ON a.student_key = b.student_key AND a.window_type = '7d' AND b.window_type = '21d'),
  by_day AS (SELECT student_key, d AS incident_date, count(*) AS incident_cnt FROM incidents GROUP BY 1, 2),
  window_discipline AS (
    SELECT student_key, window_type, sum(incident_cnt)::BIGINT AS n FROM by_day CROSS JOIN window_defs JOIN latest ON incident_date >= latest_date - window_days GROUP BY 1, 2)
  SELECT m.student_key, (latest_date - window_days)::DATE AS window_start_date, m.window_type, total_school_days, present_days, absent_days, excused_absences, unexcused_absences, tardy_incidents,
    attendance_rate, {r("100.0::DOUBLE - attendance_rate", 2)} AS absence_rate, unexcused_absence_rate, tardy_rate,
    (CASE WHEN 100.0::DOUBLE - attendance_rate >= 10.0 THEN 1 ELSE 0 END)::BIGINT AS chronic_absence_flag, coalesce(n, 0)::BIGINT AS discipline_incidents_in_window,
    {r("least((100.0::DOUBLE - attendance_rate) / 10.0::DOUBLE * (coalesce(n, 0) * 10.0::DOUBLE), 100.0::DOUBLE)", 0)} AS absence_discipline_correlation_score,
    coalesce(pattern_direction, 'stable') AS pattern_direction
  FROM metrics m CROSS JOIN latest JOIN window_defs USING (window_type) LEFT JOIN trend t ON m.student_key = t.student_key
  LEFT JOIN window_discipline w ON m.student_key = w.student_key AND m.window_type = w.window_type)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attendance.student_windows(daily(spark, sf_dir), incidents(spark, sf_dir), **SHORT)


@query(f"WITH {DAILY}, {INCIDENTS}, {WINDOWS_SQL} SELECT * FROM windows")
def attendance_windows(spark, sf_dir):
    return attendance.attendance_windows(daily(spark, sf_dir), incidents(spark, sf_dir), **SHORT)


@query(
    f"""WITH {DAILY} SELECT student_key, days_enrolled, days_present, days_absent, days_excused, days_tardy,
  {r("days_present::DOUBLE / days_enrolled", 4)} AS attendance_rate, {r("days_absent::DOUBLE / days_enrolled", 4)} AS absence_rate,
  {r("days_excused::DOUBLE / days_enrolled", 4)} AS excused_rate FROM (
  SELECT student_key, count(*) AS days_enrolled, {count_if("NOT absent")} AS days_present, {count_if("absent")} AS days_absent,
  {count_if("absent AND NOT unexcused")} AS days_excused, {count_if("tardy")} AS days_tardy FROM daily WHERE dayofweek(d) NOT IN (0, 6) GROUP BY 1)"""
)
def attendance_summary(spark, sf_dir):
    return attendance.attendance_summary(daily(spark, sf_dir), ["student_key"])


DISCIPLINE_SQL = """discipline AS (
  WITH base AS (SELECT student_key, d AS incident_date, DATE '2024-01-20' AS today FROM incidents),
  combined AS (
    SELECT student_key, today - 7 AS window_start_date, '7d' AS window_type, count(*) AS incident_count FROM base WHERE incident_date >= today - 7 AND incident_date <= today GROUP BY 1, 2
    UNION ALL SELECT student_key, today - 14, '14d', count(*) FROM base WHERE incident_date >= today - 14 AND incident_date <= today GROUP BY 1, 2
    UNION ALL SELECT student_key, date_trunc('quarter', today), 'term', count(*) FROM base WHERE incident_date >= date_trunc('quarter', today) AND incident_date <= today GROUP BY 1, 2)
  SELECT student_key, window_start_date::DATE AS window_start_date, window_type, incident_count, incident_count AS incident_frequency_rate FROM combined WHERE student_key IS NOT NULL)"""


def _discipline(spark, sf_dir, windows=(("7d", 7), ("14d", 14))):
    return attendance.discipline_windows(incidents(spark, sf_dir), F.to_date(F.lit("2024-01-20")), windows=windows)


@query(f"WITH {INCIDENTS}, {DISCIPLINE_SQL} SELECT * FROM discipline")
def discipline_windows(spark, sf_dir):
    return _discipline(spark, sf_dir)


FEATURES_SQL = f"""features AS (
  WITH latest AS (SELECT max(d) AS latest_date FROM daily), days AS (SELECT * FROM daily WHERE dayofweek(d) NOT IN (0, 6)),
  a7 AS (SELECT student_key, {count_if("absent")} AS days_absent, {pct("NOT absent")} AS rate FROM days JOIN latest ON d >= latest_date - 7 GROUP BY 1),
  a21 AS (SELECT student_key, {count_if("absent")} AS days_absent FROM days JOIN latest ON d >= latest_date - 21 GROUP BY 1),
  aa AS (SELECT student_key, count(*) AS days_enrolled, {count_if("absent")} AS days_absent, {count_if("unexcused")} AS days_unexcused, {count_if("tardy")} AS days_tardy FROM days GROUP BY 1)
  SELECT s.student_key, s.school, s.grade, s.sped, s.ell, s.frl, coalesce(a7.days_absent, 0)::BIGINT AS days_absent_30d, coalesce(a21.days_absent, 0)::BIGINT AS days_absent_90d,
    coalesce(aa.days_unexcused, 0)::BIGINT AS unexcused_absences_total, coalesce(aa.days_tardy, 0)::BIGINT AS tardies_total, coalesce(a7.rate, 100.0)::DOUBLE AS attendance_rate_30d,
    CASE WHEN aa.days_enrolled > 0 AND aa.days_absent::DOUBLE / aa.days_enrolled >= 0.10::DOUBLE THEN true ELSE false END AS chronic_absence_flag
  FROM students s LEFT JOIN a7 USING (student_key) LEFT JOIN a21 USING (student_key) LEFT JOIN aa USING (student_key))"""


def _absence_features(spark, sf_dir):
    s = students(spark, sf_dir).select("student_key", "school", "grade", "sped", "ell", "frl")
    return attendance.chronic_absence_features(s, daily(spark, sf_dir), short=7, long=21)


@query(f"WITH {DAILY}, {STUDENTS}, {FEATURES_SQL} SELECT * FROM features")
def chronic_absence_features(spark, sf_dir):
    return _absence_features(spark, sf_dir)


@query(
    f"""WITH {DAILY}, {STUDENTS}, {FEATURES_SQL}, parts AS (SELECT student_key, least(100, ceil(days_absent_30d::DOUBLE * 10))::DOUBLE AS recent_absence_score,
  least(100, ceil(days_absent_90d::DOUBLE * 3))::DOUBLE AS trend_absence_score, least(100, ceil(unexcused_absences_total::DOUBLE * 5))::DOUBLE AS unexcused_score,
  days_absent_30d, days_absent_90d, attendance_rate_30d, chronic_absence_flag FROM features),
 scored AS (SELECT *, {r("recent_absence_score * 0.5::DOUBLE + trend_absence_score * 0.3::DOUBLE + unexcused_score * 0.2::DOUBLE", 1)} AS chronic_absence_risk_score FROM parts)
SELECT *, CASE WHEN chronic_absence_risk_score > 70 THEN 'CRITICAL' WHEN chronic_absence_risk_score > 50 THEN 'HIGH' WHEN chronic_absence_risk_score > 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN chronic_absence_flag THEN 'CRITICAL: Schedule immediate parent conference and intervention plan' WHEN chronic_absence_risk_score > 50 THEN 'HIGH: Monitor closely, trending towards chronic absence'
    WHEN chronic_absence_risk_score > 30 THEN 'MEDIUM: Preventive outreach recommended' ELSE 'LOW: On track' END AS recommended_action FROM scored"""
)
def score_chronic_absence_risk(spark, sf_dir):
    return attendance.score_chronic_absence(_absence_features(spark, sf_dir))


@query(
    f"""WITH {DAILY}, {INCIDENTS}, {STUDENTS}, {WINDOWS_SQL}, base AS (
  SELECT d.student_key, coalesce(a.attendance_rate, 100)::DOUBLE AS attendance_rate_30d, coalesce(a.unexcused_absence_rate, 0)::DOUBLE AS unexcused_absence_rate_30d,
    coalesce(a.discipline_incidents_in_window, 0)::BIGINT AS discipline_incidents_30d, coalesce(a.absence_discipline_correlation_score, 0)::DOUBLE AS absence_discipline_correlation_score,
    coalesce(q.attendance_rate, 100)::DOUBLE AS attendance_rate_90d, coalesce(q.pattern_direction, 'stable') AS attendance_trend_90d,
    (CASE WHEN 100.0::DOUBLE - coalesce(a.attendance_rate, 100)::DOUBLE >= 10.0 THEN 1 ELSE 0 END)::BIGINT AS chronic_absence_flag
  FROM students d LEFT JOIN windows a ON d.student_key = a.student_key AND a.window_type = '7d' LEFT JOIN windows q ON d.student_key = q.student_key AND q.window_type = '21d'),
 scored AS (SELECT *, {r("least(greatest((100.0::DOUBLE - attendance_rate_30d) * 0.4::DOUBLE + least(unexcused_absence_rate_30d / 15.0::DOUBLE * 100::DOUBLE, 100.0::DOUBLE) * 0.2::DOUBLE + least(discipline_incidents_30d * 5.0::DOUBLE, 100.0::DOUBLE) * 0.2::DOUBLE + (CASE WHEN attendance_trend_90d = 'declining' THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.1::DOUBLE + least(absence_discipline_correlation_score * 10::DOUBLE, 100.0::DOUBLE) * 0.1::DOUBLE, 0.0::DOUBLE), 100.0::DOUBLE)", 1)} AS chronic_absenteeism_risk_score FROM base)
SELECT *, CASE WHEN chronic_absenteeism_risk_score > 70 THEN 'Critical' WHEN chronic_absenteeism_risk_score > 50 THEN 'High' WHEN chronic_absenteeism_risk_score > 30 THEN 'Medium' ELSE 'Low' END AS risk_level FROM scored"""
)
def chronic_absenteeism_risk(spark, sf_dir):
    return attendance.chronic_absenteeism_risk(students(spark, sf_dir).select("student_key"), _windows(spark, sf_dir), short="7d", long="21d")


def _gpa(spark, sf_dir):
    return grades(spark, sf_dir).groupBy("student_key").agg(E.rnd(E.mean_tenths("points"), 2).alias("avg_gpa"))


GPA_SQL = f"gpa AS (SELECT student_key, {r(mean_tenths(), 2)} AS avg_gpa FROM grades GROUP BY 1)"


@query(
    f"""WITH {DAILY}, {INCIDENTS}, {STUDENTS}, {GRADES}, {GPA_SQL}, {WINDOWS_SQL}, {DISCIPLINE_SQL}, raw AS (
  SELECT d.student_key, least(100.0::DOUBLE - coalesce(attendance_rate, 100.0::DOUBLE), 100.0::DOUBLE) AS a, least(coalesce(incident_count, 0) * 10.0::DOUBLE, 100.0::DOUBLE) AS b, coalesce(avg_gpa, 2.0)::DOUBLE AS g
  FROM students d LEFT JOIN windows w ON d.student_key = w.student_key AND w.window_type = '7d' LEFT JOIN discipline i ON d.student_key = i.student_key AND i.window_type = '7d' LEFT JOIN gpa ON gpa.student_key = d.student_key),
 domains AS (SELECT student_key, {r("a", 1)} AS attendance_risk_score, {r("b", 1)} AS discipline_risk_score,
    (CASE WHEN g < 1.5 THEN 100 WHEN g < 2.0 THEN 70 WHEN g < 2.5 THEN 40 ELSE 10 END)::DOUBLE AS academic_risk_score,
    ((CASE WHEN a > 50 THEN 1 ELSE 0 END) + (CASE WHEN b > 50 THEN 1 ELSE 0 END) + (CASE WHEN g < 2.0 THEN 1 ELSE 0 END))::BIGINT AS high_risk_domain_count FROM raw),
 scored AS (SELECT *, {r("((attendance_risk_score + discipline_risk_score + academic_risk_score) / 3.0::DOUBLE) * (1.0::DOUBLE + greatest(high_risk_domain_count - 1, 0) * 0.25::DOUBLE)", 1)} AS wellbeing_risk_score FROM domains)
SELECT *, CASE WHEN wellbeing_risk_score <= 30 THEN 'Low' WHEN wellbeing_risk_score <= 60 THEN 'Moderate' WHEN wellbeing_risk_score <= 80 THEN 'High' ELSE 'Critical' END AS wellbeing_risk_level,
  CASE WHEN high_risk_domain_count >= 2 THEN 'Multi-factor' WHEN attendance_risk_score > discipline_risk_score AND attendance_risk_score > academic_risk_score THEN 'Attendance'
    WHEN discipline_risk_score > academic_risk_score THEN 'Behavior' ELSE 'Academic' END AS primary_concern FROM scored"""
)
def wellbeing_risk_profiles(spark, sf_dir):
    windows = attendance.student_windows(daily(spark, sf_dir), incidents(spark, sf_dir), windows=WINDOWS[:1])
    return attendance.wellbeing_profiles(students(spark, sf_dir).select("student_key"), windows, _discipline(spark, sf_dir, WINDOWS[:1]), _gpa(spark, sf_dir), window="7d")


# Academics

_NEW, _OLD = (mean_tenths(f"CASE WHEN d {c} DATE '1999-06-01' - 15 THEN points END") for c in (">=", "<"))
ACADEMIC_SQL = f"""academic AS (SELECT s.student_key, s.school, s.grade, coalesce({r(mean_tenths(), 2)}, 0) AS avg_score, coalesce(min(points), 0) AS min_score, coalesce(max(points), 0) AS max_score,
  count(letter) AS total_records, CASE WHEN count(letter) > 0 THEN {r("100.0::DOUBLE * sum(CASE WHEN passing THEN 1 ELSE 0 END)::DOUBLE / count(letter)", 2)} ELSE 0 END AS passing_rate,
  {count_if("letter IN ('A+', 'A', 'A-', 'B+', 'B', 'B-')")} AS above_average_count, {count_if("letter IN ('C+', 'C', 'C-')")} AS average_count, {count_if("letter IN ('D+', 'D', 'D-', 'F', 'NP')")} AS below_average_count,
  CASE WHEN {_NEW} > {_OLD} THEN 'IMPROVING' WHEN {_NEW} < {_OLD} THEN 'DECLINING' ELSE 'STABLE' END AS grade_trend
  FROM students s LEFT JOIN grades USING (student_key) GROUP BY 1, 2, 3)"""


def _academic(spark, sf_dir):
    return academics.academic_features(students(spark, sf_dir).select("student_key", "school", "grade"), grades(spark, sf_dir), F.to_date(F.lit("1999-06-01")))


@query(f"WITH {STUDENTS}, {GRADES}, {ACADEMIC_SQL} SELECT * FROM academic")
def academic_features(spark, sf_dir):
    return _academic(spark, sf_dir)


@query(
    f"""WITH {STUDENTS}, {GRADES}, {ACADEMIC_SQL} SELECT student_key, avg_score, passing_rate, grade_trend,
  (CASE WHEN avg_score < 1.0 THEN 90 WHEN avg_score < 2.0 THEN 70 WHEN avg_score < 2.5 THEN 40 WHEN avg_score < 3.0 THEN 15 ELSE 5 END)::BIGINT AS academic_risk_score,
  CASE WHEN avg_score < 1.0 THEN 'CRITICAL' WHEN avg_score < 2.0 THEN 'HIGH' WHEN avg_score < 2.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  total_records, above_average_count, average_count, below_average_count,
  CASE WHEN avg_score < 1.0 AND grade_trend = 'DECLINING' THEN 'URGENT: Failing trajectory, academic intervention required' WHEN avg_score < 2.0 THEN 'HIGH: Consider tutoring or course support'
    WHEN avg_score < 2.5 AND grade_trend = 'DECLINING' THEN 'MEDIUM: Monitor progress, provide support if decline continues' WHEN grade_trend = 'IMPROVING' THEN 'POSITIVE: Student showing improvement' ELSE 'On track' END AS recommended_action
  FROM academic"""
)
def score_academic_risk(spark, sf_dir):
    return academics.score_academic(_academic(spark, sf_dir))


@query(f"""WITH {GRADES} SELECT course, term, count(*) AS grade_count, {r(mean_tenths(), 2)} AS avg_grade, {pct("points >= 2.0")} AS pct_passing FROM grades GROUP BY 1, 2""")
def academic_performance(spark, sf_dir):
    return academics.academic_performance(grades(spark, sf_dir), ["course", "term"])


def _sub(flag: str) -> str:
    return r(f"100.0::DOUBLE * sum(CASE WHEN {flag} AND points >= 2.0 THEN 1 ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN {flag} THEN 1 ELSE 0 END)::DOUBLE, 0)", 2)


CLASSES_SQL = f"""classes AS (SELECT course, school, term, count(DISTINCT grades.student_key) AS enrollment, {r(mean_tenths(), 2)} AS avg_grade,
  {pct("points >= 2.0")} AS pct_passed, {pct("points >= 3.3")} AS pct_a_b, {_sub("ell")} AS pct_passed_ell, {_sub("sped")} AS pct_passed_sped, {_sub("frl")} AS pct_passed_frl
  FROM grades LEFT JOIN students ON grades.student_key = students.student_key GROUP BY 1, 2, 3)"""


def _classes(spark, sf_dir):
    return academics.class_effectiveness(grades(spark, sf_dir), students(spark, sf_dir), ["course", "school", "term"])


@query(f"WITH {STUDENTS}, {GRADES}, {CLASSES_SQL} SELECT * FROM classes")
def class_effectiveness(spark, sf_dir):
    return _classes(spark, sf_dir)


_MEAN = "(sum(round(avg_grade * 100)::BIGINT) OVER (PARTITION BY course, term)::DOUBLE / (100 * count(avg_grade) OVER (PARTITION BY course, term))::DOUBLE)"


@query(
    f"""WITH {STUDENTS}, {GRADES}, {CLASSES_SQL}
SELECT * REPLACE (coalesce(pct_passed_ell, 0) AS pct_passed_ell, coalesce(pct_passed_sped, 0) AS pct_passed_sped, coalesce(pct_passed_frl, 0) AS pct_passed_frl),
  {r(_MEAN, 2)} AS course_avg_grade, {r(f"avg_grade - {_MEAN}", 2)} AS grade_diff_from_course_avg,
  rank() OVER (PARTITION BY course, term ORDER BY pct_passed DESC NULLS LAST)::BIGINT AS pass_rate_rank, rank() OVER (PARTITION BY course, term ORDER BY avg_grade DESC NULLS LAST)::BIGINT AS grade_rank,
  CASE WHEN pct_passed >= 90 AND avg_grade >= 3.3 THEN 'Highly Effective' WHEN pct_passed >= 80 AND avg_grade >= 3.0 THEN 'Effective'
    WHEN pct_passed >= 70 AND avg_grade >= 2.5 THEN 'Adequate' ELSE 'Needs Improvement' END AS effectiveness_rating
FROM classes WHERE term = (SELECT max(term) FROM classes)"""
)
def class_section_comparison(spark, sf_dir):
    # every order has lines, so the latest term is that of the orders; only its grades are then grouped
    latest = t(spark, sf_dir, "orders").agg(F.year(F.max("o_orderdate")).cast("long").alias("term"))
    rows = grades(spark, sf_dir).join(F.broadcast(latest), "term")  # one row
    classes = academics.class_effectiveness(rows, students(spark, sf_dir), ["course", "school", "term"])
    return academics.section_comparison(classes)


_STRENGTH_SQL = "CASE WHEN abs(coalesce(correlation_coefficient, 0)) >= 0.7 THEN 'Strong' WHEN abs(coalesce(correlation_coefficient, 0)) >= 0.4 THEN 'Moderate' WHEN abs(coalesce(correlation_coefficient, 0)) >= 0.1 THEN 'Weak' ELSE 'Negligible' END AS strength"


@query(
    f"""WITH {DAILY}, {INCIDENTS}, {GRADES}, {WINDOWS_SQL}, {DISCIPLINE_SQL},
 performance AS (SELECT student_key, {r(mean_tenths(), 2)} AS grade_numeric FROM grades GROUP BY 1),
 pairs AS (SELECT '{academics.ATTENDANCE_GPA}' AS correlation_pair, coalesce({r("corr(attendance_rate, coalesce(grade_numeric, 0))", 3)}, 0) AS correlation_coefficient, 'Positive' AS expected_direction, count(*) AS data_points
   FROM windows a JOIN performance p ON a.student_key = p.student_key WHERE a.window_type = 'term'
  UNION ALL SELECT '{academics.DISCIPLINE_GRADES}', {r("corr(incident_count, coalesce(grade_numeric, 0))", 3)}, 'Negative', count(*) FROM discipline d JOIN performance p ON d.student_key = p.student_key WHERE d.window_type = 'term'
  UNION ALL SELECT '{academics.ATTENDANCE_ENGAGEMENT}', {r("corr(attendance_rate, 100.0::DOUBLE - coalesce(incident_count, 0) * 10)", 3)}, 'Positive', count(*)
   FROM windows a LEFT JOIN discipline d ON a.student_key = d.student_key AND a.window_type = d.window_type WHERE a.window_type = 'term')
SELECT *, {_STRENGTH_SQL} FROM pairs"""
)
def performance_correlations(spark, sf_dir):
    # the term alone is asked for
    windows = attendance.attendance_windows(daily(spark, sf_dir), incidents(spark, sf_dir), windows=WINDOWS[-1:])
    performance = grades(spark, sf_dir).groupBy("student_key").agg(E.rnd(E.mean_tenths("points"), 2).alias("grade_numeric"))
    return academics.performance_correlations(windows, _discipline(spark, sf_dir, ()), performance)


@query(
    f"""WITH {GRADES}, x AS (SELECT course, letter, count(*) AS n FROM grades GROUP BY 1, 2)
SELECT course, letter, n, {r("100.0::DOUBLE * n / sum(n) OVER (PARTITION BY course)", 2)} AS pct FROM x"""
)
def outcome_distribution(spark, sf_dir):
    return academics.outcome_distribution(grades(spark, sf_dir), ["course"])


@query(
    f"""WITH {GRADES}, a AS (SELECT DISTINCT student_key, term FROM grades WHERE course = 7), b AS (SELECT DISTINCT student_key, term FROM grades WHERE course = 8)
SELECT a.term AS cohort, count(*) AS students, count(b.term) AS continued, {r("100.0::DOUBLE * count(b.term) / count(*)", 2)} AS pct_continued
FROM a LEFT JOIN b ON a.student_key = b.student_key AND b.term = a.term + 1 GROUP BY 1"""
)
def cohort_tracking(spark, sf_dir):
    return academics.cohort_tracking(grades(spark, sf_dir), "term", F.col("course") == 7, F.col("course") == 8)


@query(
    f"""WITH {GRADES} SELECT 'course_7' AS cohort, term, count(DISTINCT student_key) AS students FROM grades WHERE course = 7 GROUP BY 2
UNION ALL SELECT 'course_8', term, count(DISTINCT student_key) FROM grades WHERE course = 8 GROUP BY 2"""
)
def math_pathways(spark, sf_dir):
    one = lambda c: schools.enrollment_by_year(grades(spark, sf_dir), ["term"], F.col("course") == c).select(F.lit(f"course_{c}").alias("cohort"), "term", "students")
    return one(7).unionByName(one(8))


@query(f"WITH {STUDENTS}, {GRADES} SELECT term, ethnicity, count(DISTINCT grades.student_key) AS students FROM grades JOIN students USING (student_key) WHERE course = 8 GROUP BY 1, 2")
def enrollment_by_year(spark, sf_dir):
    rows = grades(spark, sf_dir).join(students(spark, sf_dir), "student_key")
    return schools.enrollment_by_year(rows, ["term", "ethnicity"], F.col("course") == 8)


# Schools and subgroups


@query(
    f"""WITH {STUDENTS} SELECT ethnicity, school, frl, count(DISTINCT student_key) AS students, {r("avg(age)", 2)} AS avg_age, min(age) AS min_age, max(age) AS max_age,
  {pct("active")} AS active_rate FROM students GROUP BY 1, 2, 3 HAVING count(DISTINCT student_key) >= 5"""
)
def student_demographics(spark, sf_dir):
    return schools.demographics(students(spark, sf_dir), ["ethnicity", "school", "frl"])


@query(f"WITH {STUDENTS} SELECT ethnicity, school, grade, count(*) AS group_size, 5 - count(*) AS deficit FROM students GROUP BY 1, 2, 3 HAVING count(*) < 5")
def k_anonymity_violations(spark, sf_dir):
    return schools.k_anonymity_violations(students(spark, sf_dir), ["ethnicity", "school", "grade"])


OUTCOMES_SQL = f"""outcomes AS (SELECT s.*, a.attendance_rate, a.days_absent, i.incidents, i.suspensions, g.avg_gpa FROM students s
  LEFT JOIN (SELECT student_key, {r("100.0::DOUBLE * sum(CASE WHEN absent THEN 0 ELSE 1 END)::DOUBLE / count(*)", 2)} AS attendance_rate, {count_if("absent")} AS days_absent FROM daily GROUP BY 1) a USING (student_key)
  LEFT JOIN (SELECT student_key, count(*) AS incidents, {count_if("serious")} AS suspensions FROM incidents GROUP BY 1) i USING (student_key) LEFT JOIN gpa g USING (student_key))"""


def _wide(spark, sf_dir):
    events = schools.student_events(daily(spark, sf_dir), incidents(spark, sf_dir))
    return schools.student_wide(students(spark, sf_dir), events, _gpa(spark, sf_dir))


PRE = f"WITH {DAILY}, {INCIDENTS}, {STUDENTS}, {GRADES}, {GPA_SQL}, {OUTCOMES_SQL}"


@query(
    f"""{PRE} SELECT ethnicity, ell, sped, frl, count(*) AS cohort_size, {pct("attendance_rate > 90")} AS pct_good_attendance, {pct("coalesce(incidents, 0) = 0")} AS pct_no_discipline,
  {r("avg(avg_gpa)", 2)} AS avg_gpa, {pct("avg_gpa >= 2.5")} AS pct_gpa_2_5, {pct("avg_gpa < 2.0")} AS pct_gpa_below_2 FROM outcomes GROUP BY 1, 2, 3, 4"""
)
def equity_outcomes(spark, sf_dir):
    return schools.equity_outcomes(_wide(spark, sf_dir), ["ethnicity", "ell", "sped", "frl"])


# days, incidents and suspensions of a student without any are 0 where the student has other events, else null but for incidents
WIDE_SQL = f"""{PRE}, wide AS (SELECT * REPLACE (coalesce(incidents, 0) AS incidents, CASE WHEN attendance_rate IS NOT NULL OR incidents IS NOT NULL THEN coalesce(days_absent, 0) END AS days_absent,
    CASE WHEN attendance_rate IS NOT NULL OR incidents IS NOT NULL THEN coalesce(suspensions, 0) END AS suspensions),
  CASE WHEN attendance_rate < 90 OR coalesce(incidents, 0) > 2 OR avg_gpa < 2 THEN 'High' WHEN attendance_rate < 95 OR coalesce(incidents, 0) > 0 OR avg_gpa < 2.5 THEN 'Moderate' ELSE 'Low' END AS risk_level,
  student_key % 11 = 0 AS multi, student_key % 25 = 0 AS homeless FROM outcomes)"""


def _wide_flagged(spark, sf_dir):
    key = F.col("student_key")
    return _wide(spark, sf_dir).withColumns({"multi": key % 11 == 0, "homeless": key % 25 == 0})


def _mean_sql(x: str, decimals: int, digits: int) -> str:
    return r(mean_sql(x, decimals), digits)


_OUTCOME_MEANS = f"{_mean_sql('attendance_rate', 2, 1)} AS avg_attendance_rate, {pct('attendance_rate >= 90', 1)} AS pct_good_attendance, {_mean_sql('incidents', 0, 2)} AS avg_discipline_incidents, {_mean_sql('avg_gpa', 2, 2)} AS avg_gpa"


@query(
    f"""{WIDE_SQL} SELECT ethnicity, multi, count(DISTINCT student_key) AS student_count, {count_if("sped")} AS special_ed_count, {count_if("frl")} AS frl_count, {count_if("ell")} AS ell_count, {count_if("homeless")} AS homeless_count,
  {_OUTCOME_MEANS}, {_mean_sql("days_absent", 0, 1)} AS avg_days_absent, {pct("incidents = 0", 1)} AS pct_no_discipline, {pct("suspensions > 0", 1)} AS pct_suspended, {pct("avg_gpa >= 2.5", 1)} AS pct_gpa_2_5_plus,
  {pct("avg_gpa < 2.0", 1)} AS pct_below_c, {pct("risk_level = 'High'", 1)} AS pct_high_risk, {pct("risk_level = 'Moderate'", 1)} AS pct_moderate_risk, {pct("risk_level = 'Low'", 1)} AS pct_low_risk FROM wide GROUP BY 1, 2"""
)
def equity_by_race(spark, sf_dir):
    return schools.equity_by_race(_wide_flagged(spark, sf_dir), ["ethnicity", "multi"])


SEGMENTS = {"building": "BUILDING", "automobile": "AUTOMOBILE", "machinery": "MACHINERY", "household": "HOUSEHOLD"}


@query(
    f"""{WIDE_SQL} SELECT school, count(DISTINCT student_key) AS student_count, {pct("sped", 1)} AS pct_special_ed, {pct("frl", 1)} AS pct_frl, {pct("ell", 1)} AS pct_ell,
  {", ".join(f"{pct(f"ethnicity = '{v}'", 1)} AS pct_{k}" for k, v in SEGMENTS.items())}, {pct("multi", 1)} AS pct_multi_racial, {_mean_sql("grade", 0, 1)} AS avg_grade_level, {_OUTCOME_MEANS},
  {pct("risk_level = 'High'", 1)} AS pct_high_risk FROM wide GROUP BY 1"""
)
def school_summary(spark, sf_dir):
    return schools.school_summary(_wide_flagged(spark, sf_dir), SEGMENTS)


@query(f"{WIDE_SQL} SELECT * EXCLUDE (multi, homeless) FROM wide")
def analytics_wide(spark, sf_dir):
    return _wide(spark, sf_dir)


def _fuzzy_sql(left: str, right: str, l: str, r_: str) -> str:
    """All pairs of distinct names, the nearest by distance and then key; the names' rows back again."""
    return f"""l AS ({left}), k AS ({right}), ln AS (SELECT DISTINCT upper(trim({l}_name)) AS a FROM l), kn AS (SELECT upper(trim({r_}_name)) AS b, min({r_}_id) AS id FROM k GROUP BY 1),
 c AS (SELECT a, id, b, levenshtein(a, b)::BIGINT AS distance FROM ln, kn WHERE abs(length(a) - length(b)) <= 5),
 n AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, id) AS n FROM c WHERE distance <= 5),
 matched AS (SELECT {l}_id, {l}_name, {r_}_id, {r_}_name, distance, {r("1.0::DOUBLE - distance::DOUBLE / greatest(length(a), length(b))", 4)} AS similarity
  FROM n JOIN l ON upper(trim({l}_name)) = a JOIN k ON {r_}_id = id WHERE n = 1)"""


#: Names as another system may hold them: with a letter more, less or changed, by the row's number.
_TYPOS = """CASE {k} % 6 WHEN 0 THEN {x} WHEN 1 THEN ' ' || lower({x}) WHEN 2 THEN substr({x}, 1, 3) || substr({x}, 5) WHEN 3 THEN substr({x}, 1, 4) || 'QQ' || substr({x}, 5)
  WHEN 4 THEN replace({x}, 'l', 'xyz') ELSE 'QQQ' || {x} || 'W' END"""


_SUPPLIERS = (
    f"SELECT s_suppkey AS left_id, {_TYPOS.format(k='s_suppkey', x='s_name')} AS left_name FROM supplier WHERE s_suppkey % 5 <> 0",
    "SELECT s_suppkey AS school_id, s_name AS school_name FROM supplier WHERE s_suppkey % 4 <> 3",
)
_PARTS = (
    f"SELECT p_partkey AS left_id, {_TYPOS.format(k='p_partkey', x='(p_name || p_brand)')} AS left_name FROM part",
    "SELECT p_partkey AS part_id, p_name || p_brand AS part_name FROM part WHERE p_partkey % 3 = 0",
)


def _fuzzy(spark, sf_dir, table: str, queries: tuple[str, str], key: str):
    rows = t(spark, sf_dir, table)
    left, right = (spark.sql(q.replace(f"FROM {table}", "FROM {rows}"), rows=rows) for q in queries)
    return matching.fuzzy_match(left, right, "left_id", "left_name", f"{key}_id", f"{key}_name")


@query(f"WITH {_fuzzy_sql(*_SUPPLIERS, 'left', 'school')} SELECT * FROM matched WHERE similarity >= 0.8")
def fuzzy_school_match(spark, sf_dir):
    return _fuzzy(spark, sf_dir, "supplier", _SUPPLIERS, "school")


@query(f"WITH {_fuzzy_sql(*_PARTS, 'left', 'part')} SELECT * FROM matched WHERE similarity >= 0.8")
def fuzzy_part_match(spark, sf_dir):
    return _fuzzy(spark, sf_dir, "part", _PARTS, "part")


@query(
    f"""WITH {_fuzzy_sql(*_SUPPLIERS, "left", "school")}, m AS (SELECT s_suppkey AS school, 'M' || s_suppkey AS code, 'manual' AS match_method FROM supplier WHERE s_suppkey % 9 = 0),
 f AS (SELECT left_id AS school, 'S' || school_id AS code, 'fuzzy' AS match_method FROM matched WHERE similarity >= 0.8 AND NOT EXISTS (SELECT 1 FROM m WHERE m.school = left_id)), known AS (SELECT * FROM m UNION ALL SELECT * FROM f)
SELECT * FROM known UNION ALL SELECT s_suppkey, NULL, 'unmapped' FROM supplier WHERE s_suppkey NOT IN (SELECT school FROM known)"""
)
def school_mapping(spark, sf_dir):
    keys = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("school"))
    manual = keys.where("school % 9 = 0").select("school", F.concat(F.lit("M"), F.col("school").cast("string")).alias("code"))
    close = _fuzzy(spark, sf_dir, "supplier", _SUPPLIERS, "school").select(F.col("left_id").alias("school"), F.concat(F.lit("S"), F.col("school_id").cast("string")).alias("code"))
    return schools.mapping_union(keys, manual, close, "school", "code")


@query(
    f"""WITH {STUDENTS}, own AS (SELECT school, count(DISTINCT student_key) AS own_count, {pct("frl")} AS own_rate FROM students GROUP BY 1),
 st AS (SELECT s_nationkey::BIGINT AS school, count(*) AS state_count, {pct("s_acctbal < 0")} AS state_rate FROM supplier WHERE s_nationkey <> 3 GROUP BY 1),
 x AS (SELECT own.school, own_count, own_rate, state_count, state_rate, {r("own_rate - state_rate", 2)} AS chronic_absent_rate_gap_pct,
  CASE WHEN own_rate < state_rate THEN 'Better than State' WHEN own_rate > state_rate THEN 'Worse than State' ELSE 'Same as State' END AS chronic_absence_comparison,
  own_count IS NULL AS missing_internal_data, state_count IS NULL AS missing_cde_data, abs(coalesce(own_count, 0) - coalesce(state_count, 0))::BIGINT AS enrollment_difference,
  abs(coalesce(own_count, 0) - coalesce(state_count, 0)) > 50 AS large_enrollment_discrepancy FROM own LEFT JOIN st USING (school))
SELECT *, CASE WHEN missing_internal_data OR missing_cde_data THEN 'Incomplete Data' WHEN large_enrollment_discrepancy THEN 'Data Quality Issue' WHEN chronic_absence_comparison = 'Worse than State' THEN 'Needs Improvement'
  WHEN chronic_absence_comparison = 'Better than State' THEN 'Outperforming State' ELSE 'On Par with State' END AS overall_status FROM x"""
)
def school_benchmarks(spark, sf_dir):
    own = students(spark, sf_dir).groupBy("school").agg(F.count_distinct("student_key").alias("own_count"), E.share(F.col("frl")).alias("own_rate"))
    state = t(spark, sf_dir, "supplier").where("s_nationkey <> 3").groupBy(F.col("s_nationkey").cast("long").alias("school"))  # one school without state data
    return schools.benchmarks(own, state.agg(F.count(F.lit(1)).alias("state_count"), E.share(F.col("s_acctbal") < 0).alias("state_rate")), "school")


@query(
    """WITH o AS (SELECT c_nationkey::BIGINT AS school, year(o_orderdate)::BIGINT AS y, o_orderstatus AS category, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
 l AS (SELECT s_nationkey::BIGINT AS school, year(l_shipdate)::BIGINT AS y, l_linestatus AS category, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
 g AS (SELECT school, y, category FROM o UNION SELECT school, y, category FROM l)
SELECT g.school, g.y, g.category, o.n AS orders_n, o.c AS orders_c, l.n AS lines_n, ((o.n IS NOT NULL)::INT + (l.n IS NOT NULL)::INT)::BIGINT AS domains_present,
  o.n IS NOT NULL AS has_orders, l.n IS NOT NULL AS has_lines FROM g LEFT JOIN o USING (school, y, category) LEFT JOIN l USING (school, y, category)"""
)
def accountability(spark, sf_dir):
    o = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.groupBy(F.col("c_nationkey").cast("long").alias("school"), F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderstatus").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("c")
    )
    li = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    li = li.groupBy(F.col("s_nationkey").cast("long").alias("school"), F.year("l_shipdate").cast("long").alias("y"), F.col("l_linestatus").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return schools.accountability({"orders": o, "lines": li}, ["school", "y", "category"], {"orders": ["n", "c"], "lines": ["n"]})


@query(
    f"""WITH {STUDENTS}, x AS (SELECT ethnicity, count(*) AS n, sum(frl::INT) AS h FROM students GROUP BY 1)
SELECT ethnicity, n, {r("h::DOUBLE / n * 100", 2)} AS rate, {r("(h::DOUBLE / n) / nullif(sum(h) OVER ()::DOUBLE / sum(n) OVER ()::DOUBLE, 0)", 4)} AS disparity_index FROM x"""
)
def contract_disparity_index(spark, sf_dir):
    return schools.disparity(students(spark, sf_dir), "ethnicity", F.col("frl"))


# Expressions


@query(
    f"""SELECT c_custkey, sha256(coalesce(c_custkey::VARCHAR, '') || '{SALT}') AS id_hash, c_name[1] || repeat('*', length(c_name) - 1) AS name_masked,
  lower(c_name)[1:2] || repeat('*', length(c_name) - 2) || '@' || 'ma' || repeat('*', 6) AS email_masked,
  ('555-' || lpad(c_custkey::VARCHAR, 7, '0'))[1:6] || '****' AS phone_masked, '***REDACTED***' AS address_masked, md5(c_custkey::VARCHAR || '-' || c_mktsegment) AS row_key FROM customer"""
)
def privacy_masks(spark, sf_dir):
    email = F.concat(F.lower("c_name"), F.lit("@mail.org"))
    phone = F.concat(F.lit("555-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    return t(spark, sf_dir, "customer").select(
        "c_custkey",
        E.hash_pii("c_custkey", SALT).alias("id_hash"),
        E.mask_name("c_name").alias("name_masked"),
        E.mask_email(email).alias("email_masked"),
        E.mask_phone(phone).alias("phone_masked"),
        E.mask_address("c_name").alias("address_masked"),
        E.surrogate_key("c_custkey", "c_mktsegment").alias("row_key"),
    )


@query(
    f"""WITH x AS (SELECT c_custkey, (list_extract({list(E.REPORTING_LABELS)!r}, (c_custkey % 28 + 1)::INT)) AS code, (list_extract({list(E.GROUP_LABELS)!r}, (c_custkey % 20 + 1)::INT)) AS grp,
  (c_custkey % 7)::VARCHAR AS lvl, c_nationkey % 5 AS county FROM customer)
SELECT c_custkey, {case("code", E.REPORTING_LABELS, "code")} AS category_label, {case("grp", E.GROUP_LABELS, "grp")} AS group_label,
  {case("lvl", E.COLORS, "'No Performance Color'")} AS color, {case("lvl", E.STATUS_LEVELS, "'No Data'")} AS status_level, {case("lvl", E.CHANGE_LEVELS, "'No Data'")} AS change_level,
  code LIKE 'R%' AS is_race_ethnicity, code IN ('GM', 'GF', 'GX', 'GZ') AS is_gender, code IN ('SE', 'SD', 'SS', 'SM', 'SF', 'SH') AS is_program, code LIKE 'GR%' AS is_grade_span,
  CASE WHEN grp = 'ALL' THEN 'all' WHEN grp IN ('AA', 'AI', 'AS', 'FI', 'HI', 'MR', 'PI', 'WH') THEN 'race_ethnicity' WHEN grp IN ('EL', 'LTEL', 'SED', 'SWD', 'HOM', 'FOS') THEN 'program' ELSE 'ela_additional' END AS group_type,
  lpad(county::VARCHAR, 2, '0') || lpad(county::VARCHAR, 5, '0') || lpad(c_custkey::VARCHAR, 7, '0') AS cds_code FROM x"""
)
def code_labels(spark, sf_dir):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % n + 1).cast("int"))
    rows = t(spark, sf_dir, "customer").select(
        "c_custkey", pick(E.REPORTING_LABELS, 28).alias("code"), pick(E.GROUP_LABELS, 20).alias("grp"), (F.col("c_custkey") % 7).cast("string").alias("lvl"), (F.col("c_nationkey") % 5).alias("county")
    )
    return rows.select(
        "c_custkey",
        E.label("code", E.REPORTING_LABELS).alias("category_label"),
        E.label("grp", E.GROUP_LABELS).alias("group_label"),
        E.label("lvl", E.COLORS, "No Performance Color").alias("color"),
        E.label("lvl", E.STATUS_LEVELS, "No Data").alias("status_level"),
        E.label("lvl", E.CHANGE_LEVELS, "No Data").alias("change_level"),
        *[c.alias(n) for n, c in E.category_flags("code").items()],
        E.group_type("grp").alias("group_type"),
        E.cds_code("county", "county", "c_custkey").alias("cds_code"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_quantity::INT % 7 = 0 OR l_linenumber = 7 AS is_suppressed,
  (l_quantity::INT % 7 <> 0 AND l_quantity < 11) AS is_small_n FROM lineitem"""
)
def suppression_flags(spark, sf_dir):
    q = F.when(F.col("l_quantity").cast("int") % 7 == 0, "*").otherwise(F.col("l_quantity").cast("int").cast("string"))
    n = F.when(F.col("l_linenumber") == 7, "*").otherwise("99")
    rows = t(spark, sf_dir, "lineitem").withColumns({"q": q, "n": n})
    return rows.select("l_orderkey", "l_linenumber", *[c.alias(k) for k, c in E.suppression_flags(["q", "n"]).items()])


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE floor(abs(c_acctbal) + 0.5) * sign(c_acctbal) END::BIGINT AS n,
  CASE WHEN c_custkey % 3 = 0 THEN '2023-24' ELSE '2022-23' END AS short_year,
  CASE WHEN c_custkey % 14 BETWEEN 1 AND 5 THEN 'Elementary' WHEN c_custkey % 14 BETWEEN 6 AND 8 THEN 'Middle' WHEN c_custkey % 14 BETWEEN 9 AND 12 THEN 'High' ELSE 'Unknown' END AS band FROM customer"""
)
def typed_casts(spark, sf_dir):
    text = F.when(F.col("c_custkey") % 4 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    year = F.when(F.col("c_custkey") % 3 == 0, "2023-2024").otherwise("2022-23")
    return t(spark, sf_dir, "customer").select("c_custkey", E.try_int(text).alias("n"), E.short_year(year).alias("short_year"), E.grade_band(F.col("c_custkey") % 14).alias("band"))


# Quality, batch and transforms


@query(
    """WITH x AS (SELECT count(*) AS n, sum((o_totalprice < 1000)::INT)::BIGINT AS a, sum((o_orderstatus = 'P')::INT)::BIGINT AS b FROM orders)
SELECT 'low_total' AS rule, n AS rows_checked, a AS violations, (floor(100.0::DOUBLE * a / n * 100.0 + 0.5) / 100.0)::DOUBLE AS pct FROM x
UNION ALL SELECT 'pending', n, b, (floor(100.0::DOUBLE * b / n * 100.0 + 0.5) / 100.0)::DOUBLE FROM x"""
)
def dq_scorecard(spark, sf_dir):
    return quality.scorecard(t(spark, sf_dir, "orders"), {"low_total": F.col("o_totalprice") < 1000, "pending": F.col("o_orderstatus") == "P"})


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique_combination(spark, sf_dir):
    return quality.unique_combination(t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY 1")
def dq_accepted_values(spark, sf_dir):
    return quality.accepted_values(t(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def dq_relationships(spark, sf_dir):
    return quality.relationships(t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", t(spark, sf_dir, "orders"), "o_custkey")


@query(
    """SELECT 'o_orderstatus' AS "column", count(*) AS rows, 0::BIGINT AS nulls, 0.0::DOUBLE AS null_pct, count(DISTINCT o_orderstatus) AS distinct_values, min(o_orderstatus) AS least, max(o_orderstatus) AS greatest, 'OK' AS severity FROM orders
UNION ALL SELECT 'o_custkey', count(*), 0, 0.0, count(DISTINCT o_custkey), min(o_custkey)::VARCHAR, max(o_custkey)::VARCHAR, 'OK' FROM orders"""
)
def profile_columns(spark, sf_dir):
    return quality.profile(t(spark, sf_dir, "orders"), ["o_orderstatus", "o_custkey"])


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def top_value_distribution(spark, sf_dir):
    return quality.top_values(t(spark, sf_dir, "lineitem"), "l_partkey")


@query(
    f"""WITH x AS (SELECT year(o_orderdate)::BIGINT AS y, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT {r("avg(n)", 4)} AS mean_count FROM x)
SELECT y, n, mean_count, abs(n - mean_count) > 0.5::DOUBLE * mean_count AS is_anomaly FROM x, m"""
)
def row_count_anomaly(spark, sf_dir):
    return quality.row_count_anomaly(t(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n")))


@query(
    """WITH x AS (SELECT 'orders' AS table_name, max(o_orderdate)::DATE AS latest FROM orders UNION ALL SELECT 'events', max(ts)::DATE FROM events)
SELECT table_name, latest::VARCHAR AS latest, (DATE '2024-02-15' - latest)::BIGINT AS days_since, CASE WHEN DATE '2024-02-15' - latest > 30 THEN 'STALE' ELSE 'FRESH' END AS status FROM x"""
)
def freshness_alert(spark, sf_dir):
    tables = {"orders": (t(spark, sf_dir, "orders"), "o_orderdate"), "events": (t(spark, sf_dir, "events"), "ts")}
    return quality.freshness(tables, F.to_date(F.lit("2024-02-15")), 30)


@query(
    """WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events), x AS (SELECT user_id, day, lead(day) OVER (PARTITION BY user_id ORDER BY day) AS next FROM d)
SELECT user_id, day::VARCHAR AS day, next::VARCHAR AS next_date, (next - day)::BIGINT AS gap_days FROM x WHERE next - day > 3"""
)
def gap_detect(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"))
    out = quality.gaps(rows, ["user_id"], "day", 3)
    return out.withColumns({"day": F.col("day").cast("string"), "next_date": F.col("next_date").cast("string")})


@query(
    """SELECT c_custkey, c_mktsegment, c_acctbal + 0.0 AS c_acctbal FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 'UPDATED', c_acctbal + 1.0 FROM customer WHERE c_custkey % 3 = 0"""
)
def batch_delta_merge(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") + 0.0).alias("c_acctbal"))
    incoming = rows.where("c_custkey % 3 = 0").select("c_custkey", F.lit("UPDATED").alias("c_mktsegment"), (F.col("c_acctbal") + 1.0).alias("c_acctbal"))
    return batch.process(rows, incoming, "delta", ["c_custkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def deduplicate_keep_last(spark, sf_dir):
    rows = batch.deduplicate(t(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, (c_acctbal - lo) / (hi - lo) * 1.0::DOUBLE + 0.0::DOUBLE AS c_acctbal FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def normalize_numeric(spark, sf_dir):
    return transform.normalize_numeric(t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])


@query(
    """WITH x AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)
SELECT event_id, user_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS v FROM x"""
)
def forward_fill(spark, sf_dir):
    rows = t(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("v"))
    return transform.forward_fill(rows, ["user_id"], ["ts", "event_id"], ["v"]).select("event_id", "user_id", "v")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def flatten_json(spark, sf_dir):
    return transform.flatten_json(t(spark, sf_dir, "events").select("event_id", "props"), "props", "k bigint")


@query(
    f"""SELECT user_id, year(ts)::VARCHAR || '-W' || lpad(strftime(ts, '%U')::INT::VARCHAR, 2, '0') AS period, count(*) AS interactions, {r("avg(value)", 4)} AS avg_duration FROM events GROUP BY 1, 2"""
)
def engagement_by_week(spark, sf_dir):
    return transform.engagement(t(spark, sf_dir, "events"), "week", "user_id", "ts", "value")


@query(
    f"""WITH x AS (SELECT user_id, count(DISTINCT ts::DATE) AS total_days, {count_if("event_type <> 'error'")} AS present_days FROM events GROUP BY 1)
SELECT user_id, total_days, present_days, {r("present_days::DOUBLE / total_days", 3)} AS attendance_rate, {r("present_days::DOUBLE / total_days", 3)} < 0.9::DOUBLE AS is_chronic FROM x"""
)
def attendance_rate_utility(spark, sf_dir):
    rows = t(spark, sf_dir, "events").withColumn("d", F.to_date("ts"))
    return transform.attendance_rate(rows, "user_id", "d", F.col("event_type") != "error")


@query(
    f"""WITH {GRADES}, x AS (SELECT student_key, count(DISTINCT course) AS courses, {count_if("passing")} AS completed, {count_if("NOT passing")} AS in_progress FROM grades GROUP BY 1)
SELECT *, {r("completed::DOUBLE / courses", 3)} AS completion_rate FROM x"""
)
def course_completion(spark, sf_dir):
    return transform.course_completion(grades(spark, sf_dir), "student_key", "course", F.col("passing"))


@query(f"SELECT sha256(c_custkey::VARCHAR || '{SALT}')[1:16] AS c_id, repeat('*', length(c_name)) AS c_name, c_mktsegment FROM customer")
def pseudonymize_rules(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c_id"), "c_name", "c_mktsegment")
    return transform.pseudonymize(rows, SALT)


# Metrics and access


def _view(spark, sf_dir) -> metrics.MetricsView:
    rows = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return metrics.MetricsView(
        rows,
        {"segment": F.col("c_mktsegment"), "order_year": F.year("o_orderdate").cast("long"), "status": F.col("o_orderstatus")},
        {"orders_n": F.count(F.lit(1)), "customers_n": F.count_distinct("o_custkey"), "avg_price": E.rnd(F.avg("o_totalprice"), 2), "open_n": F.count_if(F.col("o_orderstatus") == "O")},
    )


@query(
    f"""SELECT c_mktsegment AS segment, year(o_orderdate)::BIGINT AS order_year, count(*) AS orders_n, count(DISTINCT o_custkey) AS customers_n, {r("avg(o_totalprice)", 2)} AS avg_price,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS open_n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""
)
def metrics_query(spark, sf_dir):
    return _view(spark, sf_dir).query(["segment", "order_year"], ["orders_n", "customers_n", "avg_price", "open_n"])


@query(
    """SELECT c_mktsegment AS segment, nullif(count(*) FILTER (WHERE year(o_orderdate) = 1996), 0) AS orders_n_1996, nullif(count(*) FILTER (WHERE year(o_orderdate) = 1997), 0) AS orders_n_1997
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"""
)
def metrics_comparison(spark, sf_dir):
    return _view(spark, sf_dir).compare("segment", "order_year", [1996, 1997], "orders_n")


@query("SELECT c_custkey, c_nationkey::BIGINT AS school_id FROM customer WHERE c_nationkey IN (3, 4)")
def rls_filter(spark, sf_dir):
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("school_id"))
    return access.secured(rows, access.User("principal", (3, 4)))


@query(
    f"""WITH {DAILY}, {INCIDENTS}, {STUDENTS}, {WINDOWS_SQL} SELECT floor(attendance_rate / 10 + 0.5)::BIGINT * 10 AS rate_bin, count(*) AS n FROM windows WHERE window_type = 'term' GROUP BY 1"""
)
def contract_risk_distribution(spark, sf_dir):
    rows = attendance.attendance_windows(daily(spark, sf_dir), incidents(spark, sf_dir), **SHORT).where("window_type = 'term'")
    return rows.groupBy((F.floor(F.col("attendance_rate") / 10 + 0.5) * 10).alias("rate_bin")).agg(F.count(F.lit(1)).alias("n"))


# Contract queries over the views above


def _chronic_view(spark, sf_dir):
    s = students(spark, sf_dir).select("student_key", "grade", "school")
    return attendance.chronic_absenteeism_risk(s, _windows(spark, sf_dir), short="7d", long="21d")


_VIEWS = {
    "chronic": (_chronic_view, f"SELECT x.*, c_custkey % 12 + 1 AS grade, c_nationkey::BIGINT AS school FROM ({SQL['chronic_absenteeism_risk']}) x JOIN customer ON c_custkey = student_key"),
    "wellbeing": (wellbeing_risk_profiles, SQL["wellbeing_risk_profiles"]),
    "equity": (equity_outcomes, SQL["equity_outcomes"]),
    "sections": (class_section_comparison, SQL["class_section_comparison"]),
    "correlations": (performance_correlations, SQL["performance_correlations"]),
}


def _contract(name: str) -> None:
    view, ask, sql = contracts.CONTRACTS[name]
    rows, text = _VIEWS[view]
    name = name if name.startswith("dash_") else f"cq_{name}"
    QUERIES[name] = lambda spark, sf_dir: ask(rows(spark, sf_dir))
    SQL[name] = f"WITH v AS ({text}) {sql}"


for _name in contracts.CONTRACTS:
    _contract(_name)
