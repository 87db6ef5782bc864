"""Registered district reports; each SQL joins the sides as the surveyed reports do."""

from __future__ import annotations

from scholarium.operators import district as D
from scholarium.plans.catalog import query
from scholarium.plans.surrogate import mean_sql, r, t

_LETTER = "CASE k % 13 WHEN 0 THEN 'A' WHEN 1 THEN 'A-' WHEN 2 THEN 'B+' WHEN 3 THEN 'B' WHEN 4 THEN 'B-' WHEN 5 THEN 'C+' WHEN 6 THEN 'C' WHEN 7 THEN 'C-' WHEN 8 THEN 'D+' WHEN 9 THEN 'D' WHEN 10 THEN 'D-' WHEN 11 THEN 'F' ELSE 'P' END"
#: The driver's tables as a district's; both engines run the same text, over the table named first.
TABLES = {
    "sr": (
        "customer",
        """SELECT c_custkey AS student_key, CASE WHEN c_custkey % 37 = 0 THEN NULL ELSE c_custkey % 12 + 1 END AS grade, c_custkey % 20 = 0 AS sped, c_custkey % 7 = 0 AS ell, c_acctbal < 0 AS frl,
           CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_custkey % 401 AS DOUBLE) / 100 END AS gpa, CASE c_custkey % 10 WHEN 0 THEN 'Graduated' WHEN 1 THEN 'Withdrawn' ELSE 'Active' END AS status FROM customer""",
    ),
    "er": (
        "orders",
        f"""SELECT k AS enrollment_id, o_custkey AS student_key, k % 1500 AS course_id, CAST(year(o_orderdate) AS BIGINT) AS term, {_LETTER} AS letter, CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(k % 1001 AS DOUBLE) / 10 END AS grade_percent,
           CAST(k % 401 AS DOUBLE) / 100 AS gpa_contribution, k % 9 = 0 AS flagged, CAST(k % 101 AS DOUBLE) / 100 AS completion, CAST(k % 997 AS DOUBLE) / 10 AS participation, k % 6 = 0 AS ap, k % 5 = 0 AS honors
           FROM (SELECT *, o_orderkey AS k FROM orders) x""",
    ),
    "ar": (
        "orders",
        """SELECT *, attendance_rate < 0.9 AS chronic, CASE WHEN attendance_rate < 0.5 THEN 'High Risk' ELSE 'None' END AS warning FROM (
           SELECT o_custkey AS student_key, CAST(year(o_orderdate) AS BIGINT) AS term, CASE WHEN min(o_orderkey) % 11 = 0 THEN NULL ELSE CAST(min(o_orderkey) % 10001 AS DOUBLE) / 10000 END AS attendance_rate
           FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey, year(o_orderdate)) x""",
    ),
    "cr": (
        "part",
        """SELECT p_partkey AS course_id, p_name AS course_name, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END AS department, p_brand AS subject, 1992 + p_partkey % 7 AS term, p_size AS capacity,
           p_size % 29 AS current_enrollment, CAST(p_partkey % 121 AS DOUBLE) AS capacity_percent FROM part""",
    ),
    "ac": (
        "lineitem",
        """SELECT l_suppkey AS student_key, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_partkey % 50 END AS competency_id, concat('C', CAST(l_partkey % 50 AS STRING)) AS competency_name, concat('S', CAST(l_partkey % 5 AS STRING)) AS standard_code,
           CASE l_linenumber % 5 WHEN 0 THEN 'Advanced' WHEN 1 THEN 'Proficient' WHEN 2 THEN 'Developing' WHEN 3 THEN 'Beginning' END AS mastery_level, CAST(l_orderkey % 1001 AS DOUBLE) / 10 AS score_percent,
           l_linenumber = 1 AS remediation, l_linenumber = 7 AS enrichment FROM lineitem""",
    ),
}


def _table(spark, sf_dir, name: str):
    source, text = TABLES[name]
    return spark.sql(text.replace(f"FROM {source}", "FROM {rows}"), rows=t(spark, sf_dir, source))


def _sql(names: str, select: str) -> str:
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n][1]})" for n in names.split()) + " " + select


def _register(name: str, names: str, report, select: str) -> None:
    def ask(spark, sf_dir):
        return report(*(_table(spark, sf_dir, n) for n in names.split()))

    ask.__name__ = name
    query(_sql(names, select))(ask)


def _part(flag: str, whole: str = "count(*)") -> str:
    return r(f"100.0::DOUBLE * count(CASE WHEN {flag} THEN 1 END)::DOUBLE / nullif({whole}::DOUBLE, 0)", 1)


def _mean(x: str, decimals: int, digits: int) -> str:
    return r(mean_sql(x, decimals), digits)


def _n(flag: str) -> str:
    return f"count(CASE WHEN {flag} THEN 1 END)"


_JOINED = "FROM sr LEFT JOIN er ON sr.student_key = er.student_key LEFT JOIN ar ON sr.student_key = ar.student_key"
_ACTIVE = "(SELECT count(DISTINCT student_key) FROM sr WHERE status = 'Active')"

_register(
    "grade_level_performance",
    "sr er ar",
    D.grade_level_performance,
    f"""SELECT grade, count(DISTINCT sr.student_key) AS student_count, {_part("sped")} AS percent_special_ed, {_part("ell")} AS percent_english_learner, {_mean("gpa", 2, 2)} AS avg_gpa, {r("max(gpa)", 2)} AS max_gpa, {r("min(gpa)", 2)} AS min_gpa,
  {_n(f"letter IN {D.HIGH}")} AS high_achiever_count, {_n(f"letter IN {D.LOW}")} AS struggling_count, {_part(f"letter IN {D.LOW}", "count(DISTINCT enrollment_id)")} AS failure_rate_percent, {_mean("attendance_rate", 4, 4)} AS avg_attendance_rate,
  {_n("chronic")} AS chronically_absent_count, {_part("warning = 'High Risk'", "count(DISTINCT ar.student_key)")} AS high_risk_attendance_percent {_JOINED} WHERE grade IS NOT NULL GROUP BY grade""",
)
_register(
    "special_programs_impact",
    "sr er ar",
    D.special_programs_impact,
    " UNION ALL ".join(
        f"SELECT '{name}' AS program, count(DISTINCT sr.student_key) AS participant_count, {_mean('gpa', 2, 2)} AS avg_gpa, {_mean('attendance_rate', 4, 4)} AS avg_attendance, {_n('frl')} AS frpl_participants, {_part('flagged')} AS intervention_flag_percent {_JOINED} WHERE {flag}"
        for name, flag in (("Special Education", "sped"), ("English Language Learner", "ell"), ("Free/Reduced Lunch Eligible", "frl"))
    ),
)
_register(
    "department_performance",
    "cr er",
    D.department_performance,
    f"""SELECT department, subject, count(DISTINCT cr.course_id) AS course_count, count(DISTINCT enrollment_id) AS total_enrollments, count(DISTINCT student_key) AS unique_students, {_mean("grade_percent", 1, 1)} AS avg_grade_percent,
  {", ".join(f"{_n(f'letter IN {letters}')} AS {o}" for o, letters in D.LETTERS.items())}, {_part("flagged")} AS intervention_flag_percent, {_mean("completion", 2, 2)} AS avg_assignment_completion_rate, {_mean("participation", 1, 1)} AS avg_participation_score
  FROM cr LEFT JOIN er ON cr.course_id = er.course_id WHERE department IS NOT NULL GROUP BY 1, 2""",
)
_register(
    "term_trends",
    "er cr ar",
    D.term_trends,
    f"""SELECT er.term, count(DISTINCT er.student_key) AS unique_students, count(DISTINCT enrollment_id) AS enrollment_count, count(DISTINCT cr.course_id) AS courses_offered, {_mean("grade_percent", 1, 1)} AS avg_grade_percent,
  {_mean("gpa_contribution", 2, 2)} AS avg_gpa_contribution, {_n(f"letter IN {D.LOW}")} AS failing_enrollments, {_mean("completion", 2, 3)} AS avg_assignment_completion_rate, {_mean("attendance_rate", 4, 4)} AS avg_attendance_rate,
  {_n("flagged")} AS intervention_flagged_enrollments, {_n("chronic")} AS chronically_absent_students
  FROM er LEFT JOIN cr ON er.course_id = cr.course_id LEFT JOIN ar ON er.student_key = ar.student_key AND er.term = ar.term WHERE er.term IS NOT NULL GROUP BY 1""",
)
_register(
    "at_risk_aggregates",
    "sr er ar",
    D.at_risk_aggregates,
    " UNION ALL ".join(
        f"SELECT '{c}' AS risk_category, count(DISTINCT student_key) AS affected_students, {r(f'100.0::DOUBLE * {n}::DOUBLE / nullif({_ACTIVE}::DOUBLE, 0)', 1)} AS percent_of_active, '{text}' AS risk_description FROM {table} WHERE {flag}"
        for c, table, flag, n, text in (
            ("Attendance", "ar", "chronic", "count(*)", "Chronically Absent (< 90% attendance)"),
            ("Academic", "er", "flagged", "count(*)", "Flagged for Intervention"),
            ("Academic", "sr", "gpa < 2.0", "count(DISTINCT student_key)", "GPA Below 2.0 (At Academic Risk)"),
            ("Demographic", "sr", "sped", "count(*)", "Special Education"),
            ("Demographic", "sr", "ell", "count(*)", "English Language Learner"),
        )
    ),
)
_register(
    "course_utilization",
    "cr er",
    D.course_utilization,
    f"""SELECT cr.course_id, course_name, department, cr.term, capacity, current_enrollment, capacity_percent, count(DISTINCT enrollment_id) AS actual_enrollment, count(DISTINCT student_key) AS unique_students, {_mean("grade_percent", 1, 1)} AS avg_grade_percent,
  {_n(f"letter IN {D.HIGH}")} AS high_achiever_count, {_n(f"letter IN {D.LOW}")} AS failing_count,
  CASE WHEN capacity_percent >= 100 THEN 'Over Capacity' WHEN capacity_percent >= 90 THEN 'High Demand' WHEN capacity_percent >= 70 THEN 'Good Enrollment' WHEN capacity_percent >= 50 THEN 'Moderate Enrollment' ELSE 'Low Enrollment' END AS demand_level
  FROM cr LEFT JOIN er ON cr.course_id = er.course_id GROUP BY 1, 2, 3, 4, 5, 6, 7""",
)
_register(
    "advanced_track_performance",
    "er",
    D.advanced_track_performance,
    " UNION ALL ".join(
        f"SELECT '{name}' AS track_type, count(DISTINCT student_key) AS student_count, count(DISTINCT enrollment_id) AS enrollment_count, {_mean('grade_percent', 1, 1)} AS avg_grade_percent, {_n(chr(39).join(['letter IN (', 'A', ', ', 'A-', ')']))} AS top_grade_count, {_mean('gpa_contribution', 2, 2)} AS avg_gpa_contribution FROM er WHERE {flag}"
        for name, flag in (("Advanced Placement", "ap"), ("Honors", "honors"), ("Regular Track", "NOT ap AND NOT honors"))
    ),
)
_register(
    "competency_mastery_trends",
    "ac",
    D.competency_mastery_trends,
    f"""SELECT competency_id, competency_name, standard_code, count(DISTINCT student_key) AS students_assessed, {", ".join(f"{_part(f'mastery_level = {chr(39)}{m}{chr(39)}')} AS {m.lower()}_percent" for m in D.MASTERY)},
  {_mean("score_percent", 1, 1)} AS avg_score_percent, {_n("remediation")} AS remediation_needed, {_n("enrichment")} AS enrichment_offered FROM ac WHERE competency_id IS NOT NULL GROUP BY 1, 2, 3""",
)
_register(
    "data_quality_summary",
    "sr er ar",
    D.data_quality_summary,
    f"""SELECT 'Complete Records' AS metric, count(*)::DOUBLE AS count, 'Students with complete enrollment, attendance, and grade data' AS description
  FROM sr JOIN er ON sr.student_key = er.student_key JOIN ar ON sr.student_key = ar.student_key WHERE gpa IS NOT NULL AND attendance_rate IS NOT NULL AND grade_percent IS NOT NULL
  UNION ALL SELECT 'Data Completeness Percentage', {r("100.0::DOUBLE * count(*)::DOUBLE / (SELECT count(*) FROM sr WHERE status = 'Active')::DOUBLE", 1)}, 'Percent of active students with complete data'
  FROM sr JOIN er ON sr.student_key = er.student_key WHERE gpa IS NOT NULL AND grade_percent IS NOT NULL""",
)
