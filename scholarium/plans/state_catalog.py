"""Registered queries over state files: accountability of schools, metrics views of the dashboard indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarium.functions import expr as E
from scholarium.operators import accountability as A
from scholarium.operators import state, transform
from scholarium.plans import dashboards
from scholarium.plans import state_surrogate as S
from scholarium.plans.catalog import QUERIES, SQL, case, query
from scholarium.plans.surrogate import DAILY, GRADES, STUDENTS, daily, grades, mean_sql, mean_tenths, r, students, t

_DOMAINS = list(A.SOURCES)
_GRAINS = [d for d in _DOMAINS if A.SOURCES[d].anchors]
_PRESENT = [f"({s.presence} IS NOT NULL)::BIGINT" for s in A.SOURCES.values()]
_ON = {3: "g.cds_code = {d}.cds_code AND g.academic_year = {d}.academic_year AND g.reporting_category = {d}.reporting_category", 2: "g.cds_code = {d}.cds_code AND g.academic_year = {d}.academic_year"}


@query(
    f"""WITH {S.BASE}, {", ".join(S.domain_sql(d) for d in _DOMAINS)},
 school_dim AS (SELECT lpad((s_suppkey % 58)::VARCHAR, 2, '0') || lpad((s_suppkey % 1000)::VARCHAR, 5, '0') || lpad(s_suppkey::VARCHAR, 7, '0') AS cds_code, s_suppkey AS school_id, s_name AS school_name,
  'District ' || (s_suppkey % 1000) AS district_name, 'County ' || s_nationkey AS county_name, s_acctbal / 100 AS latitude, s_acctbal / -50 AS longitude FROM supplier WHERE s_suppkey % 3 <> 0),
 grain AS ({" UNION ".join(f"SELECT cds_code, academic_year, reporting_category FROM {d}" for d in _GRAINS)}),
 joined AS (SELECT g.*, school_id, school_name, district_name, county_name, latitude, longitude, {", ".join(n for s in A.SOURCES.values() for n in s.measures)}
  FROM grain g LEFT JOIN school_dim ON g.cds_code = school_dim.cds_code {" ".join(f"LEFT JOIN {d} ON {_ON[len(A.SOURCES[d].keys)].format(d=d)}" for d in _DOMAINS)})
SELECT *, {case("reporting_category", E.REPORTING_LABELS, "reporting_category")} AS reporting_category_label,
  CASE WHEN ca_chronic_absent_count IS NULL AND ca_eligible_enrollment IS NULL THEN false WHEN ca_eligible_enrollment IS NULL THEN true ELSE false END AS is_suppressed,
  {" + ".join(_PRESENT)} AS data_domains_present, {" + ".join(_PRESENT)} > 0 AS has_cde_data,
  reporting_category LIKE 'R%' AS is_race_ethnicity_subgroup, reporting_category IN ('GF', 'GM', 'GX') AS is_gender_subgroup,
  reporting_category IN ('SE', 'EL', 'RFEP', 'IFEP', 'SWD', 'HOM', 'FOS', 'MIL') AS is_atrisk_subgroup, reporting_category LIKE 'GR%' AS is_grade_level_subgroup,
  'S' AS aggregate_level, 'School' AS aggregate_level_label FROM joined"""
)
def school_accountability(spark, sf_dir):
    return A.school_accountability(S.staged(spark, sf_dir), S.schools(spark, sf_dir))


# Metrics views, asked in SQL

_COLOR_SQL = ", ".join(f"sum(CASE WHEN performance_color = '{c}' THEN 1 ELSE 0 END)::BIGINT AS {c.lower()}_count" for c in dashboards.COLORS)


def _board(spark, sf_dir, name):
    return dashboards.dashboard_view(state.dashboard_export(S.raw_board(spark, sf_dir, name), name), name)


@query(
    f"""WITH {S.board_sql()} SELECT student_group, academic_year, avg(status_value) AS status_value, avg(prior_status_value) AS prior_status_value, avg(change_value) AS change_value, sum(curr_denominator)::BIGINT AS curr_denominator,
  sum(curr_numerator)::BIGINT AS curr_numerator, count(DISTINCT cds_code) AS school_count, {_COLOR_SQL} FROM board WHERE aggregate_level = 'School' AND is_charter GROUP BY 1, 2"""
)
def metrics_chronic_absenteeism(spark, sf_dir):
    return _board(spark, sf_dir, "chronic_absenteeism").sql(
        """SELECT student_group, academic_year, status_value, prior_status_value, change_value, curr_denominator, curr_numerator, school_count,
           red_count, orange_count, yellow_count, green_count, blue_count FROM metrics_view WHERE aggregate_level = 'School' AND is_charter"""
    )


@query(
    f"""WITH {S.board_sql()} SELECT district_name, status_level, avg(change_value) AS change, sum(curr_numerator)::BIGINT + sum(curr_denominator)::BIGINT AS students, sum(CASE WHEN performance_color = 'Red' THEN 1 ELSE 0 END)::BIGINT AS red_count
  FROM board WHERE student_group_type <> 'race_ethnicity' GROUP BY 1, 2 HAVING sum(CASE WHEN performance_color = 'Red' THEN 1 ELSE 0 END) > 1 AND avg(status_value) >= 20"""
)
def metrics_suspension(spark, sf_dir):
    return _board(spark, sf_dir, "suspension").sql(
        """SELECT district_name, status_level, change_value AS change, curr_numerator + curr_denominator AS students, red_count FROM metrics_view
           WHERE student_group_type <> 'race_ethnicity' AND red_count > 1 AND status_value >= 20"""
    )


@query(
    f"""WITH {S.board_sql()} SELECT county_name, avg(status_value) AS status_value, avg(status_value_without_prloss) AS status_value_without_prloss, avg(curr_participation_rate) AS curr_participation_rate, count(DISTINCT cds_code) AS school_count
  FROM board WHERE student_group IN ('All Students', 'English Learners') OR is_dass GROUP BY 1 ORDER BY school_count DESC, county_name LIMIT 20"""
)
def metrics_ela(spark, sf_dir):
    return _board(spark, sf_dir, "ela").sql(
        """SELECT county_name, status_value, status_value_without_prloss, curr_participation_rate, school_count FROM metrics_view
           WHERE student_group IN ('All Students', 'English Learners') OR is_dass ORDER BY school_count DESC, county_name LIMIT 20"""
    )


@query(
    f"""WITH {S.board_sql()} SELECT change_level, performance_color, sum(curr_progressed)::BIGINT AS curr_progressed, sum(curr_maintain_pl4)::BIGINT AS curr_maintain_pl4, sum(curr_declined)::BIGINT AS curr_declined,
  sum(curr_numerator)::DOUBLE / sum(curr_denominator)::DOUBLE AS per_taker FROM board GROUP BY 1, 2"""
)
def metrics_elpac(spark, sf_dir):
    return _board(spark, sf_dir, "elpac").sql("SELECT change_level, performance_color, curr_progressed, curr_maintain_pl4, curr_declined, curr_numerator / curr_denominator AS per_taker FROM metrics_view GROUP BY change_level, performance_color")


# A district in one row


@query(
    f"""WITH {STUDENTS}, {DAILY}, {GRADES}, s AS (SELECT *, CASE student_key % 10 WHEN 0 THEN 'Graduated' WHEN 1 THEN 'Withdrawn' ELSE 'Active' END AS status FROM students),
 gpa AS (SELECT student_key, {r(mean_tenths(), 2)} AS gpa FROM grades GROUP BY 1),
 a AS (SELECT student_key, {r("sum(CASE WHEN absent THEN 0 ELSE 1 END)::DOUBLE / count(*)", 4)} AS attendance_rate FROM daily GROUP BY 1)
SELECT (SELECT count(DISTINCT student_key) FROM s WHERE status = 'Active') AS active_students, (SELECT count(DISTINCT student_key) FROM s WHERE status = 'Graduated') AS graduated_students,
  (SELECT count(DISTINCT student_key) FROM s WHERE status = 'Withdrawn') AS withdrawn_students,
  (SELECT '{{' || string_agg('"' || grade || '":' || n, ',' ORDER BY grade) || '}}' FROM (SELECT grade, count(DISTINCT student_key) AS n FROM s GROUP BY 1)) AS students_by_grade,
  (SELECT count(DISTINCT student_key) FROM s WHERE sped) AS special_ed_count, (SELECT count(DISTINCT student_key) FROM s WHERE ell) AS english_learner_count, (SELECT count(DISTINCT student_key) FROM s WHERE frl) AS frpl_count,
  (SELECT {r(mean_sql("gpa", 2), 2)} FROM s JOIN gpa USING (student_key)) AS district_avg_gpa, (SELECT {r(mean_sql("attendance_rate", 4), 4)} FROM a) AS district_avg_attendance_rate,
  (SELECT count(DISTINCT student_key) FROM a WHERE attendance_rate < 0.7) AS chronically_absent_count, (SELECT count(DISTINCT course) FROM grades) AS total_courses, (SELECT count(DISTINCT o_orderkey) FROM orders) AS total_enrollments"""
)
def district_summary(spark, sf_dir):
    rows = grades(spark, sf_dir)
    gpa = rows.groupBy("student_key").agg(E.rnd(E.mean_tenths("points"), 2).alias("gpa"))
    status = F.when(F.col("student_key") % 10 == 0, "Graduated").when(F.col("student_key") % 10 == 1, "Withdrawn").otherwise("Active")
    people = students(spark, sf_dir).withColumn("status", status).join(gpa, "student_key", "left")
    days = daily(spark, sf_dir).groupBy("student_key").agg(E.rnd(E.ratio(F.sum(F.when(F.col("absent"), 0).otherwise(1)), F.count(F.lit(1))), 4).alias("attendance_rate"))
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("enrollment_id"))
    return transform.district_summary(people, days.withColumn("chronic", F.col("attendance_rate") < 0.7), rows, orders)


# Staging models


def _stage(name: str) -> None:
    QUERIES[f"stg_{name}"] = lambda spark, sf_dir: state.stage(S.raw_file(spark, sf_dir, name), name)
    SQL[f"stg_{name}"] = S.stage_sql(name)


for _name in state.DOMAINS:
    _stage(_name)
