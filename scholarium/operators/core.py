"""Core dimensions and facts: staged student records with keys hashed and flags derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.functions import expr as E

SEVERITIES = ("Low", "Medium", "High")
# Race codes, exact or by their first digit, and cohorts by grade.
RACES = {"700": "White", "700.0": "White", "600": "Hispanic/Latino", "600.0": "Hispanic/Latino", "100": "American Indian/Alaska Native", "100.0": "American Indian/Alaska Native", "400": "Native Hawaiian/Pacific Islander", "400.0": "Native Hawaiian/Pacific Islander", "0": "Not Specified", "0.0": "Not Specified"}
RACES_BY_DIGIT = {"2": "Asian", "3": "Black/African American"}
COHORTS = {9: "FRESHMAN", 10: "SOPHOMORE", 11: "JUNIOR", 12: "SENIOR"}


def _date(c: str) -> Column:
    """A date; null where the text is empty or no date."""
    return F.nullif(F.col(c).cast("string"), F.lit("")).try_cast("date")


def stage_students(raw: DataFrame, as_of: Column, year: str = "2024-2025") -> DataFrame:
    """Students as text, dates and flags; what the source lacks is null, typed."""
    text = lambda c, o=None: F.col(c).cast("string").alias(o or c)
    flag = lambda c, o: F.col(c).try_cast("boolean").alias(o)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    born = _date("date_of_birth")
    return raw.select(
        text("student_id", "student_id_raw"),
        text("first_name", "first_name_raw"),
        text("last_name", "last_name_raw"),
        born.alias("date_of_birth_raw"),
        text("gender"),
        text("ethnicity"),
        *none("string", *(f"race_code_{k}" for k in range(1, 6))),
        E.try_int("grade_level").cast("int").alias("grade_level"),
        text("school_id"),
        F.lit(year).alias("academic_year"),
        E.age_years(born, as_of).cast("int").alias("age"),
        E.grade_band(E.try_int("grade_level")).alias("grade_level_category"),
        *none("string", "attendance_program_code"),
        F.coalesce(F.col("ell_status").cast("string").isin("True", "true"), F.lit(False)).alias("ell_status"),
        flag("special_education", "special_education_flag"),
        flag("free_reduced_lunch", "free_reduced_lunch_flag"),
        flag("homeless", "homeless_flag"),
        flag("foster_care", "foster_care_flag"),
        flag("section_504", "section_504_flag"),
        F.lit(False).alias("gate_flag"),
        F.lit(False).alias("ell_program_flag"),
        F.coalesce(F.col("home_language").cast("string"), F.lit("E")).alias("home_language"),
        _date("enrollment_date").alias("enrollment_date"),
        *none("date", "withdrawal_date"),
        F.lit(True).alias("is_currently_enrolled"),
    )


# Points of whole letters in staging; the finer scale of performance is expr.GRADE_POINTS.
STAGED_POINTS = {"A": 4.0, "B": 3.0, "C": 2.0, "D": 1.0}


def stage_academic_records(raw: DataFrame) -> DataFrame:
    """Course records; letters other than A, B, C and D count 0 points and don't pass."""
    grade = F.col("grade").cast("string")
    texts = [F.col(c).cast("string").alias(o) for c, o in (("student_id", "student_id_raw"), ("school_id", "school_id"), ("course_id", "course_id"), ("section_id", "section_id"), ("teacher_id", "teacher_id"))]
    points = F.create_map(*(F.lit(x) for pair in STAGED_POINTS.items() for x in pair))
    return raw.select(
        *texts,
        grade.alias("grade"),
        E.try_double("score").alias("score"),
        F.col("term").cast("string").alias("term"),
        F.col("school_year").cast("string").alias("school_year"),
        F.col("record_id").cast("string").alias("academic_record_sk"),
        F.lit(1.0).alias("credit_earned"),
        F.coalesce(F.try_element_at(points, grade), F.lit(0.0)).alias("gpa_points"),
        F.coalesce(grade.isin(*STAGED_POINTS), F.lit(False)).alias("is_passing"),
    )


def stage_discipline(raw: DataFrame, year: str = "2024-2025") -> DataFrame:
    severity = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("Unknown")
    texts = [F.col(c).cast("string").alias(o) for c, o in (("student_id", "student_id_raw"), ("school_id", "school_id"), ("incident_id", "incident_id"), ("incident_type", "incident_type"), ("severity", "severity"), ("resolution", "resolution"))]
    return raw.select(*texts, _date("incident_date").alias("incident_date"), E.try_int("suspension_days").alias("suspension_days"), F.lit(year).alias("academic_year"), severity.alias("severity_category"))


def stage_enrollment(raw: DataFrame) -> DataFrame:
    texts = [F.col(c).cast("string").alias(o) for c, o in (("student_id", "student_id_raw"), ("school_id", "school_id"), ("school_year", "school_year"), ("enrollment_status", "enrollment_status"))]
    return raw.select(*texts, _date("enrollment_date").alias("enrollment_date"), F.lit(None).cast("date").alias("withdrawal_date"), E.try_int("grade_level").alias("grade_level"))


def stage_programs(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("student_id").cast("string").alias("student_id_raw"),
        F.col("program_code").cast("string").alias("program_code"),
        *(_date(c).alias(c) for c in ("participation_start_date", "participation_end_date")),
        F.col("participation_end_date").isNull().alias("is_currently_active"),
    )


def dim_students(hashed: DataFrame, as_of: Column) -> DataFrame:
    """Students with race, cohort, need and enrollment status derived; ``hashed`` holds pseudonymous rows."""
    race = F.col("race_code_1")
    named = E.label(race, RACES, E.label(F.substring(race, 1, 1), RACES_BY_DIGIT, "Other/Unknown"))
    cohorts = F.create_map(*(F.lit(x) for pair in COHORTS.items() for x in pair))
    left = F.col("withdrawal_date")
    status = F.when(F.col("enrollment_date").isNotNull() & left.isNull(), "ACTIVE").when(left <= as_of, "WITHDRAWN").otherwise("UNKNOWN")
    return hashed.withColumns(
        {
            "primary_race": F.when(race.isNull(), "Other/Unknown").otherwise(named),
            "is_multi_racial": F.coalesce(F.col("race_code_2") != "", F.lit(False)),
            "cohort": F.coalesce(F.try_element_at(cohorts, F.col("grade_level").cast("int")), F.lit("OTHER")),
            "high_need_flag": F.col("special_education_flag") | F.col("section_504_flag"),
            "language_support_needed": F.col("ell_status").cast("boolean"),
            "socioeconomic_risk": F.col("free_reduced_lunch_flag"),
            "housing_risk": F.col("homeless_flag"),
            "enrollment_status": status,
        }
    )


def dim_schools(students: DataFrame, attendance: DataFrame, mapping: DataFrame) -> DataFrame:
    """Schools that students or attendance name, with their state match if they have one."""
    ids = students.select("school_id").union(attendance.select("school_id")).distinct()
    named = ids.withColumn("school_name", F.concat(F.lit("SCHOOL_"), F.col("school_id").cast("string")))
    return named.join(mapping, "school_id", "left")


def fact_attendance(staged: DataFrame, salt: str) -> DataFrame:
    """Yearly attendance with the student's key hashed; all measures stay."""
    return staged.select(E.hash_pii("student_id_raw", salt).alias("student_id_hash"), *(c for c in staged.columns if c != "student_id_raw"))


def fact_attendance_daily(attendance: DataFrame, students: DataFrame, k: int = 5) -> DataFrame:
    """Attendance by year, school and grade; groups of fewer than ``k`` students are withheld."""
    rows = attendance.where("days_enrolled > 0").join(students.select("student_id_hash", "grade_level"), "student_id_hash")
    total = lambda c, o: F.sum(c).alias(o)
    grouped = rows.groupBy(F.col("academic_year").alias("school_year"), "school_id", "grade_level").agg(
        F.count_distinct("student_id_hash").alias("total_students"),
        *(total(f"days_{x}", f"{x}_count") for x in ("present", "absent", "tardy", "excused", "unexcused")),
        E.rnd(E.ratio(F.sum("days_present"), F.sum("days_enrolled")), 4).alias("attendance_rate"),
    )
    return grouped.where(F.col("total_students") >= k)


def fact_academic_records(staged: DataFrame, salt: str) -> DataFrame:
    key = E.surrogate_key("student_id_raw", "course_id", "section_id", "term", "school_year")
    kept = ("school_id", "course_id", "section_id", "term", "school_year", "grade", "credit_earned", "gpa_points", "is_passing")
    return staged.select(key.alias("academic_record_sk"), E.hash_pii("student_id_raw", salt).alias("student_id_hash"), E.hash_pii("teacher_id", salt).alias("teacher_id_hash"), *kept)


def fact_discipline(staged: DataFrame, salt: str) -> DataFrame:
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    return staged.select(
        E.hash_pii("student_id_raw", salt).alias("student_id_hash"),
        *("school_id", "incident_id", "academic_year", "incident_date"),
        F.col("severity_category").alias("severity"),
        "suspension_days",
        one(F.col("suspension_days") > 0).alias("suspension_flag"),
        one(F.col("severity_category").isin("High", "Medium")).alias("serious_incident_flag"),
    )


def fact_enrollment(staged: DataFrame, salt: str, as_of: Column) -> DataFrame:
    status = F.when(F.col("withdrawal_date") <= as_of, "WITHDRAWN").when(F.col("enrollment_status") == "ACTIVE", "ACTIVE").otherwise("UNKNOWN")
    key = E.surrogate_key("student_id_raw", "school_year", "school_id", "enrollment_date")
    return staged.select(key.alias("enrollment_sk"), E.hash_pii("student_id_raw", salt).alias("student_id_hash"), "school_id", "school_year", "enrollment_date", "withdrawal_date", "grade_level", "enrollment_status", status.alias("enrollment_status_derived"))
