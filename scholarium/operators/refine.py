"""Refined tables: normalised ones with ids hashed, names and contacts masked and reasons grouped, and the views over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.functions.expr import hash_pii, mean_exact, ratio, rnd
from scholarium.operators.district import HIGH, LOW
from scholarium.operators.normalize import pairs

# What is hashed (source>out), masked (source>out, with the characters that stay) and left out of each table.
HASHED = {
    "students": "student_id>student_id_hashed date_of_birth>dob_hashed",
    "courses": "instructor_id>instructor_id_hashed",
    "enrollment": "enrollment_id>enrollment_id_hashed student_id>student_id_hashed",
    "attendance": "attendance_id>attendance_id_hashed student_id>student_id_hashed",
    "academic_records": "record_id>record_id_hashed student_id>student_id_hashed",
}
MASKED = {"students": {"first_name": 2, "last_name": 1, "address": 0}, "courses": {"instructor_name": 1}}
EMAILS = {"students": "email", "courses": "instructor_email"}
PHONES = {"students": "phone"}
DROPPED = {"students": "middle_name birth_month withdrawal_date created_date updated_date", "courses": "meeting_schedule created_date updated_date"}
#: Reasons by a word in their description, the first that fits.
REASONS = (("medical", "Health-related"), ("doctor", "Health-related"), ("appointment", "Medical appointment"), ("family", "Family matter"))


def mask_text(x: Column, shown: int = 1) -> Column:
    """The first characters and a star for each other one; a text no longer than ``shown`` is one star."""
    n = F.length(x)
    return F.when(x.isNull(), None).when(n <= shown, "*").otherwise(F.concat(F.substring(x, 1, shown), F.repeat(F.lit("*"), n - shown)))


def mask_email(x: Column) -> Column:
    at = F.instr(x, "@")
    both = F.concat(mask_text(F.substring(x, F.lit(1), at - 1), 2), F.lit("@"), mask_text(F.substring(x, at + 1, F.length(x)), 2))
    return F.when(x.isNull(), None).when(at == 0, mask_text(x, 2)).otherwise(both)


def mask_phone(x: Column) -> Column:
    """Of ten digits or more, what stands up to three characters after the first hyphen stays."""
    digits = F.length(F.regexp_replace(x, "[^0-9]", ""))
    return F.when(x.isNull(), None).when(digits >= 10, F.concat(F.substring(x, F.lit(1), F.instr(x, "-") + 3), F.lit("****"))).otherwise(mask_text(x, 1))


def reason_category(x: Column) -> Column:
    named = reduce(lambda acc, r: acc.when(x.contains(r[0]), r[1]), REASONS, F.when(F.lit(False), ""))
    return named.when(x != "", "Absence notification").otherwise("Unknown")


def refine(normal: DataFrame, entity: str, salt: str) -> DataFrame:
    """A normalised table without personal data.  Null ids stay null, so that they match nothing."""
    hashed, masked, gone = pairs(HASHED[entity]), MASKED.get(entity, {}), set(DROPPED.get(entity, "created_date updated_date").split())
    out: dict[str, Column] = {o: F.when(F.col(s).isNotNull(), hash_pii(F.col(s), salt)) for o, s in hashed.items()}
    out |= {f"{s}_masked": mask_text(F.col(s), n) for s, n in masked.items()}
    for names, mask in ((EMAILS, mask_email), (PHONES, mask_phone)):
        if entity in names:
            out[f"{names[entity]}_masked"] = mask(F.col(names[entity]))
    if entity == "students":
        out |= {"birth_year_generalized": F.col("birth_year"), "withdrawn_flag": F.col("withdrawal_date").isNotNull()}
        gone.add("birth_year")
    if entity == "attendance":
        out["reason_category"] = reason_category(F.col("reason_description"))
        gone.add("reason_description")
    gone |= {*hashed.values(), *masked, EMAILS.get(entity), PHONES.get(entity)}
    out |= {c: F.col(c) for c in normal.columns if c not in gone}
    return normal.select(*(c.alias(o) for o, c in out.items()), F.lit("FERPA Compliant").alias("privacy_classification"))


def student_enrollment(students: DataFrame, enrollment: DataFrame, courses: DataFrame, attendance: DataFrame) -> DataFrame:
    """Students with their enrollments, courses and the term's attendance; students without enrollments stay."""
    key = "student_id_hashed"
    own = attendance.groupBy(key, "term").agg(ratio(F.sum(F.round(F.col("attendance_rate") * 10_000).cast("long")), F.count("attendance_rate") * 10_000).alias("attendance_rate"), F.max("chronically_absent").alias("chronically_absent"), F.max("warning_level").alias("warning_level"))
    e = enrollment.select(key, "enrollment_id_hashed", F.col(key).alias("enr_student_id_hashed"), F.col("course_id").alias("_course"), "term", "letter_grade", "final_grade_percent")
    rows = students.select(key, "grade_level", "special_education", "gpa").join(e, key, "left").join(own, [key, "term"], "left")
    rows = rows.join(courses.select("course_id", "course_name", "department"), F.col("_course") == F.col("course_id"), "left")
    return rows.select(key, "enrollment_id_hashed", "enr_student_id_hashed", "course_id", "course_name", "department", "term", "letter_grade", "final_grade_percent", "grade_level", "special_education", "gpa", "attendance_rate", "chronically_absent", "warning_level")


def course_performance(enrollment: DataFrame, courses: DataFrame) -> DataFrame:
    """Enrollments, grades and interventions by course and term; enrollments of unknown courses share a row without a course."""
    n = lambda flag: F.count(F.when(flag, 1))
    known = courses.select(F.col("course_id").alias("_id"), "course_name", "department")
    rows = enrollment.join(known, F.col("course_id") == F.col("_id"), "left")
    return rows.groupBy(F.col("_id").alias("course_id"), "course_name", "department", "term").agg(
        F.count_distinct("student_id_hashed").alias("enrollment_count"),
        rnd(mean_exact("final_grade_percent", 1), 1).alias("avg_grade_percent"),
        rnd(mean_exact("gpa_contribution", 2), 2).alias("avg_gpa_contribution"),
        n(F.col("letter_grade").isin(*HIGH)).alias("high_achiever_count"),
        n(F.col("letter_grade").isin(*LOW)).alias("struggling_count"),
        rnd(ratio(n(F.col("flag_for_intervention")), F.count(F.lit(1)), 100.0), 1).alias("intervention_flag_percent"),
    )


def verification(refined: dict[str, DataFrame]) -> DataFrame:
    """(entity, total_records, hashed_pii, masked_pii): rows with their first id hashed, and with the second id hashed or the first name masked."""
    second = {"students": "first_name_masked", "courses": "instructor_name_masked"}
    parts = []
    for name, rows in refined.items():
        first = next(iter(pairs(HASHED[name])))
        hashed = F.count_distinct(first) if name == "courses" else F.count(first)
        parts.append(rows.agg(F.lit(name).alias("entity"), F.count(F.lit(1)).alias("total_records"), hashed.alias("hashed_pii"), F.count(second.get(name, "student_id_hashed")).alias("masked_pii")))
    return reduce(DataFrame.unionAll, parts)
