"""District reports: aggregates over students, enrollments, attendance and courses.

The surveyed reports join students with their enrollments and their attendance
side by side, so each row of one side is repeated for each of the other, and
counts and means are weighted by that.  Here each side is summed up by student
first and the repetition enters as a weight: the same figures, but no join whose
rows grow with the product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.functions.expr import mean_exact, ratio, rnd

# Letters by band.
HIGH, LOW = ("A", "A-", "B+"), ("D", "D-", "F")
LETTERS = {"grade_a_count": ("A", "A-"), "grade_b_count": ("B+", "B", "B-"), "grade_c_count": ("C+", "C", "C-"), "grade_d_f_count": ("D+", "D", "D-", "F")}
MASTERY = ("Advanced", "Proficient", "Developing", "Beginning")


def _n(flag: Column) -> Column:
    return F.count(F.when(flag, 1))


def _units(x: str, digits: int) -> Column:
    return F.round(F.col(x) * 10**digits).cast("long")


def _mean(x: str, decimals: int, digits: int) -> Column:
    return rnd(mean_exact(x, decimals), digits)


def _percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return rnd(ratio(part, whole, 100.0), digits)


def _sides(students: DataFrame, enrollment: DataFrame, attendance: DataFrame, key: str) -> DataFrame:
    """Each student with sums over its enrollments and attendance, and how often a join would repeat each side."""
    e = enrollment.groupBy(key).agg(
        F.count(F.lit(1)).alias("_e"), _n(F.col("letter").isin(*HIGH)).alias("_high"), _n(F.col("letter").isin(*LOW)).alias("_low"), F.count_distinct("enrollment_id").alias("_ids"), _n(F.col("flagged")).alias("_flagged")
    )
    a = attendance.groupBy(key).agg(
        F.count(F.lit(1)).alias("_a"), F.sum(_units("attendance_rate", 4)).alias("_rate"), F.count("attendance_rate").alias("_rates"), _n(F.col("chronic")).alias("_chronic"), _n(F.col("warning") == "High Risk").alias("_warned")
    )
    rows = students.join(e, key, "left").join(a, key, "left")
    sums = ("_e", "_high", "_low", "_ids", "_flagged", "_a", "_rate", "_rates", "_chronic", "_warned")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in sums})
    return rows.withColumns({"_by_e": F.greatest("_e", F.lit(1)), "_by_a": F.greatest("_a", F.lit(1)), "_gpa": _units("gpa", 2)}).withColumn("_w", F.col("_by_e") * F.col("_by_a"))


def _weighted(c: Column | str, weight: str) -> Column:
    return F.sum((F.col(c) if isinstance(c, str) else c) * F.col(weight))


def _where(flag: Column, weight: str) -> Column:
    return F.coalesce(F.sum(F.when(flag, F.col(weight))), F.lit(0))


def grade_level_performance(students: DataFrame, enrollment: DataFrame, attendance: DataFrame, key: str = "student_key") -> DataFrame:
    """Needs, grades, enrollments and attendance of each grade level."""
    rows = _sides(students.where("grade IS NOT NULL"), enrollment, attendance, key)
    has_gpa = F.col("_gpa").isNotNull()
    out = rows.groupBy("grade").agg(
        F.count_distinct(key).alias("student_count"),
        _percent(_where(F.col("sped"), "_w"), F.sum("_w")).alias("percent_special_ed"),
        _percent(_where(F.col("ell"), "_w"), F.sum("_w")).alias("percent_english_learner"),
        rnd(ratio(_weighted("_gpa", "_w"), _where(has_gpa, "_w") * 100), 2).alias("avg_gpa"),
        rnd(F.max("gpa"), 2).alias("max_gpa"),
        rnd(F.min("gpa"), 2).alias("min_gpa"),
        _weighted("_high", "_by_a").alias("high_achiever_count"),
        _weighted("_low", "_by_a").alias("struggling_count"),
        _percent(_weighted("_low", "_by_a"), F.sum("_ids")).alias("failure_rate_percent"),
        rnd(ratio(_weighted("_rate", "_by_e"), _weighted("_rates", "_by_e") * 10_000), 4).alias("avg_attendance_rate"),
        _weighted("_chronic", "_by_e").alias("chronically_absent_count"),
        _percent(_weighted("_warned", "_by_e"), F.count_distinct(F.when(F.col("_a") > 0, F.col(key)))).alias("high_risk_attendance_percent"),
    )
    return out.orderBy("grade")


def special_programs_impact(students: DataFrame, enrollment: DataFrame, attendance: DataFrame, key: str = "student_key") -> DataFrame:
    """Participants and outcomes of three programmes, from one pass over students."""
    rows = _sides(students, enrollment, attendance, key)
    programs = {"Special Education": "sped", "English Language Learner": "ell", "Free/Reduced Lunch Eligible": "frl"}
    one = rows.agg(*(_program(name, F.col(flag), key).alias(f"p{i}") for i, (name, flag) in enumerate(programs.items())))
    return one.select(F.inline(F.array(*[f"p{i}" for i in range(len(programs))])))


def _program(name: str, member: Column, key: str) -> Column:
    w = lambda c, weight: F.sum(F.when(member, F.col(c) * F.col(weight)))
    return F.struct(
        F.lit(name).alias("program"),
        F.count_distinct(F.when(member, F.col(key))).alias("participant_count"),
        rnd(ratio(w("_gpa", "_w"), F.sum(F.when(member & F.col("_gpa").isNotNull(), F.col("_w"))) * 100), 2).alias("avg_gpa"),
        rnd(ratio(w("_rate", "_by_e"), w("_rates", "_by_e") * 10_000), 4).alias("avg_attendance"),
        _where(member & F.col("frl"), "_w").alias("frpl_participants"),
        _percent(w("_flagged", "_by_a"), F.sum(F.when(member, F.col("_w")))).alias("intervention_flag_percent"),
    )


def department_performance(courses: DataFrame, enrollment: DataFrame, key: str = "student_key") -> DataFrame:
    """Courses, enrollments, grades and engagement of each department and subject; courses without enrollments count."""
    rows = courses.where("department IS NOT NULL").join(enrollment.drop("term"), "course_id", "left")
    out = rows.groupBy("department", "subject").agg(
        F.count_distinct("course_id").alias("course_count"),
        F.count_distinct("enrollment_id").alias("total_enrollments"),
        F.count_distinct(key).alias("unique_students"),
        _mean("grade_percent", 1, 1).alias("avg_grade_percent"),
        *(_n(F.col("letter").isin(*letters)).alias(o) for o, letters in LETTERS.items()),
        _percent(_n(F.col("flagged")), F.count(F.lit(1))).alias("intervention_flag_percent"),
        _mean("completion", 2, 2).alias("avg_assignment_completion_rate"),
        _mean("participation", 1, 1).alias("avg_participation_score"),
    )
    return out.orderBy("department", "subject")


def term_trends(enrollment: DataFrame, courses: DataFrame, attendance: DataFrame, key: str = "student_key") -> DataFrame:
    """Enrollments, grades, engagement and risk by term, latest first; attendance has one row per student and term."""
    rows = enrollment.where("term IS NOT NULL").join(courses.select("course_id", F.col("course_id").alias("_offered")), "course_id", "left")
    rows = rows.join(attendance.select(key, "term", "attendance_rate", "chronic"), [key, "term"], "left")
    out = rows.groupBy("term").agg(
        F.count_distinct(key).alias("unique_students"),
        F.count_distinct("enrollment_id").alias("enrollment_count"),
        F.count_distinct("_offered").alias("courses_offered"),
        _mean("grade_percent", 1, 1).alias("avg_grade_percent"),
        _mean("gpa_contribution", 2, 2).alias("avg_gpa_contribution"),
        _n(F.col("letter").isin(*LOW)).alias("failing_enrollments"),
        _mean("completion", 2, 3).alias("avg_assignment_completion_rate"),
        _mean("attendance_rate", 4, 4).alias("avg_attendance_rate"),
        _n(F.col("flagged")).alias("intervention_flagged_enrollments"),
        _n(F.col("chronic")).alias("chronically_absent_students"),
    )
    return out.orderBy(F.desc("term"))


def at_risk_aggregates(students: DataFrame, enrollment: DataFrame, attendance: DataFrame, key: str = "student_key") -> DataFrame:
    """Students at risk by cause, and rows as a percentage of active students; three scans in all."""
    active = F.count_distinct(F.when(F.col("status") == "Active", F.col(key)))
    seen = lambda flag, name: (F.count_distinct(F.when(flag, F.col(key))).alias(f"{name}_students"), _n(flag).alias(f"{name}_rows"))
    low = F.col("gpa") < 2.0
    one = students.agg(active.alias("_active"), *seen(low, "gpa"), *seen(F.col("sped"), "sped"), *seen(F.col("ell"), "ell"))
    one = one.crossJoin(attendance.agg(*seen(F.col("chronic"), "absent"))).crossJoin(enrollment.agg(*seen(F.col("flagged"), "flag")))  # one row each
    causes = (
        ("Attendance", "absent", "rows", "Chronically Absent (< 90% attendance)"),
        ("Academic", "flag", "rows", "Flagged for Intervention"),
        ("Academic", "gpa", "students", "GPA Below 2.0 (At Academic Risk)"),
        ("Demographic", "sped", "rows", "Special Education"),
        ("Demographic", "ell", "rows", "English Language Learner"),
    )
    parts = [
        F.struct(F.lit(c).alias("risk_category"), F.col(f"{n}_students").alias("affected_students"), _percent(F.col(f"{n}_{over}"), F.col("_active")).alias("percent_of_active"), F.lit(text).alias("risk_description"))
        for c, n, over, text in causes
    ]
    return one.select(F.inline(F.array(*parts)))


def course_utilization(courses: DataFrame, enrollment: DataFrame, key: str = "student_key") -> DataFrame:
    """Each course with its enrollments, grades and demand."""
    own = enrollment.groupBy("course_id").agg(
        F.count_distinct("enrollment_id").alias("actual_enrollment"), F.count_distinct(key).alias("unique_students"), _mean("grade_percent", 1, 1).alias("avg_grade_percent"), _n(F.col("letter").isin(*HIGH)).alias("high_achiever_count"), _n(F.col("letter").isin(*LOW)).alias("failing_count")
    )
    share = F.col("capacity_percent")
    demand = reduce(lambda acc, s: acc.when(share >= s[0], s[1]), ((90, "High Demand"), (70, "Good Enrollment"), (50, "Moderate Enrollment")), F.when(share >= 100, "Over Capacity")).otherwise("Low Enrollment")
    counts = ("actual_enrollment", "unique_students", "high_achiever_count", "failing_count")
    out = courses.select("course_id", "course_name", "department", "term", "capacity", "current_enrollment", "capacity_percent").join(own, "course_id", "left")
    return out.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in counts}, "demand_level": demand}).orderBy(F.desc("term"), F.desc("capacity_percent"))


def advanced_track_performance(enrollment: DataFrame, key: str = "student_key") -> DataFrame:
    """Grades by track in one pass; an enrollment in both tracks counts in both, one with an unknown track in neither regular."""
    tracks = {"Advanced Placement": F.col("ap"), "Honors": F.col("honors"), "Regular Track": ~F.col("ap") & ~F.col("honors")}

    def one(name: str, member: Column) -> Column:
        of = lambda c, d: rnd(ratio(F.sum(F.when(member, _units(c, d))), F.count(F.when(member, F.col(c))) * 10**d), d)
        return F.struct(
            F.lit(name).alias("track_type"),
            F.count_distinct(F.when(member, F.col(key))).alias("student_count"),
            F.count_distinct(F.when(member, F.col("enrollment_id"))).alias("enrollment_count"),
            of("grade_percent", 1).alias("avg_grade_percent"),
            _n(member & F.col("letter").isin("A", "A-")).alias("top_grade_count"),
            of("gpa_contribution", 2).alias("avg_gpa_contribution"),
        )

    rows = enrollment.agg(*(one(n, m).alias(f"t{i}") for i, (n, m) in enumerate(tracks.items())))
    return rows.select(F.inline(F.array(*[f"t{i}" for i in range(len(tracks))])))


def competency_mastery_trends(records: DataFrame, key: str = "student_key") -> DataFrame:
    """Shares of mastery levels, scores and support offered for each competency."""
    level, whole = F.col("mastery_level"), F.count(F.lit(1))
    out = records.where("competency_id IS NOT NULL").groupBy("competency_id", "competency_name", "standard_code").agg(
        F.count_distinct(key).alias("students_assessed"),
        *(_percent(_n(level == m), whole).alias(f"{m.lower()}_percent") for m in MASTERY),
        _mean("score_percent", 1, 1).alias("avg_score_percent"),
        _n(F.col("remediation")).alias("remediation_needed"),
        _n(F.col("enrichment")).alias("enrichment_offered"),
    )
    return out.orderBy(F.desc("students_assessed"))


def data_quality_summary(students: DataFrame, enrollment: DataFrame, attendance: DataFrame, key: str = "student_key") -> DataFrame:
    """How many graded enrollments meet a known attendance, and graded enrollments as a percentage of active students."""
    e = enrollment.where("grade_percent IS NOT NULL").groupBy(key).agg(F.count(F.lit(1)).alias("_e"))
    a = attendance.where("attendance_rate IS NOT NULL").groupBy(key).agg(F.count(F.lit(1)).alias("_a"))
    rows = students.join(e, key, "left").join(a, key, "left")
    known = F.col("gpa").isNotNull()
    whole = lambda c: F.coalesce(F.sum(F.when(known, c)), F.lit(0))
    one = rows.agg(whole(F.col("_e") * F.col("_a")).cast("double").alias("_complete"), _percent(whole(F.col("_e")), _n(F.col("status") == "Active")).alias("_share"))
    texts = (
        ("Complete Records", "_complete", "Students with complete enrollment, attendance, and grade data"),
        ("Data Completeness Percentage", "_share", "Percent of active students with complete data"),
    )
    return one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("count"), F.lit(d).alias("description")) for m, c, d in texts])))
