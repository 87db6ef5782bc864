"""Grades: features, risk, performance, class effectiveness and correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarium.functions.expr import corr, grade_points, mean_tenths, ratio, rnd, share

# Letters by band.
LETTERS = {
    "above_average": ["A+", "A", "A-", "B+", "B", "B-"],
    "average": ["C+", "C", "C-"],
    "below_average": ["D+", "D", "D-", "F", "NP"],
}


def _n(flag: Column) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0)).cast("long")


def academic_features(students: DataFrame, grades: DataFrame, split: Column, days: int = 15, key: str = "student_key") -> DataFrame:
    """Grade points, letter bands and the trend before and after ``split`` (by ``days``) of every student.

    A student without grades counts as 0 throughout, and so falls into the
    highest risk band, as the surveyed model has it.
    """
    rows = students.join(grades, key, "left")
    points, letter = F.col("points"), F.col("letter")
    recent, older = mean_tenths(F.when(F.col("d") >= F.date_sub(split, days), points)), mean_tenths(F.when(F.col("d") < F.date_sub(split, days), points))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = rows.groupBy(*students.columns).agg(
        zero(rnd(mean_tenths("points"), 2)).alias("avg_score"),
        zero(F.min("points")).alias("min_score"),
        zero(F.max("points")).alias("max_score"),
        F.count("letter").alias("total_records"),
        zero(rnd(ratio(_n(F.col("passing")), F.count("letter"), 100.0), 2)).alias("passing_rate"),
        *[_n(letter.isin(v)).alias(f"{k}_count") for k, v in LETTERS.items()],
        recent.alias("_new"),
        older.alias("_old"),
    )
    trend = F.when(F.col("_new") > F.col("_old"), "IMPROVING").when(F.col("_new") < F.col("_old"), "DECLINING").otherwise("STABLE")
    return out.withColumn("grade_trend", trend).drop("_new", "_old")


# Actions by level.
ACADEMIC_ACTIONS = {
    "urgent": "URGENT: Failing trajectory, academic intervention required",
    "high": "HIGH: Consider tutoring or course support",
    "medium": "MEDIUM: Monitor progress, provide support if decline continues",
    "positive": "POSITIVE: Student showing improvement",
    "none": "On track",
}


def score_academic(features: DataFrame, key: str = "student_key") -> DataFrame:
    g, t, say = F.col("avg_score"), F.col("grade_trend"), ACADEMIC_ACTIONS
    return features.select(
        key,
        "avg_score",
        "passing_rate",
        "grade_trend",
        F.when(g < 1, 90).when(g < 2, 70).when(g < 2.5, 40).when(g < 3, 15).otherwise(5).cast("long").alias("academic_risk_score"),
        F.when(g < 1, "CRITICAL").when(g < 2, "HIGH").when(g < 2.5, "MEDIUM").otherwise("LOW").alias("risk_level"),
        "total_records",
        "above_average_count",
        "average_count",
        "below_average_count",
        F.when((g < 1) & (t == "DECLINING"), say["urgent"])
        .when(g < 2, say["high"])
        .when((g < 2.5) & (t == "DECLINING"), say["medium"])
        .when(t == "IMPROVING", say["positive"])
        .otherwise(say["none"])
        .alias("recommended_action"),
    )


def academic_performance(grades: DataFrame, keys: list[str]) -> DataFrame:
    """Grades, their mean and the share at 2.0 or above, by ``keys``."""
    return grades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("grade_count"), rnd(mean_tenths("points"), 2).alias("avg_grade"), share(F.col("points") >= 2.0).alias("pct_passing")
    )


def class_effectiveness(grades: DataFrame, students: DataFrame, keys: list[str], key: str = "student_key") -> DataFrame:
    """Enrollment, grades and pass rates of each section, with those of its subgroups."""
    rows = grades.join(students, key, "left")
    passed = F.col("points") >= 2.0

    def subgroup(flag: str) -> Column:
        return rnd(ratio(_n(F.col(flag) & passed), _n(F.col(flag)), 100.0), 2)

    return rows.groupBy(*keys).agg(
        F.count_distinct(key).alias("enrollment"),
        rnd(mean_tenths("points"), 2).alias("avg_grade"),
        share(passed).alias("pct_passed"),
        share(F.col("points") >= 3.3).alias("pct_a_b"),
        *[subgroup(f).alias(f"pct_passed_{f}") for f in ("ell", "sped", "frl")],
    )


def section_comparison(effectiveness: DataFrame, course: str = "course", term: str = "term") -> DataFrame:
    """Sections beside their course's mean in the same term, ranked and rated; pass the latest term's sections."""
    same = Window.partitionBy(course, term)
    p, g = F.col("pct_passed"), F.col("avg_grade")
    rating = (
        F.when((p >= 90) & (g >= 3.3), "Highly Effective")
        .when((p >= 80) & (g >= 3.0), "Effective")
        .when((p >= 70) & (g >= 2.5), "Adequate")
        .otherwise("Needs Improvement")
    )
    cents = F.round(g * 100).cast("long")  # values with two decimals, summed as integers
    mean = ratio(F.sum(cents).over(same), F.count(cents).over(same) * 100)
    return effectiveness.withColumns(
        {
            "course_avg_grade": rnd(mean, 2),
            "grade_diff_from_course_avg": rnd(g - mean, 2),
            **{f"pct_passed_{x}": F.coalesce(f"pct_passed_{x}", F.lit(0.0)) for x in ("ell", "sped", "frl")},
            "pass_rate_rank": F.rank().over(same.orderBy(p.desc_nulls_last())).cast("long"),
            "grade_rank": F.rank().over(same.orderBy(g.desc_nulls_last())).cast("long"),
            "effectiveness_rating": rating,
        }
    )


def correlations(rows: DataFrame, pairs: dict[str, tuple[Column, Column, str]]) -> DataFrame:
    """One row per pair of measures: coefficient, the direction it is expected to have, number of rows with both, and strength, in one aggregation."""
    aggregates = []
    for i, (name, (x, y, expected)) in enumerate(pairs.items()):
        both = x.isNotNull() & y.isNotNull()
        aggregates.append(
            F.struct(
                F.lit(name).alias("correlation_pair"), rnd(corr(x, y), 3).alias("correlation_coefficient"), F.lit(expected).alias("expected_direction"), F.coalesce(_n(both), F.lit(0)).cast("long").alias("data_points")
            ).alias(f"p{i}")
        )
    one = rows.agg(*aggregates)
    out = one.select(F.inline(F.array(*[f"p{i}" for i in range(len(pairs))])))
    size = F.coalesce(F.abs("correlation_coefficient"), F.lit(0.0))
    return out.withColumn("strength", F.when(size >= 0.7, "Strong").when(size >= 0.4, "Moderate").when(size >= 0.1, "Weak").otherwise("Negligible"))


# Names of the pairs.
ATTENDANCE_GPA, DISCIPLINE_GRADES, ATTENDANCE_ENGAGEMENT = "Attendance ↔ GPA", "Discipline ↔ Grades", "Attendance ↔ Engagement"


def performance_correlations(attendance: DataFrame, discipline: DataFrame, performance: DataFrame, key: str = "student_key") -> DataFrame:
    """How attendance goes with grades, incidents with grades, and attendance with engagement (100 less 10 for each incident), over the term.

    ``attendance`` and ``discipline`` are windows as rows, ``performance`` has
    grade_numeric; each has one row per student.  They are joined once, so a
    student missing from one is left out of its pairs only.
    """
    term = F.col("window_type") == "term"
    a = attendance.where(term).select(key, F.col("attendance_rate").alias("_rate"), F.lit(True).alias("_attends"))
    d = discipline.where(term).select(key, F.col("incident_count").alias("_incidents"))
    g = performance.select(key, F.coalesce("grade_numeric", F.lit(0.0)).alias("_grade"))
    rows = a.join(g, key, "full").join(d, key, "full")
    engaged = F.when(F.col("_attends"), F.lit(100.0) - F.coalesce("_incidents", F.lit(0)) * 10)
    pairs = {
        ATTENDANCE_GPA: (F.col("_rate"), F.col("_grade"), "Positive"),
        DISCIPLINE_GRADES: (F.col("_incidents"), F.col("_grade"), "Negative"),
        ATTENDANCE_ENGAGEMENT: (F.col("_rate"), engaged, "Positive"),
    }
    out = correlations(rows, pairs)
    # the first pair alone has 0 where there is no coefficient
    first = F.when(F.col("correlation_pair") == ATTENDANCE_GPA, F.coalesce("correlation_coefficient", F.lit(0.0))).otherwise(F.col("correlation_coefficient"))
    return out.withColumn("correlation_coefficient", first)


def outcome_distribution(grades: DataFrame, keys: list[str]) -> DataFrame:
    """Letters by ``keys`` with their share of the group, without a second pass over the rows."""
    counted = grades.groupBy(*keys, "letter").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counted.withColumn("pct", rnd(ratio(F.col("n"), total, 100.0), 2))


def cohort_tracking(courses: DataFrame, year: str, first: Column, second: Column, key: str = "student_key") -> DataFrame:
    """Of the students in ``first`` in a year, how many are in ``second`` the year after."""
    here = courses.where(first).select(key, F.col(year).alias("cohort")).distinct()
    there = courses.where(second).select(key, (F.col(year) - 1).alias("cohort")).distinct().withColumn("kept", F.lit(1))
    joined = here.join(there, [key, "cohort"], "left")
    return joined.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("students"),
        F.count("kept").alias("continued"),
        rnd(ratio(F.count("kept"), F.count(F.lit(1)), 100.0), 2).alias("pct_continued"),
    )


__all__ = [
    "academic_features",
    "academic_performance",
    "class_effectiveness",
    "cohort_tracking",
    "correlations",
    "grade_points",
    "outcome_distribution",
    "score_academic",
    "section_comparison",
]
