"""Schools and subgroups: demographics, equity, matching, benchmarks, accountability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarium.functions.expr import mean_exact, ratio, rnd, share, sum_if


def demographics(students: DataFrame, keys: list[str], k: int = 5, key: str = "student_key") -> DataFrame:
    """Group sizes and ages; groups with fewer than ``k`` students are withheld."""
    return (
        students.groupBy(*keys)
        .agg(
            F.count_distinct(key).alias("students"),
            rnd(F.avg("age"), 2).alias("avg_age"),
            F.min("age").alias("min_age"),
            F.max("age").alias("max_age"),
            share(F.col("active")).alias("active_rate"),
        )
        .where(F.col("students") >= k)
    )


def k_anonymity_violations(rows: DataFrame, quasi: list[str], k: int = 5) -> DataFrame:
    """Groups smaller than ``k``, with what they lack."""
    return rows.groupBy(*quasi).agg(F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") < k).withColumn("deficit", F.lit(k) - F.col("group_size"))


def equity_outcomes(students: DataFrame, keys: list[str]) -> DataFrame:
    """Attendance, discipline and grades by cohort of ``keys``."""
    g = F.col("avg_gpa")
    return students.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cohort_size"),
        share(F.col("attendance_rate") > 90).alias("pct_good_attendance"),
        share(F.coalesce("incidents", F.lit(0)) == 0).alias("pct_no_discipline"),
        rnd(F.avg("avg_gpa"), 2).alias("avg_gpa"),
        share(g >= 2.5).alias("pct_gpa_2_5"),
        share(g < 2.0).alias("pct_gpa_below_2"),
    )


def _share(flag: Column) -> Column:
    return share(flag, 1)


def _mean(column: str, decimals: int, digits: int) -> Column:
    return rnd(mean_exact(column, decimals), digits)


def equity_by_race(wide: DataFrame, keys: list[str], key: str = "student_key") -> DataFrame:
    """Sizes, needs, attendance, discipline, grades and risk by group, from a row per student."""
    flags = {"special_ed_count": "sped", "frl_count": "frl", "ell_count": "ell", "homeless_count": "homeless"}
    rate, gpa, risk = F.col("attendance_rate"), F.col("avg_gpa"), F.col("risk_level")
    return wide.groupBy(*keys).agg(
        F.count_distinct(key).alias("student_count"),
        *(sum_if(F.col(c)).alias(o) for o, c in flags.items()),
        _mean("attendance_rate", 2, 1).alias("avg_attendance_rate"),
        _share(rate >= 90).alias("pct_good_attendance"),
        _mean("days_absent", 0, 1).alias("avg_days_absent"),
        _mean("incidents", 0, 2).alias("avg_discipline_incidents"),
        _share(F.col("incidents") == 0).alias("pct_no_discipline"),
        _share(F.col("suspensions") > 0).alias("pct_suspended"),
        _mean("avg_gpa", 2, 2).alias("avg_gpa"),
        _share(gpa >= 2.5).alias("pct_gpa_2_5_plus"),
        _share(gpa < 2.0).alias("pct_below_c"),
        *(_share(risk == level).alias(f"pct_{level.lower()}_risk") for level in ("High", "Moderate", "Low")),
    )


def school_summary(wide: DataFrame, races: dict[str, str], key: str = "student_key", school: str = "school") -> DataFrame:
    """Enrollment, needs, races (output name by value of ``ethnicity``), grade levels, outcomes and risk of each school."""
    return wide.groupBy(school).agg(
        F.count_distinct(key).alias("student_count"),
        *(_share(F.col(c)).alias(o) for o, c in (("pct_special_ed", "sped"), ("pct_frl", "frl"), ("pct_ell", "ell"))),
        *(_share(F.col("ethnicity") == value).alias(f"pct_{name}") for name, value in races.items()),
        _share(F.col("multi")).alias("pct_multi_racial"),
        _mean("grade", 0, 1).alias("avg_grade_level"),
        _mean("attendance_rate", 2, 1).alias("avg_attendance_rate"),
        _share(F.col("attendance_rate") >= 90).alias("pct_good_attendance"),
        _mean("incidents", 0, 2).alias("avg_discipline_incidents"),
        _mean("avg_gpa", 2, 2).alias("avg_gpa"),
        _share(F.col("risk_level") == "High").alias("pct_high_risk"),
    )


def student_events(daily: DataFrame, incidents: DataFrame, key: str = "student_key") -> DataFrame:
    """attendance_rate, days_absent, incidents and suspensions of each student: days and incidents stacked and grouped once."""
    no = F.lit(False)
    days = daily.select(key, "absent", F.lit(True).alias("_day"), no.alias("_incident"), no.alias("_serious"))
    rows = days.unionAll(incidents.select(key, no, no, F.lit(True), F.col("serious")))
    n = lambda flag: F.sum(F.when(flag, 1).otherwise(0)).cast("long")
    present = n(F.col("_day") & ~F.col("absent"))
    return rows.groupBy(key).agg(rnd(ratio(present, n(F.col("_day")), 100.0), 2).alias("attendance_rate"), n(F.col("absent")).alias("days_absent"), n(F.col("_incident")).alias("incidents"), n(F.col("_serious")).alias("suspensions"))


def student_wide(students: DataFrame, *outcomes: DataFrame, key: str = "student_key") -> DataFrame:
    """A row per student with outcomes (attendance_rate, incidents, avg_gpa among them) and a three-level risk."""
    rows = reduce(lambda a, b: a.join(b, key, "left"), outcomes, students)
    rows = rows.withColumn("incidents", F.coalesce("incidents", F.lit(0)))
    rate, n, g = F.col("attendance_rate"), F.col("incidents"), F.col("avg_gpa")
    level = F.when((rate < 90) | (n > 2) | (g < 2), "High").when((rate < 95) | (n > 0) | (g < 2.5), "Moderate").otherwise("Low")
    return rows.withColumn("risk_level", level)


def mapping_union(keys: DataFrame, manual: DataFrame, fuzzy: DataFrame, key: str, code: str) -> DataFrame:
    """Manual matches, then fuzzy ones of the rest, then what is unmapped."""
    by_hand = manual.select(key, code, F.lit("manual").alias("match_method"))
    close = fuzzy.join(by_hand, key, "left_anti").select(key, code, F.lit("fuzzy").alias("match_method"))
    known = by_hand.unionByName(close)
    rest = keys.join(known, key, "left_anti").select(key, F.lit(None).cast(known.schema[code].dataType).alias(code), F.lit("unmapped").alias("match_method"))
    return known.unionByName(rest)


def benchmarks(own: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Own student count and chronic rate (``own_count``, ``own_rate``) beside the state's (``state_count``, ``state_rate``), with labels."""
    rows = own.join(state, key, "left")
    better, worse = F.col("own_rate") < F.col("state_rate"), F.col("own_rate") > F.col("state_rate")
    apart = F.abs(F.coalesce("own_count", F.lit(0)) - F.coalesce("state_count", F.lit(0))).cast("long")
    rows = rows.withColumns(
        {
            "chronic_absent_rate_gap_pct": rnd(F.col("own_rate") - F.col("state_rate"), 2),
            "chronic_absence_comparison": F.when(better, "Better than State").when(worse, "Worse than State").otherwise("Same as State"),
            "missing_internal_data": F.col("own_count").isNull(),
            "missing_cde_data": F.col("state_count").isNull(),
            "enrollment_difference": apart,
            "large_enrollment_discrepancy": apart > 50,
        }
    )
    status = (
        F.when(F.col("missing_internal_data") | F.col("missing_cde_data"), "Incomplete Data")
        .when(F.col("large_enrollment_discrepancy"), "Data Quality Issue")
        .when(worse, "Needs Improvement")
        .when(better, "Outperforming State")
        .otherwise("On Par with State")
    )
    return rows.withColumn("overall_status", status)


def accountability(domains: dict[str, DataFrame], grain: list[str], measures: dict[str, list[str]]) -> DataFrame:
    """One wide table: the distinct grain of all domains with each domain's measures and how many are present.

    Domains are stacked and grouped once on the grain, one shuffle instead of a
    union and a join per domain.  Each domain must have one row per grain.
    """
    names = [f"{d}_{m}" for d in domains for m in measures[d]]
    kinds = {f"{d}_{m}": df.schema[m].dataType for d, df in domains.items() for m in measures[d]}

    def widened(d: str, df: DataFrame) -> DataFrame:
        mine = {f"{d}_{m}": F.col(m) for m in measures[d]}
        return df.select(*grain, *[mine.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in names], *[F.lit(1 if x == d else 0).alias(f"_{x}") for x in domains])

    stacked = reduce(DataFrame.unionByName, [widened(d, df) for d, df in domains.items()])
    wide = stacked.groupBy(*grain).agg(*[F.max(n).alias(n) for n in names], *[F.max(f"_{d}").alias(f"_{d}") for d in domains])
    present: Column = reduce(lambda a, b: a + b, [F.col(f"_{d}") for d in domains])
    flags = {f"has_{d}": F.col(f"_{d}") == 1 for d in domains}
    return wide.withColumns({"domains_present": present.cast("long"), **flags}).drop(*[f"_{d}" for d in domains])


def enrollment_by_year(rows: DataFrame, keys: list[str], chosen: Column, key: str = "student_key") -> DataFrame:
    return rows.where(chosen).groupBy(*keys).agg(F.count_distinct(key).alias("students"))


def disparity(rows: DataFrame, group: str, flag: Column) -> DataFrame:
    """Each group's rate over the rate of all rows."""
    by = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(flag, 1).otherwise(0)).alias("hits"))
    whole = Window.partitionBy(F.lit(1))  # one row per group stands here
    rate = ratio(F.col("hits"), F.col("n"))
    overall = ratio(F.sum("hits").over(whole), F.sum("n").over(whole))
    return by.select(group, "n", rnd(rate * 100, 2).alias("rate"), rnd(rate / F.nullif(overall, F.lit(0.0)), 4).alias("disparity_index"))
