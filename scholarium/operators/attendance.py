"""Attendance: summaries, anchored windows, trends, features and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.functions.expr import bands, is_schoolday, ratio, rnd

WINDOWS = (("30d", 30), ("60d", 60), ("90d", 90), ("term", 365))


def _n(flag: Column) -> Column:
    return F.sum(F.when(flag, 1).otherwise(0)).cast("long")


def attendance_summary(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and rates (fractions, four digits) of school days by ``keys``."""
    days = daily.where(is_schoolday("d"))
    out = days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days_enrolled"),
        _n(~F.col("absent")).alias("days_present"),
        _n(F.col("absent")).alias("days_absent"),
        _n(F.col("absent") & ~F.col("unexcused")).alias("days_excused"),
        _n(F.col("tardy")).alias("days_tardy"),
    )
    rate = lambda c: rnd(ratio(F.col(c), F.col("days_enrolled")), 4)
    return out.select("*", rate("days_present").alias("attendance_rate"), rate("days_absent").alias("absence_rate"), rate("days_excused").alias("excused_rate"))


def student_windows(daily: DataFrame, incidents: DataFrame, key: str = "student_key", windows=WINDOWS, short: str = "30d", long: str = "90d") -> DataFrame:
    """One row per student: a struct of counts, rates, trend and incident score for each window, anchored at the latest date of ``daily``.

    School days and incidents are stacked and grouped once by student, with a
    conditional count for each window, so no row is repeated and one shuffle
    serves all windows.  A window without school days is null; the trend
    compares ``short`` with ``long`` and is 'stable' where one of them is missing.
    """
    as_of = daily.agg(F.max("d").alias("latest"))
    no = F.lit(False)
    days = daily.where(is_schoolday("d")).select(key, "d", "absent", "unexcused", "tardy", no.alias("incident"))
    stacked = days.unionByName(incidents.select(key, "d", *(no.alias(c) for c in ("absent", "unexcused", "tardy")), F.lit(True).alias("incident")))
    rows = stacked.crossJoin(F.broadcast(as_of))  # one row
    counts = []
    for name, n in windows:
        held = F.col("d") >= F.date_sub("latest", n)
        day = held & ~F.col("incident")
        flags = {"total": day, "present": day & ~F.col("absent"), "absent": day & F.col("absent"), "excused": day & F.col("absent") & ~F.col("unexcused"), "unexcused": day & F.col("unexcused"), "tardy": day & F.col("tardy"), "incidents": held & F.col("incident")}
        counts += [_n(v).alias(f"{name}_{k}") for k, v in flags.items()]
    grouped = rows.groupBy(key).agg(F.max("latest").alias("latest"), *counts)
    pct = lambda name, c: rnd(ratio(F.col(f"{name}_{c}"), F.col(f"{name}_total"), 100.0), 2)
    names = [name for name, _ in windows]
    trend = F.lit("stable")
    if short in names and long in names:
        r_short, r_long = pct(short, "present"), pct(long, "present")
        trend = F.when(r_short < r_long - 2, "declining").when(r_short > r_long + 2, "improving").otherwise("stable")
    grouped = grouped.withColumn("_trend", trend)

    def struct(name: str, n: int) -> Column:
        c = lambda x: F.col(f"{name}_{x}")
        rate = pct(name, "present")
        away = F.lit(100.0) - rate
        whole = F.struct(
            F.date_sub("latest", n).alias("window_start_date"),
            F.lit(name).alias("window_type"),
            c("total").alias("total_school_days"),
            c("present").alias("present_days"),
            c("absent").alias("absent_days"),
            c("excused").alias("excused_absences"),
            c("unexcused").alias("unexcused_absences"),
            c("tardy").alias("tardy_incidents"),
            rate.alias("attendance_rate"),
            rnd(away, 2).alias("absence_rate"),
            pct(name, "unexcused").alias("unexcused_absence_rate"),
            pct(name, "tardy").alias("tardy_rate"),
            F.when(away >= 10, 1).otherwise(0).cast("long").alias("chronic_absence_flag"),
            c("incidents").alias("discipline_incidents_in_window"),
            rnd(F.least(away / 10 * (c("incidents") * F.lit(10.0)), F.lit(100.0)), 0).alias("absence_discipline_correlation_score"),
            F.col("_trend").alias("pattern_direction"),
        )
        return F.when(c("total") > 0, whole).alias(f"w_{name}")

    return grouped.select(key, *(struct(name, n) for name, n in windows))


def attendance_windows(daily: DataFrame, incidents: DataFrame, key: str = "student_key", windows=WINDOWS, short: str = "30d", long: str = "90d") -> DataFrame:
    """The windows of ``student_windows`` as rows, one per student and window with school days."""
    wide = student_windows(daily, incidents, key, windows, short, long)
    held = F.filter(F.array(*(F.col(f"w_{name}") for name, _ in windows)), lambda w: w.isNotNull())
    return wide.select(key, F.inline(held))


def discipline_windows(incidents: DataFrame, as_of: Column, key: str = "student_key", windows=(("30d", 30), ("90d", 90))) -> DataFrame:
    """Incidents by student in the last days and the current quarter up to ``as_of``; students without any in a window have no row."""
    starts = [(name, F.date_sub(as_of, n)) for name, n in windows] + [("term", F.date_trunc("quarter", as_of).cast("date"))]
    counted = incidents.where(F.col(key).isNotNull() & (F.col("d") <= as_of)).groupBy(key).agg(*(_n(F.col("d") >= start).alias(f"n_{name}") for name, start in starts))
    defs = F.array(*(F.struct(F.lit(name).alias("window_type"), start.alias("window_start_date"), F.col(f"n_{name}").alias("incident_count")) for name, start in starts))
    rows = counted.select(key, F.inline(F.filter(defs, lambda w: w["incident_count"] > 0)))
    return rows.withColumn("incident_frequency_rate", F.col("incident_count"))


def chronic_absence_features(students: DataFrame, daily: DataFrame, key: str = "student_key", short: int = 30, long: int = 90) -> DataFrame:
    """School days missed lately and in all by each student, and the 10 % flag, in one pass over attendance."""
    as_of = daily.agg(F.max("d").alias("latest"))
    rows = daily.where(is_schoolday("d")).crossJoin(F.broadcast(as_of))  # one row
    within = lambda n: F.col("d") >= F.date_sub("latest", n)
    counted = rows.groupBy(key).agg(
        _n(F.col("absent") & within(short)).alias("short"),
        _n(F.col("absent") & within(long)).alias("long"),
        _n(F.col("unexcused")).alias("unexcused"),
        _n(F.col("tardy")).alias("tardy"),
        rnd(ratio(_n(~F.col("absent") & within(short)), _n(within(short)), 100.0), 2).alias("rate"),
        _n(F.col("absent")).alias("absent"),
        F.count(F.lit(1)).alias("enrolled"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return students.join(counted, key, "left").select(
        *students.columns,
        zero("short").alias("days_absent_30d"),
        zero("long").alias("days_absent_90d"),
        zero("unexcused").alias("unexcused_absences_total"),
        zero("tardy").alias("tardies_total"),
        F.coalesce("rate", F.lit(100.0)).alias("attendance_rate_30d"),
        F.coalesce(ratio(F.col("absent"), F.col("enrolled")) >= 0.10, F.lit(False)).alias("chronic_absence_flag"),
    )


# Actions by level.
ABSENCE_ACTIONS = {
    "flag": "CRITICAL: Schedule immediate parent conference and intervention plan",
    "high": "HIGH: Monitor closely, trending towards chronic absence",
    "medium": "MEDIUM: Preventive outreach recommended",
    "low": "LOW: On track",
}


def score_chronic_absence(features: DataFrame, key: str = "student_key") -> DataFrame:
    capped = lambda c, k: F.least(F.lit(100.0), F.ceil(F.col(c) * F.lit(float(k))).cast("double"))
    out = features.select(
        key,
        capped("days_absent_30d", 10).alias("recent_absence_score"),
        capped("days_absent_90d", 3).alias("trend_absence_score"),
        capped("unexcused_absences_total", 5).alias("unexcused_score"),
        "days_absent_30d",
        "days_absent_90d",
        "attendance_rate_30d",
        "chronic_absence_flag",
    )
    score = F.col("recent_absence_score") * 0.5 + F.col("trend_absence_score") * 0.3 + F.col("unexcused_score") * 0.2
    out = out.withColumn("chronic_absence_risk_score", rnd(score, 1))
    s = F.col("chronic_absence_risk_score")
    level = bands(s, [(70, "CRITICAL"), (50, "HIGH"), (30, "MEDIUM")], "LOW")
    say = ABSENCE_ACTIONS
    action = F.when(F.col("chronic_absence_flag"), say["flag"]).when(s > 50, say["high"]).when(s > 30, say["medium"]).otherwise(say["low"])
    return out.withColumns({"risk_level": level, "recommended_action": action})


def chronic_absenteeism_risk(students: DataFrame, windows: DataFrame, key: str = "student_key", short: str = "30d", long: str = "90d") -> DataFrame:
    """Composite absenteeism risk of each student; ``windows`` come from ``student_windows``."""
    rows = students.join(windows.select(key, F.col(f"w_{short}").alias("m"), F.col(f"w_{long}").alias("q")), key, "left")
    value = lambda c, other: F.coalesce(F.col(c).cast("double"), F.lit(float(other)))
    rows = rows.select(
        *students.columns,
        value("m.attendance_rate", 100).alias("attendance_rate_30d"),
        value("m.unexcused_absence_rate", 0).alias("unexcused_absence_rate_30d"),
        F.coalesce("m.discipline_incidents_in_window", F.lit(0)).cast("long").alias("discipline_incidents_30d"),
        value("m.absence_discipline_correlation_score", 0).alias("absence_discipline_correlation_score"),
        value("q.attendance_rate", 100).alias("attendance_rate_90d"),
        F.coalesce("q.pattern_direction", F.lit("stable")).alias("attendance_trend_90d"),
    )
    away = F.lit(100.0) - F.col("attendance_rate_30d")
    raw = (
        away * 0.4
        + F.least(F.col("unexcused_absence_rate_30d") / 15.0 * 100, F.lit(100.0)) * 0.2
        + F.least(F.col("discipline_incidents_30d") * F.lit(5.0), F.lit(100.0)) * 0.2
        + F.when(F.col("attendance_trend_90d") == "declining", 100.0).otherwise(0.0) * 0.1
        + F.least(F.col("absence_discipline_correlation_score") * 10, F.lit(100.0)) * 0.1
    )
    score = rnd(F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0)), 1)
    rows = rows.withColumns({"chronic_absence_flag": F.when(away >= 10, 1).otherwise(0).cast("long"), "chronic_absenteeism_risk_score": score})
    return rows.withColumn("risk_level", bands(F.col("chronic_absenteeism_risk_score"), [(70, "Critical"), (50, "High"), (30, "Medium")], "Low"))


def wellbeing_profiles(students: DataFrame, windows: DataFrame, discipline: DataFrame, gpa: DataFrame, key: str = "student_key", window: str = "30d") -> DataFrame:
    """Attendance, discipline and academic risk of each student, and their compound.

    ``windows`` come from ``student_windows``, incidents from ``discipline_windows``, which hold students without school days too.
    """
    rows = students.join(windows.select(key, F.col(f"w_{window}.attendance_rate").alias("rate")), key, "left")
    rows = rows.join(discipline.where(F.col("window_type") == window).select(key, "incident_count"), key, "left").join(gpa.select(key, "avg_gpa"), key, "left")
    points = F.coalesce("avg_gpa", F.lit(2.0))
    away = F.least(F.lit(100.0) - F.coalesce("rate", F.lit(100.0)), F.lit(100.0))
    behaviour = F.least(F.coalesce("incident_count", F.lit(0)) * F.lit(10.0), F.lit(100.0))
    one = lambda c: F.when(c, 1).otherwise(0)
    scored = rows.select(
        *students.columns,
        rnd(away, 1).alias("attendance_risk_score"),
        rnd(behaviour, 1).alias("discipline_risk_score"),
        F.when(points < 1.5, 100.0).when(points < 2, 70.0).when(points < 2.5, 40.0).otherwise(10.0).alias("academic_risk_score"),
        (one(away > 50) + one(behaviour > 50) + one(points < 2)).cast("long").alias("high_risk_domain_count"),
    )
    a, d, g, n = (F.col(c) for c in ("attendance_risk_score", "discipline_risk_score", "academic_risk_score", "high_risk_domain_count"))
    score = rnd((a + d + g) / 3.0 * (F.lit(1.0) + F.greatest(n - 1, F.lit(0)) * F.lit(0.25)), 1)
    scored = scored.withColumn("wellbeing_risk_score", score)
    s = F.col("wellbeing_risk_score")
    level = F.when(s <= 30, "Low").when(s <= 60, "Moderate").when(s <= 80, "High").otherwise("Critical")
    concern = F.when(n >= 2, "Multi-factor").when((a > d) & (a > g), "Attendance").when(d > g, "Behavior").otherwise("Academic")
    return scored.withColumns({"wellbeing_risk_level": level, "primary_concern": concern})
