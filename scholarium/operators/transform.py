"""Transformations: missing values, scaling, JSON, periods, pseudonyms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.functions.expr import hash_pii, ratio, rnd, week_of_year


def forward_fill(rows: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Nulls take the last value before them, within ``keys``."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in cols})


def handle_missing(rows: DataFrame, how: str, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    if how == "drop":
        return rows.na.drop()
    if how == "forward_fill":
        rest = [c for c in rows.columns if c not in {*(keys or []), *(order or [])}]
        return forward_fill(rows, keys or [], order or [], rest)
    raise ValueError(f"unknown way {how}")


def normalize_numeric(rows: DataFrame, cols: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Min-max scaling; a constant column becomes ``low``."""
    ends = rows.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    out = rows.crossJoin(F.broadcast(ends))  # one row

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        return F.when(F.col(c).isNull(), None).when(hi == lo, F.lit(low)).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0)) * F.lit(high - low) + F.lit(low))

    return out.withColumns({c: scaled(c) for c in cols}).select(*rows.columns)


def normalize_names(rows: DataFrame) -> DataFrame:
    """Lower case; space, dash and dot become underscores."""
    return rows.toDF(*[re.sub(r"[ .\-]", "_", c.lower()) for c in rows.columns])


def flatten_struct(rows: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as columns ``a_b``; arrays stay."""

    def fields(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += fields(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(sep.join(here)))
        return out

    return rows.select(*fields(rows.schema, ()))


def flatten_json(rows: DataFrame, col: str, schema: T.StructType | str, sep: str = "_") -> DataFrame:
    """The JSON of ``col`` as columns with its name in front; ``col`` itself goes."""
    parsed = rows.withColumn(col, F.from_json(col, schema))
    return flatten_struct(parsed, sep)


def period(date: Column, unit: str) -> Column:
    if unit == "day":
        return F.date_format(date, "yyyy-MM-dd")
    if unit == "week":
        return F.concat(F.year(date).cast("string"), F.lit("-W"), F.lpad(week_of_year(date).cast("string"), 2, "0"))
    if unit == "month":
        return F.date_format(date, "yyyy-MM")
    if unit == "quarter":
        return F.concat(F.year(date).cast("string"), F.lit("-Q"), F.quarter(date).cast("string"))
    if unit == "year":
        return F.year(date).cast("string")
    raise ValueError(f"unknown period {unit}")


def engagement(rows: DataFrame, unit: str, key: str, date: str, duration: str) -> DataFrame:
    return rows.groupBy(key, period(F.col(date), unit).alias("period")).agg(F.count(F.lit(1)).alias("interactions"), rnd(F.avg(duration), 4).alias("avg_duration"))


def attendance_rate(rows: DataFrame, key: str, date: str, present: Column) -> DataFrame:
    out = rows.groupBy(key).agg(F.count_distinct(date).alias("total_days"), F.sum(F.when(present, 1).otherwise(0)).alias("present_days"))
    out = out.withColumn("attendance_rate", rnd(ratio(F.col("present_days"), F.col("total_days")), 3))
    return out.withColumn("is_chronic", F.col("attendance_rate") < 0.9)


def course_completion(rows: DataFrame, key: str, course: str, done: Column) -> DataFrame:
    out = rows.groupBy(key).agg(
        F.count_distinct(course).alias("courses"),
        F.sum(F.when(done, 1).otherwise(0)).alias("completed"),
        F.sum(F.when(done, 0).otherwise(1)).alias("in_progress"),
    )
    return out.withColumn("completion_rate", rnd(ratio(F.col("completed"), F.col("courses")), 3))


def auto_rule(column: str) -> str | None:
    """The rule for a column by its name: ids are hashed, names and contacts masked."""
    name = column.lower()
    if re.search(r"(^|_)(id|ssn)$|ssn", name):
        return "hash"
    if re.search(r"name|address|phone|email", name):
        return "mask"
    return None


def pseudonymize(rows: DataFrame, salt: str, rules: dict[str, str] | None = None) -> DataFrame:
    """Hash (16 hex digits) or mask (stars of the same length) by ``rules``, or by the columns' names."""
    rules = rules if rules is not None else {c: r for c in rows.columns if (r := auto_rule(c))}
    for c, rule in rules.items():
        if rule == "hash":
            rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), F.substring(hash_pii(c, salt), 1, 16)))
        elif rule == "mask":
            rows = rows.withColumn(c, F.repeat(F.lit("*"), F.length(F.col(c).cast("string"))))
        elif rule != "none":
            raise ValueError(f"unknown rule {rule}")
    return rows


def pseudonymize_lookup(rows: DataFrame, col: str, salt: str) -> tuple[DataFrame, DataFrame]:
    """Rows with ``<col>_hashed`` in place of ``col``, and the lookup table."""
    hashed = rows.withColumn(f"{col}_hashed", hash_pii(col, salt))
    return hashed.drop(col), hashed.select(f"{col}_hashed", col).distinct()


def json_object(rows: DataFrame, key: str, value: Column, by: list[str] | None = None) -> DataFrame:
    """One JSON object per group of ``by`` (or of all rows): ``value``, an aggregate, by ``key``, keys ascending; null keys are left out.

    Values are aggregated by key first, so an object is built from one entry a
    key, however many rows there are; an object must fit in a row.
    """
    by = by or []
    entries = rows.where(F.col(key).isNotNull()).groupBy(*by, key).agg(value.alias("_value"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_value").alias("v"))))
    whole = entries.groupBy(*by).agg(pairs.alias("_pairs"))
    return whole.select(*by, F.to_json(F.map_from_entries(F.transform("_pairs", lambda p: F.struct(p["k"].cast("string"), p["v"])))).alias("json"))


def district_summary(students: DataFrame, attendance: DataFrame, courses: DataFrame, enrollment: DataFrame, key: str = "student_key") -> DataFrame:
    """One row for a district: students by status, grade and programme, mean grade and attendance, courses, enrollments.

    ``students`` has status, grade, sped, ell, frl and gpa; ``attendance`` has
    attendance_rate and chronic; ``courses`` course; ``enrollment`` enrollment_id.
    A student counts once for each status and programme it has anywhere.  Each
    table is read once for all its figures.
    """
    number = lambda flag: F.sum(F.when(flag, 1).otherwise(0)).cast("long")
    kinds = {f"{s.lower()}_students": F.col("status") == s for s in ("Active", "Graduated", "Withdrawn")}
    kinds |= {"special_ed_count": F.col("sped"), "english_learner_count": F.col("ell"), "frpl_count": F.col("frl")}
    own = students.groupBy(key).agg(*(F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in kinds.items()), F.sum(F.round(F.col("gpa") * 100).cast("long")).alias("_sum"), F.count("gpa").alias("_n"))
    people = own.agg(*(number(F.col(n)).alias(n) for n in kinds), rnd(ratio(F.sum("_sum"), F.sum("_n") * 100), 2).alias("district_avg_gpa"))
    grades = json_object(students, "grade", F.count_distinct(key)).withColumnRenamed("json", "students_by_grade")
    days = attendance.groupBy(key).agg(F.max(F.coalesce("chronic", F.lit(False))).alias("_chronic"), F.sum(F.round(F.col("attendance_rate") * 10_000).cast("long")).alias("_sum"), F.count("attendance_rate").alias("_n"))
    present = days.agg(rnd(ratio(F.sum("_sum"), F.sum("_n") * 10_000), 4).alias("district_avg_attendance_rate"), number(F.col("_chronic")).alias("chronically_absent_count"))
    total = lambda df, c, o: df.agg(F.count_distinct(c).alias(o))
    # one row each
    out = people.join(grades, how="left").crossJoin(present)
    return out.crossJoin(total(courses, "course", "total_courses")).crossJoin(total(enrollment, "enrollment_id", "total_enrollments"))
