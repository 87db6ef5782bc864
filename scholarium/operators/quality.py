"""Data-quality checks as DataFrames of violations, profiles and freshness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarium.functions.expr import ratio, rnd


def not_null(rows: DataFrame, col: str) -> DataFrame:
    return rows.where(F.col(col).isNull())


def unique_combination(rows: DataFrame, cols: list[str]) -> DataFrame:
    return rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def accepted_values(rows: DataFrame, col: str, values: list) -> DataFrame:
    return rows.where(F.col(col).isNotNull() & ~F.col(col).isin(values)).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def relationships(child: DataFrame, col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Rows whose key has no parent; null keys are not counted."""
    return child.where(F.col(col).isNotNull()).join(parent.select(F.col(parent_col).alias(col)).distinct(), col, "left_anti")


def out_of_range(rows: DataFrame, col: str, low: float, high: float) -> DataFrame:
    return rows.where(~F.col(col).between(low, high))


def sanitize_range(col: Column, low: float, high: float, digits: int = 2) -> Column:
    """The rounded value where it lies in the range, else null."""
    return F.when(col.between(low, high), rnd(col, digits))


def scorecard(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations and rate of each rule (true where a row breaks it), in one pass."""
    one = rows.agg(
        F.count(F.lit(1)).alias("_all"),
        *[F.sum(F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0)).alias(k) for k, c in rules.items()],
    )
    parts = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).cast("long").alias("violations")) for k in rules])
    out = one.select("_all", F.inline(parts))
    return out.select("rule", F.col("_all").alias("rows_checked"), "violations", rnd(ratio(F.col("violations"), F.col("_all"), 100.0), 2).alias("pct"))


def profile(rows: DataFrame, cols: list[str], high: float = 10.0) -> DataFrame:
    """Nulls, distinct values, least and greatest of each column as text; one row per column, one scan.

    Cells become (column, value) pairs, counted before they are shuffled; all
    figures follow from the distinct pairs, so no task holds a column's values.
    """
    kinds = dict(rows.dtypes)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])
    pairs = rows.select(F.explode(cells).alias("x")).groupBy("x.column", "x.v").agg(F.count(F.lit(1)).alias("n"))
    typed = lambda c: F.when(F.col("column") == c, F.col("v").cast(kinds[c]))
    ends = [f(typed(c)).cast("string").alias(f"{o}_{i}") for i, c in enumerate(cols) for o, f in (("lo", F.min), ("hi", F.max))]
    by = pairs.groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("distinct_values"), *ends)
    own = lambda o: F.coalesce(*[F.col(f"{o}_{i}") for i in range(len(cols))])  # noqa: E731  a column has its own ends only
    empty = rows.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    out = empty.join(by, "column", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    pct = rnd(ratio(F.col("nulls"), F.col("rows"), 100.0), 2)
    out = out.select("column", zero("rows"), zero("nulls"), pct.alias("null_pct"), zero("distinct_values"), own("lo").alias("least"), own("hi").alias("greatest"))
    return out.withColumn("severity", F.when(F.col("null_pct") > high, "HIGH").otherwise("OK"))


def summaries(rows: DataFrame, ids: list[str] | None = None, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75), accuracy: int = 10_000) -> DataFrame:
    """One row per column from one scan: missing share, constant and all-null marks, and for numbers mean, deviation, ends and quantiles.

    Quantiles come from a mergeable sketch whose rank is off by one part in
    ``accuracy`` of the rows at most, so they are exact up to that many rows.
    Columns of ``ids`` are marked as having duplicates where their distinct
    values, by a sketch of 1 % error beyond a few thousand, are fewer than the
    filled cells by more than that error; ``unique_combination`` lists them
    exactly.
    """
    numbers = {c for c, kind in rows.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")}
    flat = [c for c, kind in rows.dtypes if not kind.startswith(("array", "map", "struct", "variant"))]

    def row(c: str) -> Column:
        x = F.col(f"`{c}`")
        none = F.lit(None).cast("double")
        value = x.cast("double")
        number = c in numbers
        same = F.coalesce(F.min(x) == F.max(x), F.lit(False)) if c in flat else F.lit(False)
        parts = {
            "column": F.lit(c),
            "rows": F.count(F.lit(1)),
            "missing": F.count(F.lit(1)) - F.count(x),
            "missing_pct": rnd(ratio(F.count(F.lit(1)) - F.count(x), F.count(F.lit(1)), 100.0), 2),
            "all_null": F.count(x) == 0,
            "constant": same,
            "mean": F.avg(value) if number else none,
            "deviation": F.stddev_samp(value) if number else none,
            "least": F.min(value) if number else none,
            "greatest": F.max(value) if number else none,
            "quantiles": F.percentile_approx(value, list(quantiles), accuracy) if number else F.lit(None).cast("array<double>"),
            "duplicated": F.approx_count_distinct(x, 0.01) < F.count(x) * 0.97 if c in (ids or ()) else F.lit(None).cast("boolean"),
        }
        return F.struct(*(v.alias(k) for k, v in parts.items()))

    one = rows.agg(*(row(c).alias(f"c{i}") for i, c in enumerate(rows.columns)))
    return one.select(F.inline(F.array(*[f"c{i}" for i in range(len(rows.columns))])))


def top_values(rows: DataFrame, col: str, k: int = 20) -> DataFrame:
    return rows.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(col).asc_nulls_last()).limit(k)


def row_count_anomaly(counts: DataFrame, n: str = "n", most: float = 0.5) -> DataFrame:
    """Groups whose count is more than ``most`` away from the mean of all."""
    mean = counts.agg(F.avg(n).alias("mean_count"))
    rows = counts.crossJoin(F.broadcast(mean))  # one row
    return rows.withColumn("mean_count", rnd("mean_count", 4)).withColumn("is_anomaly", F.abs(F.col(n) - F.col("mean_count")) > F.lit(most) * F.col("mean_count"))


def freshness(tables: dict[str, tuple[DataFrame, str]], as_of: Column, most_days: int) -> DataFrame:
    """Latest date of each table, its age in days, and whether it is stale."""
    parts = [df.agg(F.max(F.col(c)).cast("date").alias("latest")).select(F.lit(name).alias("table_name"), "latest") for name, (df, c) in tables.items()]
    out = reduce(DataFrame.unionByName, parts).withColumn("days_since", F.datediff(as_of, F.col("latest")).cast("long"))
    status = F.when(F.col("days_since").isNull() | (F.col("days_since") > most_days), "STALE").otherwise("FRESH")
    return out.select("table_name", F.col("latest").cast("string").alias("latest"), "days_since", status.alias("status"))


def gaps(rows: DataFrame, keys: list[str], date: str, most_days: int) -> DataFrame:
    """Pairs of neighbouring dates of a key that lie more than ``most_days`` apart."""
    from pyspark.sql import Window

    dates = rows.select(*keys, date).distinct()
    after = F.lead(date).over(Window.partitionBy(*keys).orderBy(date))
    out = dates.withColumn("next_date", after).withColumn("gap_days", F.datediff("next_date", date).cast("long"))
    return out.where(F.col("gap_days") > most_days)


def compare_schemas(before: DataFrame, after: DataFrame) -> dict[str, list[str]]:
    """Columns that a stage added, removed, hashed or masked."""
    a, b = set(before.columns), set(after.columns)
    return {
        "added": sorted(b - a),
        "removed": sorted(a - b),
        "hashed": sorted(c for c in b - a if c.endswith(("_hash", "_hashed"))),
        "masked": sorted(c for c in b - a if c.endswith("_masked")),
    }


def validate_schema(rows: DataFrame, expected: dict[str, str]) -> dict[str, list]:
    """Missing columns and type mismatches make a schema invalid; extra columns are warnings."""
    have = dict(rows.dtypes)
    return {
        "missing": [c for c in expected if c not in have],
        "mismatched": [(c, t, have[c]) for c, t in expected.items() if c in have and have[c] != t],
        "extra": [c for c in have if c not in expected],
    }
