"""The driver's tables seen as students, attendance, incidents, grades and schools; as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scholarium.functions.expr import grade_points


#: Schemas by path: reading one from the files' footers is a job of its own, and a query may name a table many times.
_SCHEMAS: dict[str, StructType] = {}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.col("event_type") == "error"
    return t(spark, sf_dir, "events").select(
        F.col("user_id").alias("student_key"),
        F.to_date("ts").alias("d"),
        error.alias("absent"),
        (error & (F.col("value") > 100)).alias("unexcused"),
        (F.col("event_type") == "view").alias("tardy"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "events").where("event_type = 'error' and value > 50")
    return rows.select(F.col("user_id").alias("student_key"), F.to_date("ts").alias("d"), (F.col("value") > 150).alias("serious"))


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return t(spark, sf_dir, "customer").select(
        key.alias("student_key"),
        F.col("c_mktsegment").alias("ethnicity"),
        F.col("c_nationkey").cast("long").alias("school"),
        (F.col("c_acctbal") < 0).alias("frl"),
        (key % 20 == 0).alias("sped"),
        (key % 7 == 0).alias("ell"),
        (key % 12 + 1).alias("grade"),
        (key % 14 + 5).alias("age"),
        (key % 9 != 0).alias("active"),
    )


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    letter = F.element_at(F.array(*map(F.lit, ["A", "B+", "C", "D", "F"])), F.substring("o_orderpriority", 1, 1).cast("int"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("student_key"),
        (F.col("l_partkey") % 50).alias("course"),
        F.year("o_orderdate").cast("long").alias("term"),
        F.to_date("o_orderdate").alias("d"),
        letter.alias("letter"),
    )
    rows = rows.withColumn("points", grade_points("letter"))
    return rows.withColumn("passing", F.col("letter").isin("A", "B+", "C", "D"))


DAILY = """daily AS (SELECT user_id AS student_key, ts::DATE AS d, event_type = 'error' AS absent,
  event_type = 'error' AND value > 100 AS unexcused, event_type = 'view' AS tardy FROM events)"""
INCIDENTS = """incidents AS (SELECT user_id AS student_key, ts::DATE AS d, value > 150 AS serious FROM events
  WHERE event_type = 'error' AND value > 50)"""
STUDENTS = """students AS (SELECT c_custkey AS student_key, c_mktsegment AS ethnicity, c_nationkey::BIGINT AS school, c_acctbal < 0 AS frl,
  c_custkey % 20 = 0 AS sped, c_custkey % 7 = 0 AS ell, c_custkey % 12 + 1 AS grade, c_custkey % 14 + 5 AS age,
  c_custkey % 9 <> 0 AS active FROM customer)"""
GRADES = """grades AS (SELECT o_custkey AS student_key, l_partkey % 50 AS course, year(o_orderdate)::BIGINT AS term, o_orderdate::DATE AS d,
  (['A', 'B+', 'C', 'D', 'F'])[o_orderpriority[1]::INT] AS letter,
  ([4.0, 3.3, 2.0, 1.0, 0.0])[o_orderpriority[1]::INT]::DOUBLE AS points, o_orderpriority[1]::INT < 5 AS passing
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def r(x: str, n: int) -> str:
    """SQL for rounding half away from zero on the binary value."""
    p = f"{10**n}.0::DOUBLE"
    return f"(sign(({x})::DOUBLE) * floor(abs(({x})::DOUBLE) * {p} + 0.5::DOUBLE) / {p})"


def pct(flag: str, n: int = 2) -> str:
    return r(f"100.0::DOUBLE * sum(CASE WHEN {flag} THEN 1 ELSE 0 END)::DOUBLE / nullif(count(*)::DOUBLE, 0)", n)


def count_if(flag: str) -> str:
    return f"sum(CASE WHEN {flag} THEN 1 ELSE 0 END)::BIGINT"


def mean_tenths(x: str = "points") -> str:
    return f"(sum(round(({x}) * 10)::BIGINT)::DOUBLE / (10 * count({x}))::DOUBLE)"


def mean_sql(x: str, digits: int) -> str:
    p = 10**digits
    return f"(sum(round(({x}) * {p})::BIGINT)::DOUBLE / nullif(({p} * count({x}))::DOUBLE, 0))"
