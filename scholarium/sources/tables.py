"""Typed readers, views over Parquet folders, analyzed tables and small exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.sources.files import MISSING, mapped, nullify, strip_bom


def _schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_typed(spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",", nulls: list[str] = MISSING, encoding: str = "UTF-8") -> DataFrame:
    """A delimited file with a header under a fixed schema, by the columns' names, whatever their order.

    Nothing is inferred.  Cells that hold one of ``nulls``, or that are no value
    of their type, are null; columns of the schema that a file lacks are null,
    others are left out.
    """
    schema = _schema(schema)
    rows = spark.read.option("sep", sep).option("encoding", encoding).option("header", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[strip_bom(c) for c in rows.columns])
    held = {c.lower(): c for c in rows.columns}

    def cell(f: T.StructField):
        if f.name.lower() not in held:
            return F.lit(None).cast(f.dataType)
        c = nullify(F.trim(F.col(f"`{held[f.name.lower()]}`")), nulls)
        return c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)

    return rows.select(*(cell(f).alias(f.name) for f in schema))


def read_entity(spark: SparkSession, folder: str, entity: str) -> DataFrame:
    """An entity's files under a folder: ``entity*.csv`` as text columns, or else ``entity*.json``, one object a line."""
    for kind, reader in (("csv", lambda r: r.option("header", True).csv), ("json", lambda r: r.json)):
        pattern = f"{entity}*.{kind}"
        if not spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").isEmpty():
            return reader(spark.read.option("pathGlobFilter", pattern))(folder)
    raise FileNotFoundError(f"no {entity}*.csv or {entity}*.json under {folder}")


def parquet_view(spark: SparkSession, base: str, name: str, mapping: dict[str, str] | None = None, kinds: dict[str, str] | None = None) -> DataFrame:
    """A temporary view over a Parquet folder with its ``key=value`` partitions, projected by ``mapping`` (source to target) if given.

    A filter on a partition column still prunes folders, and the projection the columns read.
    """
    rows = spark.read.option("mergeSchema", True).parquet(base)
    rows = mapped(rows, mapping, kinds) if mapping else rows
    rows.createOrReplaceTempView(name)
    return rows


def analyzed_table(rows: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes a table of the session's catalog and its statistics, which the optimizer then uses for joins."""
    spark = rows.sparkSession
    writer = rows.write.mode("overwrite").format("parquet")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return spark.table(name)


def export_csv(rows: DataFrame, path: str) -> None:
    """A result as quoted CSV with a header; each task writes what it has."""
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def distinct_sample(rows: DataFrame, column: str, n: int = 5) -> DataFrame:
    """The ``n`` smallest distinct values, so that a sample is always the same; nulls last."""
    return rows.select(column).distinct().orderBy(F.col(column).asc_nulls_last()).limit(n)
