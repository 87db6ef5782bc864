"""Delimited files: header repair, suppression marks, column union, typed-empty fallback; Parquet sinks."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks of a missing cell.
MISSING = ["", "NULL", "N/A", "NA", "None", " "]


def strip_bom(name: str) -> str:
    """A header without a byte order mark, read as UTF-8 or as Latin-1."""
    return re.sub("^(?:﻿|ï»¿)", "", name).strip()


def clean_cell(c: Column) -> Column:
    """Trimmed; empty and '*' become null."""
    t = F.trim(F.regexp_replace(c, "\r$", ""))
    return F.when(~t.isin("", "*"), t)


def nullify(c: Column, marks: list[str] = MISSING) -> Column:
    return F.when(~c.isin(marks), c)


def read_delimited(spark: SparkSession, path: str | list[str], sep: str = "\t", encoding: str = "ISO-8859-1", keep_marks: bool = False) -> DataFrame:
    """A delimited file as text columns, header repaired, cells cleaned unless ``keep_marks``."""
    rows = spark.read.option("sep", sep).option("encoding", encoding).option("header", True).csv(path)
    rows = rows.toDF(*[strip_bom(c) for c in rows.columns])
    return rows if keep_marks else rows.select(*[clean_cell(F.col(f"`{c}`")).alias(c) for c in rows.columns])


def union_drifting(spark: SparkSession, paths: list[str], domain: str, sep: str = "\t") -> DataFrame:
    """All files with all columns in first-seen order, absent ones null, and where each row came from."""
    parts = []
    for p in sorted(x for x in paths if "(" not in x.rsplit("/", 1)[-1]):
        part = read_delimited(spark, p, sep)
        parts.append(part.withColumn("_source_file", F.lit(p.rsplit("/", 1)[-1])).withColumn("_domain", F.lit(domain)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def header_row(rows: list[list], most: int = 5, least: int = 3) -> int:
    """The first of the first rows with enough filled cells; 0 if none."""
    return next((i for i, r in enumerate(rows[:most]) if sum(c not in (None, "") for c in r) >= least), 0)


def typed_empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def table_or_empty(spark: SparkSession, name: str, schema: T.StructType | str) -> DataFrame:
    return spark.table(name) if spark.catalog.tableExists(name) else typed_empty(spark, schema)


def mapped(rows: DataFrame, mapping: dict[str, str], kinds: dict[str, str] | None = None) -> DataFrame:
    """Source to target names; a source ``NULL_x`` gives nulls."""
    kinds = kinds or {}
    cast = lambda c, t: c.cast(kinds[t]) if t in kinds else c
    return rows.select(*[cast(F.lit(None).cast("string") if s.startswith("NULL_") else F.col(f"`{s}`"), t).alias(t) for s, t in mapping.items()])


def since(rows: DataFrame, column: str, mark) -> DataFrame:
    """Rows changed after ``mark``; the filter reaches the scan."""
    return rows.where(F.col(column) > F.lit(mark))


def export_parquet(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> dict:
    """Write zstd Parquet; nothing is written for no rows.  Returns a report."""
    if rows.isEmpty():
        return {"path": path, "rows": 0, "status": "skipped"}
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return {"path": path, "rows": rows.sparkSession.read.parquet(path).count(), "status": "written"}


def export_views(spark: SparkSession, views: list[str], folder: str, only: str = "", dry_run: bool = False) -> list[dict]:
    chosen = [v for v in views if only in v]
    return [{"path": f"{folder}/{v}", "status": "planned"} if dry_run else export_parquet(spark.table(v), f"{folder}/{v}") for v in chosen]
