"""The catalogue of state file domains, and one loader for all of them.

A domain's files differ from year to year in their columns.  Files with the same
header are read together, one scan per shape of header; the shapes are united by
name, absent columns null.
"""

from __future__ import annotations

import fnmatch
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.sources.archives import read_workbooks, read_zip
from scholarium.sources.files import clean_cell, strip_bom


@dataclass(frozen=True)
class FileDomain:
    pattern: str
    kind: str = "txt"
    sep: str = "\t"
    sheet: str | None = None


# File patterns of the domains.
CATALOG = {
    "chronic_absenteeism": FileDomain("chronicabsenteeism*.txt"),
    "absenteeism_reason": FileDomain("absenteeismreason*.txt"),
    "cumulative_enrollment": FileDomain("cenroll*.txt"),
    "census_enrollment_rates": FileDomain("censusenrollratesdownload*.txt"),
    "chronic_absenteeism_dashboard": FileDomain("chronicdownload*.txt"),
    "suspension": FileDomain("suspension*.txt"),
    "suspension_dashboard": FileDomain("suspdownload*.txt"),
    "expulsion": FileDomain("expulsion*.txt"),
    "ela_dashboard": FileDomain("eladownload*.txt"),
    "elpac_dashboard": FileDomain("elpidownload*.txt"),
    "sbac_caaspp": FileDomain("sb_ca*_all_csv_v1.zip", "zip", "^"),
    "homeless_enrollment": FileDomain("hse*.txt"),
    "frpm": FileDomain("frpm*.xlsx", "xlsx", sheet="School-Level"),
    "upc": FileDomain("cupc*.xlsx", "xlsx", sheet="School-Level"),
    "restraint_seclusion": FileDomain("rsddata*.xlsx", "xlsx"),
    "school_directory": FileDomain("schldir.txt"),
    "cbedsora": FileDomain("cbedsora*.txt"),
    "enrollment_by_grade": FileDomain("enrbygrade*.txt"),
    "enrollment_by_subgroup": FileDomain("enrbysubgrp*.txt"),
    "class_assignment": FileDomain("classassign*.txt"),
    "teacher_misassignment": FileDomain("teachermisassign*.txt"),
    "teacher_out_of_field": FileDomain("teacheroutoffield*.txt"),
    "teacher_prep": FileDomain("teacherprep*.txt"),
}


def discover(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Paths of a folder's files that match, by name; copies like 'name (1).txt' are left out.  Reads names only."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").collect()
    names = {r["path"].rsplit("/", 1)[-1]: r["path"] for r in listed}
    return [names[n] for n in sorted(names) if "(" not in n and fnmatch.fnmatchcase(n, pattern)]


def header(spark: SparkSession, path: str, sep: str, encoding: str = "ISO-8859-1") -> tuple[str, ...]:
    """The names in a file's first line, without a byte order mark; reads no further than the first block."""
    first = spark.read.schema("line string").option("sep", "\u0001").option("quote", "").option("encoding", encoding).csv(path).head()
    names = (first["line"] or "").rstrip("\r").split(sep) if first else []
    return tuple(strip_bom(n) if i == 0 else n for i, n in enumerate(names))


def read_drifting(spark: SparkSession, paths: list[str], sep: str = "\t", encoding: str = "ISO-8859-1") -> DataFrame:
    """Delimited files as text columns under all their headers' names, in first-seen order, cells cleaned, and ``_source_file``.

    Of a name that stands twice in a header, the first column counts; a column
    without a name is left out.
    """
    shapes: dict[tuple[str, ...], list[str]] = {}
    for p in paths:
        shapes.setdefault(header(spark, p, sep, encoding), []).append(p)
    parts = []
    for names, files in shapes.items():
        if not any(names):
            continue
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        rows = spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("header", True).option("enforceSchema", True).option("escape", '"').csv(files)
        first = {n: i for i, n in reversed(list(enumerate(names))) if n}
        parts.append(rows.select(*[clean_cell(F.col(f"c{i}")).alias(n) for n, i in sorted(first.items(), key=lambda x: x[1])], F.col("_metadata.file_name").alias("_source_file")))
    if not parts:
        return spark.createDataFrame([], "_source_file string")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.select(*[f"`{c}`" for c in rows.columns if c != "_source_file"], "_source_file")


def load_domain(spark: SparkSession, folder: str, name: str, year: str | None = None) -> DataFrame:
    """All files of a domain under ``folder`` as one table, with ``_source_file``, ``_domain`` and ``_loaded_at``.

    ``year`` (two digits, as the files are named) keeps to that year's files;
    others are never listed, let alone read.  No file gives an empty table.
    """
    if name not in CATALOG:
        raise KeyError(f"no domain {name}; there are {', '.join(CATALOG)}")
    d = CATALOG[name]
    if year is not None and not (len(year) == 2 and year.isdigit()):
        raise ValueError("a year is two digits")
    paths = discover(spark, folder, d.pattern if year is None else d.pattern.replace("*", f"{year}*", 1))
    if not paths:
        rows = spark.createDataFrame([], "_source_file string")
    elif d.kind == "txt":
        rows = read_drifting(spark, paths, d.sep)
    elif d.kind == "zip":
        rows = read_zip(spark, paths, d.sep)
    else:
        rows = read_workbooks(spark, paths, d.sheet)
    return rows.withColumn("_domain", F.lit(name)).withColumn("_loaded_at", F.current_timestamp())


def row_counts(loaded: DataFrame) -> DataFrame:
    """Rows that each file gave."""
    return loaded.groupBy("_domain", "_source_file").agg(F.count(F.lit(1)).alias("rows"))
