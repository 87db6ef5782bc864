"""Delimited files to Parquet with a check of what was written.

Rows and a checksum are counted while the files are written, by ``observe``, so
the source is read once.  The files are then read back, and count and checksum
of what they hold are compared.  The checksum is the sum of a 64-bit hash of
each row, so it depends neither on the order of rows nor on their files.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarium.sources.files import read_delimited


class Mismatch(RuntimeError):
    """What was read back is not what was written."""


@dataclass(frozen=True)
class Report:
    path: str
    rows: int
    checksum: int
    bytes_in: int
    bytes_out: int

    @property
    def ratio(self) -> float | None:
        """How many bytes of input each byte of output stands for."""
        return round(self.bytes_in / self.bytes_out, 2) if self.bytes_out else None

    def as_dict(self) -> dict:
        return asdict(self) | {"ratio": self.ratio}


def _sums(columns: list[str]) -> list:
    # names beside the values: a value that moves to another column changes the sum
    cells = [x for c in sorted(columns) for x in (F.lit(c), F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*cells).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("checksum")]


def size_of(spark: SparkSession, path: str | list[str]) -> int:
    """Bytes of the files under a path; reads their names and sizes only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("path not like '%/\\\\_SUCCESS' and path not like '%.crc'").agg(F.sum("length")).first()[0] or 0


def measure(spark: SparkSession, path: str, schema: T.StructType) -> tuple[int, int]:
    """Rows and checksum of Parquet files."""
    rows = spark.read.schema(schema).parquet(path)
    r = rows.agg(*_sums(rows.columns)).first()
    return r["rows"], int(r["checksum"])


def verify(spark: SparkSession, report: Report, schema: T.StructType) -> None:
    """Raises ``Mismatch`` if the files no longer hold what the report says, or can't be read."""
    try:
        found = measure(spark, report.path, schema)
    except Exception as e:
        raise Mismatch(f"{report.path} can't be read: {str(e).splitlines()[0]}") from e
    if found != (report.rows, report.checksum):
        raise Mismatch(f"{report.path}: wrote {report.rows} rows with checksum {report.checksum}, read {found[0]} with {found[1]}")


def write_checked(rows: DataFrame, path: str, partition_by: list[str] | None = None, bytes_in: int = 0, level: int = 5) -> Report:
    """Writes zstd Parquet, reads it back and compares; no rows give files of no rows."""
    spark = rows.sparkSession
    seen = Observation()
    writer = rows.observe(seen, *_sums(rows.columns)).write.mode("overwrite").option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level))
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    got = seen.get
    report = Report(path, got["rows"], int(got["checksum"]), bytes_in, size_of(spark, path))
    if report.rows or not partition_by:  # partitions of no rows have no files to read
        verify(spark, report, rows.schema)
    return report


def convert(spark: SparkSession, source: str | list[str], path: str, sep: str = ",", encoding: str = "UTF-8", year: str | None = None) -> Report:
    """Delimited text to Parquet; with ``year``, a pattern with one group, by the year in each file's name (else 'unknown')."""
    rows = read_delimited(spark, source, sep, encoding, keep_marks=True)
    if year is not None:
        re.compile(year)
        found = F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), year, 1)
        rows = rows.withColumn("year", F.when(found == "", "unknown").otherwise(found))
    return write_checked(rows, path, ["year"] if year is not None else None, size_of(spark, source))
