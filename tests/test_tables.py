"""Typed readers, views, analyzed tables, the data dictionary."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scholarium.operators import metadata, quality, transform
from scholarium.sources import tables


def test_typed_reader_goes_by_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffcds,match,score,extra\n01,"x, ""y""",0.5,1\n02,NULL,no,2\nN/A,, 7 ,3\n')
    got = tables.read_typed(spark, str(tmp_path / "a.csv"), "score double, CDS string, match string, absent date")
    assert got.dtypes == [("score", "double"), ("CDS", "string"), ("match", "string"), ("absent", "date")]
    assert [tuple(r) for r in got.collect()] == [(0.5, "01", 'x, "y"', None), (None, "02", None, None), (7.0, None, None, None)]


def test_entities_by_folder(spark, tmp_path):
    (tmp_path / "students_1.csv").write_text("id,name\n1,a\n")
    (tmp_path / "students_2.csv").write_text("id,name\n2,b\n")
    (tmp_path / "courses.json").write_text('{"id": 1, "title": "x"}\n{"id": 2}\n')
    assert tables.read_entity(spark, str(tmp_path), "students").count() == 2
    assert {(r["id"], r["title"]) for r in tables.read_entity(spark, str(tmp_path), "courses").collect()} == {(1, "x"), (2, None)}
    with pytest.raises(FileNotFoundError):
        tables.read_entity(spark, str(tmp_path), "grades")


def test_view_prunes_partitions_and_columns(spark, tmp_path):
    rows = spark.range(10).select("id", (F.col("id") * 2).alias("x"), (F.col("id") % 2 + 2023).cast("int").alias("year"))
    rows.write.partitionBy("year").parquet(str(tmp_path / "t"))
    tables.parquet_view(spark, str(tmp_path / "t"), "raw_t", {"id": "student_id", "NULL_note": "note", "year": "school_year"}, {"student_id": "string"})
    seen = spark.sql("SELECT student_id, note FROM raw_t WHERE school_year = 2024")
    assert {tuple(r) for r in seen.collect()} == {(str(k), None) for k in (1, 3, 5, 7, 9)}
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_analyzed_table(spark):
    got = tables.analyzed_table(spark.range(100).select("id", (F.col("id") % 7).alias("k")), "analyzed_t")
    assert got.count() == 100
    stats = {r["info_name"]: r["info_value"] for r in spark.sql("DESCRIBE EXTENDED analyzed_t k").collect()}
    assert stats["distinct_count"] == "7" and stats["max"] == "6"
    checks = {r["table_name"]: (r["exists"], r["rows"], r["ok"]) for r in metadata.table_checks(spark, {"analyzed_t": 100, "nowhere": 1}).collect()}
    assert checks == {"analyzed_t": (True, 100, True), "nowhere": (False, 0, False)}


def test_csv_export_and_sample(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'a,"b"'), (1, "x\ny"), (2, "z"), (None, "n")], "k int, s string")
    tables.export_csv(rows, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert {r["s"] for r in back.collect()} == {'a,"b"', "x\ny", "z", "n"}
    assert [r["k"] for r in tables.distinct_sample(rows, "k", 2).collect()] == [1, 2] and tables.distinct_sample(rows, "k").count() == 3


def test_dictionary(spark):
    rows = spark.createDataFrame([("students", "id", "bigint", "Key | of <a> student", "hash"), ("students", "name", "string", "Name", "mask"), ("students", "grade", "int", None, None), ("courses", "id", "bigint", "Key", "")], "entity string, field string, type string, description string, privacy string")
    d = metadata.Dictionary.load(rows)
    assert d.entities() == ["courses", "students"] and d.privacy("students") == {"id": "hash", "name": "mask"} and d.descriptions("students")["grade"] == ""
    data = spark.createDataFrame([(1, "Ann", "9")], "id bigint, name string, grade string")
    assert quality.validate_schema(data, d.schema("students"))["mismatched"] == [("grade", "int", "string")]
    assert transform.pseudonymize(data, "salt", d.privacy("students")).first()["name"] == "***"
    assert "| id | bigint | Key \\| of <a> student | hash |" in d.markdown() and "Key | of &lt;a&gt; student" in d.html()
    with pytest.raises(ValueError, match="lacks"):
        metadata.Dictionary.load(rows.drop("privacy"))
    with pytest.raises(ValueError, match="more than 2"):
        metadata.Dictionary.load(rows, 2)
