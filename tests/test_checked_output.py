"""Checked conversion, anonymised exports, profiles, JSON aggregates and the core models on small tables."""

from __future__ import annotations

import datetime
import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scholarium.operators import anonymize, core, quality, transform
from scholarium.sources import convert


def test_conversion_checks_what_it_wrote(spark, tmp_path):
    for year in (2023, 2024):
        (tmp_path / f"grades_{year}.csv").write_text("id,name\n" + "".join(f"{k},n{k % 7}\n" for k in range(1000 + year)))
    out = str(tmp_path / "out")
    report = convert.convert(spark, [str(tmp_path / f"grades_{y}.csv") for y in (2023, 2024)], out, year=r"_([0-9]{4})\.csv$")
    assert report.rows == 2 * 1000 + 2023 + 2024 and report.bytes_in > report.bytes_out > 0 and report.as_dict()["ratio"] > 1
    assert {p.name for p in Path(out).glob("year=*")} == {"year=2023", "year=2024"}
    schema = spark.read.option("header", True).csv(str(tmp_path / "grades_2023.csv")).withColumn("year", F.lit("")).schema
    convert.verify(spark, report, schema)
    first = sorted(Path(out).rglob("*.parquet"))[0]
    kept = first.read_bytes()
    for damage in (kept[: len(kept) // 2], b""):
        first.write_bytes(damage)
        (first.parent / f".{first.name}.crc").unlink(missing_ok=True)
        with pytest.raises(convert.Mismatch):
            convert.verify(spark, report, schema)
    first.unlink()
    with pytest.raises(convert.Mismatch, match="rows"):
        convert.verify(spark, report, schema)


def test_checksum_sees_moved_values_and_not_order(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, None, "b"), (2, None, "b")], "k long, x string, y string")
    one = convert.write_checked(rows, str(tmp_path / "a"))
    two = convert.write_checked(rows.orderBy(F.desc("k")).repartition(3), str(tmp_path / "b"))
    assert (one.rows, one.checksum) == (two.rows, two.checksum)
    moved = rows.select("k", F.col("y").alias("x"), F.col("x").alias("y"))
    assert convert.write_checked(moved, str(tmp_path / "c")).checksum != one.checksum
    none = convert.write_checked(rows.limit(0), str(tmp_path / "d"))
    assert (none.rows, none.checksum) == (0, 0)


RULES = anonymize.Rules("salt one", "salt two")


def test_anonymised_tables_join_and_hold_no_id(spark, tmp_path):
    students = spark.createDataFrame([(" 100001 ", "Ann", "900001", "says 100001", " A "), ("100002", "Bob", "", None, "B"), (None, None, None, None, None)], "StudentID string, FirstName string, CounselorNumber string, Comment string, Grade string")
    grades = spark.createDataFrame([(100001, "900001", 4.0), (100002, "900001", 3.0)], "StudentID long, TeacherNumber string, gpa double").withColumn("UserCode7", F.lit("x"))
    manifest = anonymize.anonymize_tables({"students": students, "grades": grades}, str(tmp_path), RULES)
    assert manifest["clean"] and manifest["tables"]["students"]["dropped"] == ["FirstName"] and manifest["tables"]["grades"]["columns_out"] == 3
    assert json.loads(spark.read.text(f"{tmp_path}/manifest").first()[0]) == manifest
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("students", "grades"))
    joined = a.join(b, "StudentID").collect()
    assert sorted((r["Grade"], r["gpa"]) for r in joined) == [("A", 4.0), ("B", 3.0)]
    assert {r["StudentID"] for r in joined} == {hashlib.sha256(f"salt one:{i}".encode()).hexdigest()[:32] for i in ("100001", "100002")}
    assert joined[0]["TeacherNumber"] == hashlib.sha256(b"salt two:900001").hexdigest()[:32] and {r["Comment"] for r in a.collect()} == {""}
    assert sorted(r["StudentID"] for r in a.collect())[0] == ""


def test_leaks_are_reported(spark, tmp_path):
    rows = spark.createDataFrame([("100001", "call 100001 now", "100001"), ("100002", "fine", "7")], "StudentID string, Note string, Other string")
    manifest = anonymize.anonymize_tables({"t": rows}, str(tmp_path), RULES)
    assert not manifest["clean"] and manifest["tables"]["t"]["leaks"] == {"Note": 1, "Other": 1}
    with pytest.raises(ValueError, match="salts"):
        anonymize.Rules("same", "same")


def test_profile_reads_once(spark):
    rows = spark.createDataFrame([(1, "b", 2.5, None), (1, None, -1.0, None), (10, "a", None, None), (2, "a", 2.5, None)], "i long, s string, d double, n int")
    got = {r["column"]: tuple(r)[1:] for r in quality.profile(rows, rows.columns).collect()}
    assert got["i"] == (4, 0, 0.0, 3, "1", "10", "OK") and got["s"] == (4, 1, 25.0, 2, "a", "b", "HIGH")
    assert got["d"] == (4, 1, 25.0, 2, "-1.0", "2.5", "HIGH") and got["n"] == (4, 4, 100.0, 0, None, None, "HIGH")
    nothing = quality.profile(rows.limit(0), ["i", "s"]).collect()
    assert [tuple(r)[1:5] for r in nothing] == [(0, 0, None, 0)] * 2
    t = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert quality.profile(t, t.columns)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_summaries(spark):
    rows = spark.range(1000).select((F.col("id") % 500).alias("dup"), F.col("id"), F.lit("c").alias("same"), F.lit(None).cast("string").alias("none"), F.when(F.col("id") % 4 > 0, F.col("id").cast("double")).alias("x"))
    got = {r["column"]: r for r in quality.summaries(rows, ["dup", "id"]).collect()}
    assert got["dup"]["duplicated"] and not got["id"]["duplicated"] and got["same"]["constant"] and got["none"]["all_null"] and not got["none"]["constant"]
    assert got["x"]["missing"] == 250 and got["x"]["missing_pct"] == 25.0 and got["id"]["quantiles"] == [249, 499, 749] and got["id"]["mean"] == 499.5 and got["same"]["mean"] is None
    assert quality.summaries(rows)._jdf.queryExecution().executedPlan().toString().split("== Initial")[0].count("Range (") <= 1


def test_json_object(spark):
    rows = spark.createDataFrame([("x", 10, 1), ("x", 9, 1), ("x", 9, 2), ("y", None, 1), ("y", 3, 1)], "g string, k int, v int")
    assert {r["g"]: r["json"] for r in transform.json_object(rows, "k", F.sum("v"), ["g"]).collect()} == {"x": '{"9":3,"10":1}', "y": '{"3":1}'}
    assert transform.json_object(rows, "k", F.count(F.lit(1))).first()["json"] == '{"3":1,"9":2,"10":1}'



def test_core_models(spark):
    as_of = F.to_date(F.lit("2025-01-15"))
    raw = spark.createDataFrame(
        [("1", "Ann", "Lee", "2010-01-16", "F", "700", "9", "10", "True", "true", "false", "", None, "true", None, "2024-08-01"), ("2", "Bo", "Ng", "", "M", "200", "x", "10", "TRUE", None, "yes", "false", "true", "no", "S", "")],
        "student_id string, first_name string, last_name string, date_of_birth string, gender string, ethnicity string, grade_level string, school_id string, ell_status string, special_education string, free_reduced_lunch string, homeless string, foster_care string, section_504 string, home_language string, enrollment_date string",
    )
    a, b = core.stage_students(raw, as_of).orderBy("student_id_raw").collect()
    assert (a["age"], a["grade_level"], a["grade_level_category"], a["ell_status"], a["special_education_flag"], a["home_language"]) == (14, 9, "High", True, True, "E")
    assert (b["age"], b["grade_level"], b["grade_level_category"], b["ell_status"], b["free_reduced_lunch_flag"], b["home_language"], b["enrollment_date"]) == (None, None, "Unknown", False, True, "S", None)

    records = spark.createDataFrame([("1", "10", "alg", "s1", "t1", g, "90.5", "T1", "2024", f"r{k}") for k, g in enumerate(["A", "B", "C", "D", "A-", None])], "student_id string, school_id string, course_id string, section_id string, teacher_id string, grade string, score string, term string, school_year string, record_id string")
    staged = core.stage_academic_records(records)
    assert [(r["gpa_points"], r["is_passing"]) for r in staged.orderBy("academic_record_sk").collect()] == [(4.0, True), (3.0, True), (2.0, True), (1.0, True), (0.0, False), (0.0, False)]
    fact = core.fact_academic_records(staged, "s").collect()
    assert len({r["academic_record_sk"] for r in fact}) == 1 and fact[0]["student_id_hash"] == hashlib.sha256(b"1s").hexdigest() and "student_id_raw" not in fact[0].asDict()


def test_core_enrollment_programs_and_schools(spark):
    raw = spark.createDataFrame([("1", "10", "2024", "ACTIVE", "2024-08-01", "9"), ("2", "11", "2024", "GONE", "", None)], "student_id string, school_id string, school_year string, enrollment_status string, enrollment_date string, grade_level string")
    staged = core.stage_enrollment(raw)
    got = core.fact_enrollment(staged, "s", F.to_date(F.lit("2025-01-15"))).orderBy("school_id").collect()
    assert [(r["enrollment_status_derived"], r["grade_level"], r["enrollment_date"]) for r in got] == [("ACTIVE", 9, datetime.date(2024, 8, 1)), ("UNKNOWN", None, None)]
    left = core.fact_enrollment(staged.withColumn("withdrawal_date", F.to_date(F.lit("2025-01-01"))), "s", F.to_date(F.lit("2025-01-15")))
    assert {r["enrollment_status_derived"] for r in left.collect()} == {"WITHDRAWN"}

    programs = core.stage_programs(spark.createDataFrame([("1", "144", "2024-08-01", None), ("1", "127", "", "2024-12-01")], "student_id string, program_code string, participation_start_date string, participation_end_date string"))
    assert sorted((r["program_code"], r["participation_start_date"], r["is_currently_active"]) for r in programs.collect()) == [("127", None, False), ("144", datetime.date(2024, 8, 1), True)]

    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "school_id string")
    mapping = spark.createDataFrame([("10", "01")], "school_id string, cds_code string")
    assert sorted((r["school_id"], r["school_name"], r["cds_code"]) for r in core.dim_schools(ids("10", "10"), ids("11"), mapping).collect()) == [("10", "SCHOOL_10", "01"), ("11", "SCHOOL_11", None)]


def test_core_attendance_facts(spark):
    names = "student_id_raw string, academic_year string, school_id string, days_enrolled int, days_present int, days_absent int, days_tardy int, days_excused int, days_unexcused int"
    staged = spark.createDataFrame([(str(k), "2024", "10", 100 if k else 0, 90, 10, 1, 6, 4) for k in range(7)], names)
    fact = core.fact_attendance(staged, "s")
    assert fact.columns[0] == "student_id_hash" and fact.count() == 7 and "student_id_raw" not in fact.columns
    people = fact.select("student_id_hash").withColumn("grade_level", F.lit(9))
    (got,) = core.fact_attendance_daily(fact, people).collect()
    assert (got["total_students"], got["present_count"], got["attendance_rate"]) == (6, 540, 0.9)
    assert core.fact_attendance_daily(fact, people, k=7).count() == 0
