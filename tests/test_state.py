"""Staging of state files, dashboard exports, core facts and file sources, on rows written out by hand."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from scholarium.operators import core, state
from scholarium.sources import files


def rows(spark, *dicts):
    names = sorted({k for d in dicts for k in d})
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], ", ".join(f"`{n}` string" for n in names))


def test_chronic_absenteeism(spark):
    raw = rows(
        spark,
        {"academic_year": "2024-25", "aggregate_level": "S", "county_code": "1", "district_code": "611", "school_code": "13", "reporting_category": "GR46", "chronic_absenteeism_eligible_cumulative_enrollment": "10", "chronic_absenteeism_count": "3", "chronic_absenteeism_rate": "30.0"},
        {"academic_year": "2024-25", "aggregate_level": "T", "reporting_category": "RB", "chronic_absenteeism_eligible_cumulative_enrollment": "*", "chronic_absenteeism_count": "*", "chronic_absenteeism_rate": "*"},
    )
    a, b = sorted(state.stage(raw, "chronic_absenteeism").collect(), key=lambda r: r["aggregate_level"])
    assert a["cds_code"] == "01006110000013" and (a["eligible_enrollment"], a["chronic_absent_count"], a["chronic_absent_rate_pct"]) == (10, 3, 30.0)
    assert not a["is_suppressed"] and a["is_small_n"] and a["grade_level_group"] == "Grades 4-6" and a["aggregate_level_label"] == "School"
    assert b["is_suppressed"] and not b["is_small_n"] and b["chronic_absent_count"] is None and b["is_race_ethnicity_subgroup"] and b["cds_code"] == "0" * 14


@pytest.mark.parametrize("name", sorted(state.DOMAINS))
def test_every_domain_stages_and_has_an_empty_form(spark, name):
    d = state.DOMAINS[name]
    sources = {*state._pairs(d.counts).values(), *state._pairs(d.rates).values()}
    out = state.stage(rows(spark, dict.fromkeys(sources, "12.0")), d)
    got = out.collect()[0]
    assert all(got[c] == 12 for c in (*state._pairs(d.counts), *state._pairs(d.rates)))
    assert state.typed_empty(spark, d).schema.names == out.schema.names and state.typed_empty(spark, d).count() == 0


def test_years_and_forced_category(spark):
    frpm = state.stage(rows(spark, {"academic_year": "2023-2024", "enrollment_k_12x": "100"}), "frpm").collect()[0]
    assert frpm["academic_year"] == "2023-24" and frpm["reporting_category"] == "TA" and frpm["enrollment_k12"] == 100
    bom = state.stage(rows(spark, {"_academic_year": "2022-23", "cumulative_enrollment": "5"}), "enrollment").collect()[0]
    assert bom["academic_year"] == "2022-23" and bom["is_small_n"]


def test_caspp_rolls_grades_up(spark):
    base = {"county_code": "1", "district_code": "2", "school_code": "3", "student_group_id": "TA", "test_year": "2024", "test_type": "B"}
    raw = rows(spark, base | {"grade": "3", "students_tested": "10", "mean_scale_score": "2400"}, base | {"grade": "4", "students_tested": "20", "mean_scale_score": "2500"}, base | {"grade": "5", "students_tested": "*"})
    got = state.stage_caspp(raw).collect()
    assert len(got) == 1 and got[0]["students_tested"] == 30 and got[0]["mean_scale_score"] == 2450.0 and got[0]["students_enrolled"] is None


def test_schools_directory(spark):
    raw = rows(spark, {"CDSCode": "1", "StatusType": "Active", "OpenDate": "1990-07-01", "ClosedDate": "No Data", "Latitude": "37.5"}, {"CDSCode": "2", "StatusType": "Closed"})
    got = state.stage_schools(raw).collect()
    assert [(r["cds_code"], r["open_date"], r["closed_date"], r["latitude"]) for r in got] == [("1", datetime.date(1990, 7, 1), None, 37.5)]


@pytest.mark.parametrize("name", sorted(state.BOARDS))
def test_dashboard_exports(spark, name):
    raw = rows(spark, {"rtype": "S", "cds": "1", "color": "5", "statuslevel": "1", state.BOARDS[name].change_level: "3", "currnsizemet": "Y", "charter_flag": None, "currdenom": "40"}, {"rtype": "X", "cds": "2"})
    (got,) = state.dashboard_export(raw, name).collect()
    assert (got["performance_color"], got["status_level"], got["change_level"], got["curr_n_size_met"], got["is_charter"], got["curr_denominator"], got["indicator"]) == ("Blue", "Very Low", "Maintained", True, False, 40, name)


def test_core_facts(spark):
    raw = rows(spark, {"student_id": "1", "school_id": "9", "incident_id": "i", "incident_date": "2024-10-01", "severity": "High", "suspension_days": "2"}, {"student_id": "2", "incident_date": "", "severity": "odd", "suspension_days": "0"})
    raw = raw.withColumns({"incident_type": F.lit("x"), "resolution": F.lit("y")})
    got = {r["severity"]: r for r in core.fact_discipline(core.stage_discipline(raw), "salt").collect()}
    assert (got["High"]["suspension_flag"], got["High"]["serious_incident_flag"], got["High"]["incident_date"]) == (1, 1, datetime.date(2024, 10, 1))
    assert (got["Unknown"]["suspension_flag"], got["Unknown"]["serious_incident_flag"], got["Unknown"]["incident_date"]) == (0, 0, None)


def test_dim_students(spark):
    flags = ("special_education_flag", "section_504_flag", "free_reduced_lunch_flag", "homeless_flag")
    data = [("700", None, 9, "2020-01-01", None), ("201", "600", 12, "2020-01-01", "2021-01-01"), (None, "", 3, None, None), ("999", None, 10, None, None)]
    schema = "race_code_1 string, race_code_2 string, grade_level int, enrollment_date string, withdrawal_date string"
    hashed = spark.createDataFrame(data, schema).withColumns({c: F.to_date(c) for c in ("enrollment_date", "withdrawal_date")}).withColumns({f: F.lit(False) for f in flags}).withColumn("ell_status", F.lit("true"))
    got = core.dim_students(hashed, F.to_date(F.lit("2022-01-01"))).orderBy("grade_level").collect()
    assert [(r["primary_race"], r["is_multi_racial"], r["cohort"], r["enrollment_status"]) for r in got] == [
        ("Other/Unknown", False, "OTHER", "UNKNOWN"),
        ("White", False, "FRESHMAN", "ACTIVE"),
        ("Other/Unknown", False, "SOPHOMORE", "UNKNOWN"),
        ("Asian", True, "SENIOR", "WITHDRAWN"),
    ]
    assert all(r["language_support_needed"] for r in got)


def test_delimited_files_with_drifting_headers(spark, tmp_path):
    (tmp_path / "a23.txt").write_bytes("\ufeffAcademic Year\tCount\r\n2022-23\t*\r\n2022-23\t 7 \r\n".encode())
    (tmp_path / "b24.txt").write_bytes("Academic Year\tCount\tRate\n2023-24\t8\t1.5\n".encode())
    (tmp_path / "b24 (1).txt").write_bytes(b"Academic Year\tCount\n2023-24\t9\n")
    got = files.union_drifting(spark, [f"file://{tmp_path}/{n}" for n in ("b24.txt", "a23.txt", "b24 (1).txt")], "x")
    assert got.columns == ["Academic Year", "Count", "_source_file", "_domain", "Rate"]
    seen = sorted((r["Academic Year"], r["Count"], r["Rate"], r["_source_file"]) for r in got.where("Count is not null").collect())
    assert seen == [("2022-23", "7", None, "a23.txt"), ("2023-24", "8", "1.5", "b24.txt")]
    kept = files.read_delimited(spark, f"file://{tmp_path}/a23.txt", keep_marks=True)
    assert [r["Count"].strip() for r in kept.collect()] == ["*", "7"]


def test_mapped_and_exported(spark, tmp_path):
    raw = spark.createDataFrame([("1", "N/A"), ("2", "x")], "a string, b string")
    got = files.mapped(raw, {"a": "id", "b": "name", "NULL_1": "none"}, {"id": "long"}).withColumn("name", files.nullify(F.col("name")))
    assert sorted(map(tuple, got.collect())) == [(1, None, None), (2, "x", None)]
    assert files.export_parquet(got, f"file://{tmp_path}/out")["rows"] == 2
    assert files.export_parquet(got.where("false"), f"file://{tmp_path}/none")["status"] == "skipped"
    got.createOrReplaceTempView("rows_to_export")
    assert files.export_views(spark, ["rows_to_export", "other"], f"file://{tmp_path}/v", only="rows", dry_run=True) == [{"path": f"file://{tmp_path}/v/rows_to_export", "status": "planned"}]
    assert files.since(got, "id", 1).count() == 1 and files.typed_empty(spark, "a long").count() == 0
    assert files.header_row([["", None], ["a", "b", "c"]]) == 1
