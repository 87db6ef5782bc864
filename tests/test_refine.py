"""Masks, refined tables and normal forms on rows written out by hand."""

from __future__ import annotations

import datetime
import hashlib

from pyspark.sql import functions as F

from scholarium.operators import normalize, refine


def test_masks(spark):
    rows = spark.createDataFrame([("ann@school.org", "555-123-4567", "Annabel"), ("a@b", "555-1234", "A"), ("nobody", "(555) 123 4567", ""), (None, None, None)], "e string, p string, n string")
    got = [tuple(r) for r in rows.select(refine.mask_email(F.col("e")), refine.mask_phone(F.col("p")), refine.mask_text(F.col("n"), 1)).collect()]
    assert got == [("an*@sc********", "555-123****", "A******"), ("*@*", "5*******", "*"), ("no****", "(55****", "*"), (None, None, None)]
    said = ["medical visit", "doctor appointment", "an appointment", "family trip", "other", "", None]
    reasons = spark.createDataFrame([(s,) for s in said], "s string").select(refine.reason_category(F.col("s"))).collect()
    assert [r[0] for r in reasons] == ["Health-related", "Health-related", "Medical appointment", "Family matter", "Absence notification", "Unknown", "Unknown"]


def test_students_from_raw_to_refined(spark):
    e = normalize.ENTITIES["students"]
    names = [*e.keys, *normalize.pairs(e.kept), *e.codes, *e.trimmed.split(), *(d for d, v in e.defaults.items() if isinstance(v, str))]
    values = {"student_id": "s1", "gender": "F", "ethnicity": "ZZ", "academic_program": None, "enrollment_status": "A", "first_name": "Anna", "last_name": None, "middle_name": " B ", "email": "ann@x.org"}
    raw = spark.createDataFrame([tuple(values.get(n) for n in names), tuple(None for _ in names)], ", ".join(f"{n} string" for n in names))
    raw = raw.withColumns({"grade_level": F.lit(13), "gpa": F.lit(3.456), "date_of_birth": F.lit("2010-02-03").cast("date"), "enrollment_date": F.lit("2020-09-01").cast("date"), "withdrawal_date": F.lit(None).cast("date")})
    raw = raw.withColumns({c: F.lit(None).cast("boolean") for c, v in e.defaults.items() if v is False})
    (n,) = normalize.normalize(raw, "students", F.lit("2025-08-31").cast("date")).collect()
    assert (n["gender"], n["ethnicity"], n["academic_program"], n["enrollment_status"], n["grade_level"], n["gpa"], n["last_name"], n["middle_name"], n["gifted_status"], n["years_enrolled"]) == ("Female", "ZZ", "General", "Active", 0, 3.46, "UNKNOWN", "B", False, 4)
    (r,) = refine.refine(normalize.normalize(raw, "students"), "students", "s").collect()
    assert r["student_id_hashed"] == hashlib.sha256(b"s1s").hexdigest() and r["first_name_masked"] == "An**" and r["birth_year_generalized"] == 2010 and not r["withdrawn_flag"]
    assert not {"student_id", "first_name", "middle_name", "date_of_birth", "email", "phone", "address", "birth_month"} & set(r.asDict())


def test_timeliness_and_weeks(spark):
    e = normalize.ENTITIES["academic_records"]
    day = datetime.date(2024, 5, 10)
    handed = [day + datetime.timedelta(k) for k in (-1, 0, 3, 7, 8)] + [None]
    raw = spark.createDataFrame([(f"r{k}", "s", day, h) for k, h in enumerate(handed)], "record_id string, student_id string, assignment_date date, submission_date date")
    texts = [*normalize.pairs(e.kept), *e.codes, *(d for d, v in e.defaults.items() if isinstance(v, str))]
    raw = raw.withColumns({**{c: F.lit(None).cast("string") for c in texts}, **{c: F.lit(None).cast("boolean") for c, v in e.defaults.items() if v is False}, **{c: F.lit(None).cast("int") for c in ("late_days", "retake_count")}, **{c: F.lit(-1.0) for c in e.ranges}, "on_time": F.lit(None).cast("boolean")})
    got = normalize.normalize(raw, "academic_records").orderBy("record_id").collect()
    assert [r["submission_timeliness"] for r in got] == [*normalize.TIMELINESS, "Very Late"] and got[0]["score_percent"] is None and got[0]["mastery_level"] == "Unknown"
