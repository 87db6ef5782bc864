"""Merging domains of unlike grain: nulls, repeated rows, missing domains, wrong specs."""

from __future__ import annotations

import pytest

from scholarium.operators import accountability as A
from scholarium.operators import state
from scholarium.plans import catalog, state_catalog  # noqa: F401

S = A.Source
FULL = "cds_code string, academic_year string, reporting_category string, aggregate_level string"


def test_merge_follows_left_joins_of_the_grain(spark):
    one = spark.createDataFrame([("a", "24", "TA", "S", 1), ("a", "24", "EL", "S", 2), ("a", None, "TA", "S", 3), (None, "24", "TA", "S", 4), ("b", "24", "TA", "D", 5), ("b", "25", None, "S", 6)], FULL + ", x int")
    two = spark.createDataFrame([("a", "24", "TA", "S", "u"), ("a", "24", "TA", "S", "u"), ("c", "24", "TA", "S", None)], FULL + ", y string")
    year = spark.createDataFrame([("a", "24", 10), ("b", "25", 20), ("d", "24", 30), (None, "24", 40)], "cds_code string, academic_year string, z int")
    place = spark.createDataFrame([("a", "A"), ("b", "B"), (None, "?")], "cds_code string, name string")
    sources = {"one": S({"one_x": "x"}), "two": S({"two_y": "y"}), "year": S({"z": "z"}, keys=A.GRAIN[:2], anchors=False, level=None), "place": S({"name": "name"}, keys=A.GRAIN[:1], anchors=False, level=None)}
    got = A.merge({"one": one, "two": two, "year": year, "place": place}, sources)
    want = {("a", "24", "TA", 1, "u", 10, "A"), ("a", "24", "EL", 2, None, 10, "A"), ("a", None, "TA", None, None, None, "A"), ("b", "25", None, None, None, 20, "B"), ("c", "24", "TA", None, None, None, None)}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def test_merge_refuses_wrong_specs(spark):
    df = spark.createDataFrame([], FULL + ", x int")
    for sources in ({"a": S({"x": "x"}), "b": S({"x": "x"})}, {"a": S({"x": "x"}, keys=A.GRAIN[1:])}, {"a": S({"x": "x"}, keys=A.GRAIN[:1])}):
        with pytest.raises(ValueError, match="measure|keys|grain"):
            A.merge(dict.fromkeys(sources, df), sources)


def test_missing_domains_are_typed_and_empty(spark):
    staged = {n: state.typed_empty(spark, n) for n in A.SOURCES if n != "assessment_caspp"}
    staged["assessment_caspp"] = state.stage_caspp(spark.createDataFrame([], "nothing string")).withColumnRenamed("test_year", "academic_year")
    schools = spark.createDataFrame([], "cds_code string, school_id long, school_name string, cde_district_name string, cde_county string, latitude double, longitude double")
    assert A.school_accountability(staged, schools).count() == 0
    raw = spark.createDataFrame([("2024-25", "S", "1", "2", "3", "SE", "*", "3")], "academic_year string, aggregate_level string, county_code string, district_code string, school_code string, reporting_category string, chronic_absenteeism_eligible_cumulative_enrollment string, chronic_absenteeism_count string")
    (got,) = A.school_accountability(staged | {"chronic_absenteeism": state.stage(raw, "chronic_absenteeism")}, schools).collect()
    assert got["is_suppressed"] and got["data_domains_present"] == 0 and not got["has_cde_data"] and got["is_atrisk_subgroup"] and got["aggregate_level_label"] == "School"


def _final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_bundles_share_columns_and_keep_the_largest_of_repeated_measures(spark):
    def table(d, rows):
        names = [f"{d}{i}" for i in range(20)]
        return spark.createDataFrame([(*k, "S", *(v + i for i in range(20)), t) for *k, v, t in rows], FULL + "".join(f", {n} long" for n in names) + ", t string"), names

    a, a_names = table("a", [("x", "24", "TA", 1, "u"), ("x", "24", "TA", -5, "w"), ("x", "24", "EL", 7, None)])
    b, b_names = table("b", [("x", "24", "TA", 100, None), ("x", "24", "TA", 50, None), ("y", "24", "TA", 3, None)])
    c, c_names = table("c", [("x", "24", "TA", -1, None)])
    sources = {"a": S({n: n for n in a_names} | {"a_text": "t"}), "b": S({n: n for n in b_names}), "c": S({n: n for n in c_names})}
    got = A.merge({"a": a, "b": b, "c": c}, sources)
    rows = {(r["cds_code"], r["academic_year"], r["reporting_category"]): (r["a0"], r["a19"], r["b0"], r["b19"], r["c0"], r["c19"], r["a_text"]) for r in got.collect()}
    assert got.count() == len(rows)
    assert rows == {
        ("x", "24", "TA"): (1, 20, 100, 119, -1, 18, "w"),
        ("x", "24", "EL"): (7, 26, None, None, None, None, None),
        ("y", "24", "TA"): (None, None, 3, 22, None, None, None),
    }
    assert got.columns == [*A.GRAIN, *a_names, "a_text", *b_names, *c_names]
    fixed = [*a_names, *b_names, *c_names]
    bundles = A._bundles(sources, fixed)
    kinds = {n: t.schema[n].dataType for t, ns in ((a, a_names), (b, b_names), (c, c_names)) for n in ns}
    assert len(set(A._slots(sources, kinds, bundles).values())) == 20  # not 60


def test_domains_read_line_items_once(spark):
    df = catalog.QUERIES["school_accountability"](spark, "/root/testdata/sf0.001")
    assert df.collect()
    assert _final_plan(df).count("lineitem.parquet") == 1
