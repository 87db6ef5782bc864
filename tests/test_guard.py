"""The SQL guard: what it runs, what it refuses, and what it cannot be talked into."""

from __future__ import annotations

import pytest

from scholarium.plans.guard import Guard, Refused, execution_match, extract_sql, format_result


@pytest.fixture(scope="module")
def guarded(spark):
    spark.createDataFrame([(1, "a", "111"), (2, "b", "222"), (3, "a", "333")], "id long, name string, ssn string").createOrReplaceTempView("students")
    spark.createDataFrame([(1, "x")], "id long, secret string").createOrReplaceTempView("restricted")
    spark.createDataFrame([(1, "x")], "id long, secret string").write.mode("overwrite").saveAsTable("stored")
    return Guard(frozenset({"students"}), frozenset({"ssn"}), max_rows=2)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT id FROM students",
        "SELECT * FROM students",
        "WITH t AS (SELECT name, count(*) AS n FROM students GROUP BY name) SELECT * FROM t",
        "SELECT name FROM students WHERE name <> 'DROP TABLE x; --' -- a comment",
        "SELECT a.id FROM students a JOIN students b ON a.id = b.id WHERE a.id IN (SELECT max(id) FROM students)",
        "SELECT `name` FROM `students`",
        "SELECT * FROM IDENTIFIER('students')",
        "SELECT id, x FROM students LATERAL VIEW explode(array(1, 2)) t AS x",
        "SELECT r.id FROM range(3) r JOIN students s ON r.id = s.id",
        "SELECT * FROM (VALUES (1), (2)) v(x)",
        "WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 2) SELECT id FROM students JOIN n ON id = k",
        "SELECT id FROM students |> WHERE id > 1",
    ],
)
def test_runs(spark, guarded, sql):
    assert "ssn" not in guarded.frame(spark, sql).columns
    assert len(guarded.execute(spark, sql)) <= 2


@pytest.mark.parametrize(
    "sql",
    [
        "",
        "DROP TABLE students",
        "SELECT 1; SELECT 2",
        "INSERT INTO students VALUES (1)",
        "SELECT * FROM restricted",
        "SELECT * FROM `restricted`",
        "SELECT * FROM (TABLE restricted)",
        "SELECT (SELECT max(secret) FROM `restricted`) FROM students",
        "SELECT id FROM students WHERE EXISTS (SELECT 1 FROM restricted)",
        "WITH restricted AS (SELECT * FROM restricted) SELECT * FROM restricted",
        "SELECT ssn FROM students",
        "SELECT students.`ssn` FROM students",
        "SELECT id FROM students ORDER BY ssn",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
        "SELECT * FROM global_temp.students",
        "SELECT java_method('java.lang.System', 'getenv') FROM students",
        "SELECT id FROM",
        "SELECT nothing FROM students",
        "SELECT * FROM IDENTIFIER('restricted')",
        "SELECT * FROM IDENTIFIER('stored')",
        "SELECT * FROM IDENTIFIER('sto' || 'red')",
        "SELECT * FROM IDENTIFIER('default.stored')",
        "SELECT id FROM students WHERE id IN (SELECT id FROM IDENTIFIER('stored'))",
        "SELECT (SELECT max(id) FROM IDENTIFIER('stored')) AS m FROM students",
        "SELECT id FROM students WHERE EXISTS (SELECT 1 FROM IDENTIFIER('stored') s WHERE s.id = students.id)",
        "SELECT id FROM students |> UNION ALL (SELECT id FROM IDENTIFIER('stored'))",
        "WITH x AS (SELECT * FROM IDENTIFIER('stored')) SELECT * FROM x",
        "WITH x AS (SELECT 1 AS id) SELECT id FROM x UNION ALL SELECT id FROM stored",
        "SELECT s.id FROM students, LATERAL (SELECT id FROM stored) s",
        "SELECT * FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/region.parquet`')",
        "SELECT * FROM read_files('/root/testdata/sf0.001/region.parquet')",
        "SELECT IDENTIFIER('java_method')('java.lang.System', 'getenv', 'HOME') FROM students",
        "SELECT IDENTIFIER('input_file_name')() FROM students",
        "SELECT current_user() FROM students",
        "SELECT `reflect`('java.lang.System', 'getenv', 'HOME') FROM students",
        "SELECT _metadata.file_path FROM students",
        "SELECT * FROM IDENTIFIER('students') JOIN IDENTIFIER('restricted')",
    ],
)
def test_refuses(spark, guarded, sql):
    with pytest.raises(Refused):
        guarded.frame(spark, sql)


def test_stars_hold_no_hidden_column(spark, guarded):
    rows = guarded.execute(spark, "SELECT to_json(struct(*)) AS j FROM students")
    assert rows and all("ssn" not in r["j"] and "111" not in r["j"] for r in rows)


@pytest.mark.parametrize(
    ("text", "sql"),
    [
        ('{"sql": "SELECT 1"}', "SELECT 1"),
        ('Here you are: {"why": {"a": 1}, "sql": "SELECT 2;"} and more', "SELECT 2"),
        ("Sure.\n```sql\nSELECT 3;\n```", "SELECT 3"),
        ("  SELECT 4 ; ", "SELECT 4"),
    ],
)
def test_extract(text, sql):
    assert extract_sql(text) == sql


def test_execution_match(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "a int, b string")
    b = spark.createDataFrame([(2, "y"), (1, "x"), (1, "x")], "c long, d string")
    assert execution_match(a, b) and not execution_match(a, b.distinct()) and not execution_match(a, b.select("c"))


def test_schema_hides_columns(spark, guarded):
    assert guarded.schema(spark) == {"students": [("id", "bigint"), ("name", "string")]}


def test_pairs(spark, guarded):
    pairs = [("all", "SELECT * FROM students"), ("none", "SELECT id FROM students WHERE id < 0"), ("fenced", "```sql\nSELECT count(*) FROM students\n```"), ("other", "SELECT * FROM restricted"), ("constant", "SELECT 1"), ("fails", "SELECT raise_error(name) FROM students"), ("broken", "SELEC"), ("drop", "DROP TABLE students")]
    got = {r["question"]: (r["valid"], r["message"]) for r in guarded.validate_pairs(spark, pairs).collect()}
    assert got["all"] == (True, "3 rows returned") and got["none"] == (True, "no rows") and got["fenced"] == (True, "1 rows returned")
    assert not any(got[q][0] for q in ("other", "constant", "fails", "broken", "drop")) and got["constant"][1] == "no known relation is named"


def test_format_result(spark):
    rows = spark.createDataFrame([(1, 0.1, 10.0, 2.345, "x", 1, None), (2, None, -0.5, None, None, 3, 0.123456)], "n int, attendance_rate double, gpa_pct double, mean double, name_rate string, percent_done int, v double")
    got = [tuple(r) for r in format_result(rows).collect()]
    assert got == [(1, "10.00%", "10.00%", 2.35, "x", "100.00%", None), (2, None, "-0.50%", None, None, "3.00%", 0.12)]
