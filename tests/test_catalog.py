"""Each registered query of the library against its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from scholarium.plans import catalog, district_catalog, normal_catalog, state_catalog  # noqa: F401

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return None if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [[plain(v) for v in r] for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    result = duck.execute(catalog.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = [[plain(r[names.index(c)]) for c in columns] for r in result.fetchall()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_entry_imports_without_the_llm_folders(tmp_path):
    (tmp_path / "scholarium").mkdir()
    for p in (REPO / "scholarium").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "scholarium" / p.name)
    os.symlink(REPO / "__spark_entry__.py", tmp_path / "__spark_entry__.py")
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert run.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.SQL))], run.stderr
