"""SQL over a metrics view gives what the view's own query gives, and takes nothing else."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scholarium.plans.dashboards import DIMENSIONS, SUMS, dashboard_view
from scholarium.plans.metrics import BadQuery, MetricsView
from scholarium.operators import state


@pytest.fixture(scope="module")
def view(spark):
    rows = spark.createDataFrame([("a", "x", 1, 10.0), ("a", "y", 2, None), ("b", "x", 3, 30.0), (None, "x", 4, 5.0), ("b", "Total", 5, 1.0)], "g string, `status` string, n long, v double")
    return MetricsView(rows, {"g": F.col("g"), "status": F.col("status"), "big": F.col("n") > 2}, {"total": F.sum("n"), "mean_v": F.avg("v"), "rows": F.count(F.lit(1))})


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(
    ("sql", "dims", "measures", "where"),
    [
        ("select total, g from metrics_view", ["g"], ["total"], None),
        ("SELECT g, status, mean_v FROM metrics_view WHERE status <> 'Total'", ["g", "status"], ["mean_v"], "status <> 'Total'"),
        ("SELECT big, total FROM metrics_view", ["big"], ["total"], None),
        ("SELECT total, rows FROM metrics_view WHERE g IS NULL OR status = 'x'", [], ["total", "rows"], "g IS NULL OR status = 'x'"),
        ("SELECT m.G, m.TOTAL FROM metrics_view AS m GROUP BY m.G", ["g"], ["total"], None),
        ("SELECT total FROM metrics_view WHERE false", [], ["total"], "false"),
    ],
)
def test_sql_equals_query(view, sql, dims, measures, where):
    out = view.sql(sql)
    names = out.columns
    assert got(out) == got(view.query(dims, measures, where and F.expr(where)).select(*names))


def test_conditions_on_measures_order_and_limit(view):
    out = view.sql("SELECT g, total * 2 AS twice FROM metrics_view WHERE total >= 3 AND status <> 'Total' ORDER BY twice DESC, g NULLS LAST LIMIT 2").collect()
    assert [tuple(r) for r in out] == [(None, 8), ("a", 6)]
    assert [tuple(r) for r in view.sql("SELECT g FROM metrics_view GROUP BY g HAVING rows > 1 ORDER BY mean_v DESC").collect()] == [("b",), ("a",)]
    assert got(view.sql("SELECT DISTINCT status FROM metrics_view")) == [("Total",), ("x",), ("y",)]
    assert got(view.sql("SELECT upper(g) AS u, status, rows FROM metrics_view WHERE big")) == [("B", "Total", 1), ("B", "x", 1), (None, "x", 1)]
    assert got(view.sql("SELECT status FROM metrics_view WHERE status = 'Total' AND total > 4")) == [("Total",)]


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM metrics_view",
        "SELECT v FROM metrics_view",
        "SELECT g, nothing FROM metrics_view",
        "SELECT sum(total) FROM metrics_view",
        "SELECT count(*) FROM metrics_view",
        "SELECT g FROM other",
        "SELECT g FROM metrics_view JOIN metrics_view b",
        "SELECT g FROM (SELECT g FROM metrics_view)",
        "SELECT g, total FROM metrics_view ORDER BY status",
        "SELECT g, total FROM metrics_view WHERE total > 1 OR status = 'x'",
        "SELECT g, g FROM metrics_view",
        "SELECT total FROM metrics_view WHERE n > 1",
        "SELECT g FROM metrics_view UNION SELECT status FROM metrics_view",
        "SELECT g FROM metrics_view WHERE g IN (SELECT 'a')",
        "SELECT (SELECT 1) AS x, total FROM metrics_view",
        "DROP TABLE metrics_view",
        "SELECT g FROM",
    ],
)
def test_refuses(view, sql):
    with pytest.raises(BadQuery):
        view.sql(sql)


def test_dimension_that_hides_a_column(spark):
    hiding = MetricsView(spark.createDataFrame([(1,)], "n long"), {"n": F.col("n") + 1}, {"total": F.sum("n")})
    with pytest.raises(ValueError, match="hides"):
        hiding.sql("SELECT n, total FROM metrics_view")


@pytest.mark.parametrize("board", sorted(SUMS))
def test_every_dashboard_view_answers(spark, board):
    raw = spark.createDataFrame([("S", "1", "5", "40", "12.5"), ("D", "2", "1", "*", None), ("X", "3", "1", "9", "1")], "rtype string, cds string, color string, currdenom string, currstatus string")
    view = dashboard_view(state.dashboard_export(raw, board), board)
    assert set(view.dimensions) == set(DIMENSIONS)
    rows = {r["aggregate_level"]: r for r in view.sql(f"SELECT aggregate_level, {', '.join(view.measures)} FROM metrics_view").collect()}
    assert (rows["School"]["status_value"], rows["School"]["blue_count"], rows["School"]["curr_denominator"], rows["District"]["red_count"], rows["District"]["school_count"]) == (12.5, 1, 40, 1, 1)
