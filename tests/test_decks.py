"""Card decks over secured views."""

from __future__ import annotations

import json

import pytest

from scholarium.plans.access import DASHBOARDS, User, may_open
from scholarium.plans.decks import Deck
from scholarium.plans.guard import Refused

SPEC = {
    "name": "Risk",
    "type": "chronic_absenteeism",
    "row_level_security": True,
    "rbac_column": "school_id",
    "tabs": [
        {"name": "A", "cards": [{"title": "Count", "query": "SELECT COUNT(*) as \"Student Count\"\n FROM main_analytics.v_risk WHERE level IN ('High')", "visualization_type": "scalar"}]},
        {"name": "B", "cards": [{"title": "By School", "query": 'SELECT school_id as "School", ROUND(AVG(rate), 1) as "Rate %" FROM v_risk GROUP BY school_id ORDER BY "Rate %" DESC'}]},
    ],
}


@pytest.fixture(scope="module")
def view(spark):
    return spark.createDataFrame([(1, "High", 80.0, "s1"), (1, "Low", 99.0, "s2"), (2, "High", 70.0, "s3")], "school_id int, level string, rate double, ssn string")


def test_deck_shows_what_a_user_may_see(spark, view, tmp_path):
    (tmp_path / "deck.json").write_text(json.dumps(SPEC, indent=1))
    deck = Deck.load(spark, str(tmp_path / "deck.json"))
    assert [(c.tab, c.title, c.visualization) for c in deck.cards] == [("A", "Count", "scalar"), ("B", "By School", "table")]
    ask = lambda user: {t: [tuple(r) for r in df.collect()] for t, df in deck.answer(spark, {"v_risk": view}, user).items()}
    assert ask(User("admin")) == {"Count": [(2,)], "By School": [(1, 89.5), (2, 70.0)]}
    assert ask(User("principal", (2,))) == {"Count": [(1,)], "By School": [(2, 70.0)]}
    assert ask(User("analyst")) == {"Count": [(0,)], "By School": []}
    assert deck.answer(spark, {"v_risk": view}, User("admin"))["By School"].columns == ["School", "Rate %"]
    for role in ("teacher", "student", "nobody"):
        with pytest.raises(Refused, match="may not open"):
            deck.answer(spark, {"v_risk": view}, User(role, (1,)))


@pytest.mark.parametrize("query", ["SELECT ssn FROM v_risk", "SELECT * FROM main.other", "DROP TABLE v_risk", "SELECT * FROM IDENTIFIER('stored')"])
def test_cards_pass_the_guard(spark, view, query):
    deck = Deck.parse(json.dumps(SPEC | {"tabs": [{"name": "A", "cards": [{"title": "x", "query": query}]}]}))
    with pytest.raises(Refused):
        deck.answer(spark, {"v_risk": view}, User("admin"), hidden=frozenset({"ssn"}))


def test_matrix_and_specs():
    assert may_open(User("teacher"), "class_effectiveness") and not may_open(User("analyst"), "class_effectiveness") and not may_open(User("admin"), "unknown")
    assert all(may_open(User("admin"), d) and not may_open(User("student"), d) for d in DASHBOARDS)
    with pytest.raises(ValueError, match="no column"):
        Deck.parse(json.dumps(SPEC | {"rbac_column": None}))
    assert Deck.parse(json.dumps(SPEC | {"row_level_security": False})).column is None
