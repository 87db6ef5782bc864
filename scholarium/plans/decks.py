"""Card decks: dashboards as data, each card a query over views that the user may see."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarium.plans.access import User, may_open
from scholarium.plans.guard import Guard, Refused

#: Names in double quotes are identifiers, as in the decks' dialect.
SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true"}


@dataclass(frozen=True)
class Card:
    tab: str
    title: str
    query: str
    visualization: str


@dataclass(frozen=True)
class Deck:
    name: str
    dashboard: str
    cards: tuple[Card, ...]
    #: The column that bounds what a user sees, if the deck is secured by rows.
    column: str | None = None

    @classmethod
    def parse(cls, text: str) -> Deck:
        spec = json.loads(text)
        cards = tuple(Card(t["name"], c["title"], c["query"], c.get("visualization_type", "table")) for t in spec["tabs"] for c in t["cards"])
        secured = spec.get("row_level_security", False)
        if secured and not spec.get("rbac_column"):
            raise ValueError(f"{spec['name']}: rows are to be secured, but no column is named")
        return cls(spec["name"], spec["type"], cards, spec["rbac_column"] if secured else None)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Deck:
        return cls.parse(spark.read.text(path, wholetext=True).first()["value"])

    def secured(self, rows: DataFrame, user: User) -> DataFrame:
        """The rows of a view that a user may see.  Administrators see all; a view without the deck's column shows others nothing."""
        if self.column is None or user.role == "admin":
            return rows
        if self.column not in rows.columns:
            return rows.where(F.lit(False))
        return rows.where(F.col(self.column).isin(list(user.values)))

    def answer(self, spark: SparkSession, views: dict[str, DataFrame], user: User, max_rows: int = 1000, hidden: frozenset[str] = frozenset()) -> dict[str, DataFrame]:
        """Each card's rows by title, not yet run; the guard sees the secured views only.

        A card names views with or without a schema before them.  A user whose
        role may not open the dashboard is refused, and so is a deck with a card
        that the guard does not run.
        """
        if not may_open(user, self.dashboard):
            raise Refused(f"{user.role} may not open {self.dashboard}")
        guard = Guard(frozenset(views), hidden, max_rows, frames={n: self.secured(v, user) for n, v in views.items()}, settings=SETTINGS)
        names = "|".join(map(re.escape, views))
        return {c.title: guard.frame(spark, re.sub(rf"\b\w+\.({names})\b", r"\1", c.query)) for c in self.cards}
