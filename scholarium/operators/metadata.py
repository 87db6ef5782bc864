"""The data dictionary: fields of entities with types, descriptions and privacy rules, and checks that tables exist."""

from __future__ import annotations

import html
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

COLUMNS = ("entity", "field", "type", "description", "privacy")


@dataclass(frozen=True)
class Field:
    entity: str
    field: str
    type: str
    description: str
    privacy: str


@dataclass(frozen=True)
class Dictionary:
    fields: tuple[Field, ...]

    @classmethod
    def load(cls, rows: DataFrame, most: int = 100_000) -> Dictionary:
        """From a table with the columns of ``COLUMNS``, of at most ``most`` rows."""
        if missing := [c for c in COLUMNS if c not in rows.columns]:
            raise ValueError(f"the dictionary lacks {', '.join(missing)}")
        held = rows.select(*COLUMNS).na.fill("").limit(most + 1).collect()
        if len(held) > most:
            raise ValueError(f"more than {most} fields")
        return cls(tuple(Field(*r) for r in held))

    def entities(self) -> list[str]:
        return sorted({f.entity for f in self.fields})

    def of(self, entity: str) -> list[Field]:
        return [f for f in self.fields if f.entity == entity]

    def schema(self, entity: str) -> dict[str, str]:
        """Types by field, as ``quality.validate_schema`` takes them."""
        return {f.field: f.type for f in self.of(entity)}

    def descriptions(self, entity: str) -> dict[str, str]:
        return {f.field: f.description for f in self.of(entity)}

    def privacy(self, entity: str) -> dict[str, str]:
        """Rules by field, as ``transform.pseudonymize`` takes them; fields without one are left out."""
        return {f.field: f.privacy for f in self.of(entity) if f.privacy}

    def markdown(self) -> str:
        cell = lambda x: x.replace("|", "\\|").replace("\n", " ")
        parts = []
        for e in self.entities():
            rows = "\n".join("| " + " | ".join(map(cell, (f.field, f.type, f.description, f.privacy or "none"))) + " |" for f in self.of(e))
            parts.append(f"## {e}\n\n| Field | Type | Description | Privacy |\n|-|-|-|-|\n{rows}\n")
        return "# Data dictionary\n\n" + "\n".join(parts)

    def html(self) -> str:
        row = lambda tag, cells: "<tr>" + "".join(f"<{tag}>{html.escape(c)}</{tag}>" for c in cells) + "</tr>"
        parts = []
        for e in self.entities():
            rows = "".join(row("td", (f.field, f.type, f.description, f.privacy or "none")) for f in self.of(e))
            parts.append(f"<h2>{html.escape(e)}</h2><table>{row('th', ('Field', 'Type', 'Description', 'Privacy'))}{rows}</table>")
        return "<h1>Data dictionary</h1>" + "".join(parts)


def table_checks(spark: SparkSession, least: dict[str, int]) -> DataFrame:
    """(table_name, exists, rows, least, ok) of each table that should exist with at least so many rows."""
    out = []
    for name, n in least.items():
        exists = spark.catalog.tableExists(name)
        rows = spark.table(name).count() if exists else 0
        out.append((name, exists, rows, n, exists and rows >= n))
    return spark.createDataFrame(out, "table_name string, exists boolean, rows long, least long, ok boolean")
