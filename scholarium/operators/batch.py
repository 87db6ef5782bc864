"""Batch modes: delta, additive, snapshot, and deduplication by an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deduplicate(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def delta(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows, and existing ones that they don't replace."""
    if not keys:
        raise ValueError("a delta needs keys")
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def additive(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return existing.unionByName(incoming, allowMissingColumns=True)


def snapshot(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return incoming


def process(existing: DataFrame, incoming: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    if mode == "delta":
        return delta(existing, incoming, keys or [])
    if mode == "additive":
        return additive(existing, incoming)
    if mode == "snapshot":
        return snapshot(existing, incoming)
    raise ValueError(f"unknown mode {mode}")
