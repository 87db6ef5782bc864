"""Connected components of a link table, without collecting links or labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node in ``links`` (columns a, b); ``comp`` is the least node that links reach.

    Each round points every node at its least neighbour, shortens the pointers
    by a step, and moves the links to where they point; links inside one node
    vanish.  The number of rounds grows with the logarithm of the longest path.
    """
    labels = None
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to"))
        step = materialize(step, "step")
        over = step.select(F.col("node").alias("to"), F.col("to").alias("next"))
        step = materialize(step.join(over, "to").select("node", F.col("next").alias("to")), "step")
        if labels is None:
            labels = step.select("node", F.col("to").alias("comp"))
        else:
            on = step.select(F.col("node").alias("comp"), "to")
            labels = labels.join(on, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        labels = materialize(labels, "labels")
        at = step.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        bt = step.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        edges = edges.join(at, "a").join(bt, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        edges = materialize(edges, "edges")
        if edges.isEmpty():
            return labels
