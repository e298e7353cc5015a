"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkbeam.sources.files import rewritten


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label``, the smallest node that can be reached, for every node of an edge.

    Each round takes the smallest label among neighbours, then the label of the
    label, so the rounds grow with the logarithm of the longest path rather
    than with its length. Rounds are written to the shared folder. An empty
    table of edges gives an empty result; edges with a null end are left out.
    """
    ends = [F.col(a).alias("x"), F.col(b).alias("y")]
    known = edges.select(*ends).where("x IS NOT NULL AND y IS NOT NULL AND x != y")
    both = rewritten(known.union(known.select("y", "x")).distinct(), name="edges")
    labels = both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("least"))
    labels = rewritten(labels.select("node", F.least("node", "least").alias("label")), name="labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("label").alias("far")), "y")
        least = near.groupBy(F.col("x").alias("node")).agg(F.min("far").alias("least"))
        lower = labels.join(least, "node", "left").select(
            "node", "label", F.least("label", "least").alias("next")
        )
        heads = labels.select(F.col("node").alias("next"), F.col("label").alias("head"))
        jumped = lower.join(heads, "next", "left").select(
            "node", F.col("label").alias("was"), F.least("next", "head").alias("label")
        )
        stored = rewritten(jumped, name="labels")
        labels = stored.select("node", "label")
        if stored.where("was != label").isEmpty():
            return labels
