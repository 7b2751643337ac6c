"""Connected components of an edge table, by contraction: every node joins its smallest neighbour until no edge is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartlines.llm.common import keep


def connected_components(edges: DataFrame) -> DataFrame:
    """node, comp for all nodes of edges (a, b): comp is one node of the component, the same for all of it.

    Rounds shrink the edge table; each writes what it found to the shared folder.
    A hub with very many edges is a partial minimum, never a list. Self-loops name
    their node; nulls and repeated edges are ignored; no edges give no rows.
    """
    edges = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("comp", F.col("node"))
    left = keep(edges.where(F.col("a") != F.col("b")).distinct(), "edges")
    while not left.isEmpty():
        both = left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select("b", "a"))
        up = keep(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "parents")
        top = up.select(F.col("u").alias("p"), F.col("p").alias("q"))
        # one jump: the parent's parent
        up = keep(up.join(top, "p", "left").select("u", F.coalesce("q", "p").alias("p")), "parents")
        labels = keep(labels.join(up, labels["comp"] == up["u"], "left").select("node", F.coalesce("p", "comp").alias("comp")), "labels")
        a, b = up.select(F.col("u").alias("a"), F.col("p").alias("pa")), up.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        moved = left.join(a, "a").join(b, "b").where(F.col("pa") != F.col("pb"))
        left = keep(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return labels
