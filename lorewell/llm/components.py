"""Connected components by contraction, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import stored


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``node -> parent`` (parent < node, or absent for a root) by pointer doubling."""
    while True:
        up = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_up"))
        parents = stored(parents.join(up, F.col("parent") == F.col("_node"), "left").select("node", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved")), "roots")
        moved = parents.where("_moved").limit(1).count()
        parents = parents.drop("_moved")
        if not moved:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the smallest node of the component.

    Each round hooks every node to its smallest neighbour, follows the pointers to
    their roots, and goes on with the edges between roots; a round at least halves
    the nodes that still have edges. Hot nodes are reduced map-side by minimum.
    """
    edges = stored(edges.where("a <> b").select("a", "b"), "edges")
    labels: DataFrame | None = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        roots = _roots(nearest.where("parent < node"))
        rooted = roots.select(F.col("node").alias("_n"), F.col("parent").alias("_r"))
        if labels is None:
            labels = stored(nearest.select("node").join(rooted, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("_r", "node").alias("root")), "labels")
        else:
            labels = stored(labels.join(rooted, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "labels")
        for end, other in (("a", "b"), ("b", "a")):
            edges = edges.join(rooted, F.col(end) == F.col("_n"), "left").select(F.coalesce("_r", end).alias(end), other)
        edges = stored(edges.where("a <> b").distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
