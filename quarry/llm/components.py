"""Connected components of a graph given by its edges, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges (a long, b long), any direction, repeats and loops allowed. Returns (node, component):
    the smallest node that can be reached, for every node of an edge between two nodes; no null ends.

    A round joins edges with the least neighbour of a node, which is a partial
    aggregate, and never gathers a node's neighbours: a node with very many of
    them is a skewed join that Spark can split. Each round is written to the
    shared folder, so a lost executor costs at most that round.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        if _stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
    raise RuntimeError(f"not connected within {max_rounds} rounds")


def _stars(e: DataFrame) -> bool:
    """Every node has one edge downwards, and no node's lower end has one itself."""
    if not e.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return e.join(e.select(F.col("u").alias("w")), F.col("v") == F.col("w"), "left_semi").isEmpty()
