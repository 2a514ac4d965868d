"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands the smallest of itself and its neighbours to its larger (or smaller) neighbours."""
    if large:
        near = edges.union(edges.select("v", "u"))
    else:  # every edge is seen from its larger end
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = near.join(least, "u")
    if large:
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # the node itself is linked to the smallest as well; join rows keep hot nodes apart
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of an edge table (u, v).

    Minima are aggregated with partial sums and joined back, so a node with very
    many neighbours is never gathered in one task. Each round is written to the
    shared folder.
    """
    edges = stage(edges.where("u <> v").select("u", "v").distinct(), "edges")
    mark = None
    while True:
        edges = _star(edges, large=True).where("u <> v").distinct()
        edges = stage(_star(edges, large=False).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select("v", "v")).groupBy("node").agg(F.min("component").alias("component"))
