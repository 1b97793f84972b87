"""Road-graph operators: reachability within a distance, corridors, covered edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut


def reachable(sources: DataFrame, edges: DataFrame, cutoff: float, directed: bool = True) -> DataFrame:
    """(source, node, dist): nodes within cutoff of each source (column source) along edges (u, v, length_m).

    Frontier relaxation: each round joins the nodes that got nearer with the edges and keeps the least distance; it ends
    when nothing gets nearer. Every round is checkpointed, so lineage stays short and lost executors cost one round.
    """
    if not directed:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *[c for c in edges.columns if c not in ("u", "v")]))
    steps = edges.groupBy("u", "v").agg(F.min("length_m").alias("length_m"))
    best = sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist")).distinct()
    frontier = best
    while True:
        tried = frontier.join(steps, frontier.node == steps.u).select("source", F.col("v").alias("node"), (F.col("dist") + F.col("length_m")).alias("dist"))
        tried = tried.where(F.col("dist") <= cutoff).groupBy("source", "node").agg(F.min("dist").alias("dist"))
        old = best.select("source", "node", F.col("dist").alias("old"))
        frontier = cut(tried.join(old, ["source", "node"], "left").where("old IS NULL OR dist < old").select("source", "node", "dist"))
        if frontier.isEmpty():
            break
        best = cut(best.join(frontier.select("source", "node"), ["source", "node"], "left_anti").unionByName(frontier))
    return best


def corridor_edges(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, a, b, length_m): the edges with both ends within reach, a < b; antiparallel twins are one, the shorter."""
    once = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "length_m").groupBy("a", "b").agg(F.min("length_m").alias("length_m"))
    ends = reach.select("source", "node")
    both = once.join(ends, once.a == ends.node).drop("node").join(ends.select(F.col("source").alias("s2"), "node"), (F.col("b") == F.col("node")) & (F.col("source") == F.col("s2")))
    return both.select("source", "a", "b", "length_m")


def corridor_length(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, km, edges): length of the edges with both ends within reach."""
    return corridor_edges(reach, edges).groupBy("source").agg((F.sum("length_m") / 1000).alias("km"), F.count("*").alias("edges"))


def covered_edges(reach: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, u, v): edges with either end within reach of the source."""
    ends = reach.select("source", "node")
    return ends.join(edges.select("u", "v"), F.col("node") == F.col("u")).select("source", "u", "v").union(ends.join(edges.select("u", "v"), F.col("node") == F.col("v")).select("source", "u", "v")).distinct()
