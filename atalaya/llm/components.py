"""Connected components of an edge table by alternating star rounds; nothing is gathered outside the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize


def _stars(edges: DataFrame, of: str) -> DataFrame:
    """Link the neighbours of each node to its least neighbour; 'large': those above the node, 'small': the others."""
    if of == "large":
        around = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        keep = F.col("other") > F.col("node")
    else:
        around = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
        keep = F.col("other") < F.col("node")
    least = around.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    linked = around.where(keep).join(least, "node").select(F.col("least").alias("a"), F.col("other").alias("b"))
    if of == "small":
        linked = linked.unionAll(least.select(F.col("least").alias("a"), F.col("node").alias("b")))
    return linked.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of edges (a, b), both long, with the least node that it reaches. Nulls are dropped.

    Rounds of stars on large and small neighbours shrink every component to a star in about log^2 of its diameter;
    each round is written to the shared folder, and the end is where every node but the centres has one link.
    """
    now, old = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), None
    while True:
        now = materialize(_stars(_stars(now, "large"), "small"), "stars")
        if old is not None:
            discard(old)
        old = now
        links = now.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("up")), F.struct(F.col("b").alias("node"), F.lit(1).alias("up")))).alias("x"))
        if links.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.count("*").alias("n")).where("up > 1 OR up = 1 AND n > 1").count() == 0:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
