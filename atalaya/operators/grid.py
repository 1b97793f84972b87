"""The hexagonal grid in axial coordinates: cells of points, rings of neighbours, corners, contiguity weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Axial steps to the six neighbours of a cell.
STEPS = ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1))


def offsets(radius: int) -> list[tuple[int, int, int]]:
    """(k, dq, dr) of all cells at distance 1 to radius: 6 k for each k."""
    around = range(-radius, radius + 1)
    return [(k, q, r) for q in around for r in around if 0 < (k := (abs(q) + abs(r) + abs(q + r)) // 2) <= radius]


def axial_cell(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    """Axial q, r of the pointy-top cell that holds a plane point: rounded as cube coordinates; null-safe."""
    q, r = (math.sqrt(3) / 3 * x - y / 3) / size, (2.0 / 3 * y) / size
    s = -q - r
    near = lambda v: F.floor(v + 0.5)
    dq, dr, ds = F.abs(near(q) - q), F.abs(near(r) - r), F.abs(near(s) - s)
    fix_q, fix_r = (dq > dr) & (dq > ds), (dr >= dq) & (dr > ds)
    return F.when(fix_q, -near(r) - near(s)).otherwise(near(q)), F.when(~fix_q & fix_r, -near(q) - near(s)).otherwise(near(r))


def cell_id(q: Column, r: Column) -> Column:
    """One long for a pair of axial coordinates (each within 2^31)."""
    return F.shiftleft(q.cast("long"), 32).bitwiseOR(r.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def cell_centre(q: Column, r: Column, size: float) -> tuple[Column, Column]:
    """Plane coordinates of a cell's centre."""
    return size * math.sqrt(3) * (q + r / 2), size * 1.5 * r


def cell_corners(x: Column, y: Column, size: float) -> Column:
    """The six corners of a cell from its centre, as array<struct<x, y>>."""
    corner = lambda k: F.struct((x + size * math.cos(math.radians(60 * k - 30))).alias("x"), (y + size * math.sin(math.radians(60 * k - 30))).alias("y"))
    return F.array(*[corner(k) for k in range(6)])


def ring_table(cells: DataFrame, radius: int) -> DataFrame:
    """hex_id, nbr, k for cells (hex_id, q, r): neighbours within the radius that are cells too. An equi-join."""
    steps = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(q).alias("dq"), F.lit(r).alias("dr")) for k, q, r in offsets(radius)])
    around = cells.select("hex_id", "q", "r", F.explode(steps).alias("o")).select("hex_id", F.col("o.k").alias("k"), (F.col("q") + F.col("o.dq")).alias("q"), (F.col("r") + F.col("o.dr")).alias("r"))
    return around.join(cells.select(F.col("hex_id").alias("nbr"), "q", "r"), ["q", "r"]).select("hex_id", "nbr", "k")


def contiguity(ring: DataFrame) -> DataFrame:
    """hex_id, nbr, w: ring 1 with weights that sum to one for each cell."""
    near = ring.where("k = 1")
    degree = near.groupBy("hex_id").agg(F.count("*").alias("d"))
    return near.join(degree, "hex_id").select("hex_id", "nbr", (1.0 / F.col("d")).alias("w"))


def normalised_adjacency(ring: DataFrame, cells: DataFrame) -> DataFrame:
    """i, j, w of D^-1/2 (A + I) D^-1/2."""
    own = cells.select(F.col("hex_id").alias("i"), F.col("hex_id").alias("j"))
    edges = ring.where("k = 1").select(F.col("hex_id").alias("i"), F.col("nbr").alias("j")).unionAll(own)
    degree = edges.groupBy("i").agg(F.count("*").alias("d"))
    return edges.join(degree, "i").join(degree.select(F.col("i").alias("j"), F.col("d").alias("e")), "j").select("i", "j", (1 / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def graph_convolution(adjacency: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """(i, out, value): A (X W) of adjacency (i, j, w), features (j, feature, x) and weights (feature, out, w)."""
    mixed = features.join(F.broadcast(weights.withColumnRenamed("w", "__w")), "feature").groupBy("j", "out").agg(F.sum(F.col("x") * F.col("__w")).alias("h"))  # a layer's weights
    return adjacency.join(mixed, "j").groupBy("i", "out").agg(F.sum(F.col("w") * F.col("h")).alias("value"))
