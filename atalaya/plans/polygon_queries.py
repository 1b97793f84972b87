"""Queries of general polygons: unions as rings, their overlay, outlines simplified without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import grid, polygons
from .panel_queries import rounded
from .registry import query
from .spatial_queries import S


def _square(q: Column, r: Column) -> Column:
    """A shape: the square of side S at lattice place q, r, in a plane turned by the angle of the 3-4-5 triangle."""
    corner = lambda i, j: F.struct((S * (0.6 * (q + i) - 0.8 * (r + j))).alias("x"), (S * (0.8 * (q + i) + 0.6 * (r + j))).alias("y"))
    return F.array(F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))))


def _zones(spark: SparkSession, d: str, group: Column, name: str, shift: float = 0.0) -> DataFrame:
    """(name, edges): outlines of the unions of cells, as squares, by group; they have bays, holes and many parts."""
    x = b.cells(spark, d).select(group.alias(name), _square(F.col("q") + shift, F.col("r") + shift).alias("parts"))
    return polygons.union_edges(polygons.shape_edges(x, name), name)


@query("j17_union_overlay", """, a AS (SELECT comuna_id, q * 443e0 AS x, r * 443e0 AS y FROM cells), c AS (SELECT hex_id % 7 AS district, (q + 0.5e0) * 443 AS x, (r + 0.5e0) * 443 AS y FROM cells)
SELECT comuna_id, district, round(sum((443 - abs(a.x - c.x)) * (443 - abs(a.y - c.y))), 3) AS area FROM a JOIN c ON abs(a.x - c.x) < 443 AND abs(a.y - c.y) < 443 GROUP BY 1, 2""")
def j17_union_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Area that each comuna has in common with each district; the SQL adds up single squares in the plane before the turn."""
    zones, districts = _zones(spark, d, F.col("comuna_id"), "comuna_id"), _zones(spark, d, F.col("hex_id") % 7, "district", 0.5)
    return rounded(polygons.overlay_edges(zones, districts, "comuna_id", "district", 2 * S).where("area > 0.001"), 3)


@query("a16_union_rings", """, near AS (SELECT a.comuna_id, a.hex_id, c.hex_id AS nbr FROM cells a JOIN cells c ON c.comuna_id = a.comuna_id AND abs(a.q - c.q) + abs(a.r - c.r) = 1),
reach(comuna_id, hex_id, root) AS (SELECT comuna_id, hex_id, hex_id FROM cells UNION SELECT n.comuna_id, n.nbr, root FROM reach JOIN near n ON n.hex_id = reach.hex_id),
parts AS (SELECT comuna_id, count(DISTINCT root) AS parts FROM (SELECT comuna_id, hex_id, min(root) AS root FROM reach GROUP BY 1, 2) m GROUP BY 1), inner_sides AS (SELECT comuna_id, count(*) AS n FROM near GROUP BY 1)
SELECT c.comuna_id, any_value(parts) AS parts, round(count(*) * 443e0 * 443, 3) AS area, round((4 * count(*) - coalesce(any_value(n), 0)) * 443e0, 3) AS outline FROM cells c JOIN parts p ON p.comuna_id = c.comuna_id LEFT JOIN inner_sides i ON i.comuna_id = c.comuna_id GROUP BY 1""")
def a16_union_rings(spark: SparkSession, d: str) -> DataFrame:
    """The comunas' unions as rings: parts, area less holes, length; the SQL counts connected squares and their inner sides."""
    from ..operators.spatial import ring_length

    rings = polygons.chain_rings(_zones(spark, d, F.col("comuna_id"), "comuna_id"), "comuna_id")
    return rounded(rings.groupBy("comuna_id").agg(F.sum(F.when(F.col("area") > 0, 1).otherwise(0)).alias("parts"), F.sum("area").alias("area"), F.sum(ring_length(F.col("ring"))).alias("outline")), 3)


@query("g13_simplified_outlines")
def g13_simplified_outlines(spark: SparkSession, d: str) -> DataFrame:
    """(comuna_id, ring_id, points, area): hexagons united by comuna, borders simplified alike on both sides."""
    x = b.cells(spark, d).select("comuna_id", F.array(F.array(grid.cell_corners(F.col("x"), F.col("y"), S))).alias("parts"))
    outline = polygons.union_edges(polygons.shape_edges(x, "comuna_id"), "comuna_id", 0.1)
    rings = polygons.chain_rings(polygons.simplify_coverage(outline, "comuna_id", 0.5 * S * S, 4 * S, 0.1), "comuna_id", 0.1)
    return rounded(rings.select("comuna_id", "ring_id", F.size("ring").cast("long").alias("points"), "area"), 3)
