"""Spatial joins and measures on plane coordinates: bucketed equi-joins with exact predicates, ring polygons, projection."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut


def within_distance(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, dist): pairs of points (x, y) within the radius; a join on square buckets as wide as it.

    Each left point looks into the 3 x 3 buckets around its own, each right point stands in one.
    """
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    bucket = lambda c: F.floor(F.col(c) / radius)
    a = left.select(left_id, F.col("x").alias("ax"), F.col("y").alias("ay"), near.alias("o")).select(left_id, "ax", "ay", F.floor(F.col("ax") / radius).alias("bx") + F.col("o.i"), F.floor(F.col("ay") / radius) + F.col("o.j"))
    a = a.toDF(left_id, "ax", "ay", "bx", "by")
    b = right.select(right_id, F.col("x").alias("cx"), F.col("y").alias("cy"), bucket("x").alias("bx"), bucket("y").alias("by"))
    dist = F.sqrt(F.pow(F.col("ax") - F.col("cx"), 2) + F.pow(F.col("ay") - F.col("cy"), 2))
    return a.join(b, ["bx", "by"]).select(left_id, right_id, dist.alias("dist")).where(F.col("dist") <= radius)


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, first: float) -> DataFrame:
    """(left_id, right_id, dist): each left point's nearest right point; ties go to the lower id.

    Looks within `first`, and for points that found nothing within twice that, and so on: each round is a bucketed join of
    what is left, written out. A point is settled once something lies within the round's radius, and the last round is that
    whose radius spans all points. Points without coordinates, and all points if nothing stands right, get nulls.
    """
    known = "x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)"
    right, rest, radius, done = right.where(known), left.where(known), first, []
    nothing = left.where(f"NOT coalesce({known}, false)")
    ends = [F.min("x"), F.max("x"), F.min("y"), F.max("y")]
    x0, x1, y0, y1 = right.select("x", "y").unionAll(rest.select("x", "y")).agg(*ends).first()
    if right.isEmpty():
        nothing, span = left, -1.0
    else:
        span = math.hypot(x1 - x0, y1 - y0)
    while span >= 0 and not rest.isEmpty():
        best = within_distance(rest, right, radius, left_id, right_id).groupBy(left_id).agg(F.min(F.struct("dist", right_id)).alias("b")).select(left_id, f"b.{right_id}", "b.dist")
        best = cut(best)
        done.append(best)
        if radius > span:
            break
        rest, radius = cut(rest.join(best, left_id, "left_anti")), 2 * radius
    none = nothing.select(left_id, F.lit(None).cast(dict(right.dtypes)[right_id]).alias(right_id), F.lit(None).cast("double").alias("dist"))
    return reduce(DataFrame.unionAll, [*done, none])


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a line segment."""
    dx, dy = x2 - x1, y2 - y1
    long2 = dx * dx + dy * dy
    t = F.when(long2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / long2))).otherwise(0.0)
    return F.sqrt(F.pow(px - x1 - t * dx, 2) + F.pow(py - y1 - t * dy, 2))


def points_near_segments(points: DataFrame, segments: DataFrame, radius: float, point_id: str, segment_id: str) -> DataFrame:
    """(point_id, segment_id, dist): pairs within the radius. Segments (x1, y1, x2, y2) stand in the buckets of their box."""
    lo = lambda a, b: F.floor((F.least(a, b) - radius) / radius)
    hi = lambda a, b: F.floor((F.greatest(a, b) + radius) / radius)
    s = segments.withColumn("bx", F.explode(F.sequence(lo("x1", "x2"), hi("x1", "x2")))).withColumn("by", F.explode(F.sequence(lo("y1", "y2"), hi("y1", "y2"))))
    p = points.select(point_id, "x", "y", F.floor(F.col("x") / radius).alias("bx"), F.floor(F.col("y") / radius).alias("by"))
    dist = segment_distance(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))
    return p.join(s, ["bx", "by"]).select(point_id, segment_id, dist.alias("dist")).where(F.col("dist") <= radius)


def nearest_segment(points: DataFrame, segments: DataFrame, first: float, point_id: str, segment_id: str, digits: int = 6) -> DataFrame:
    """(point_id, segment_id, dist): each point's nearest segment; ties of the rounded distance go to the lower id.

    Looks within `first`, then twice as far for the points that found nothing. Wider buckets would hold most segments, so the
    points that are left then go down a tree of squares. Points without coordinates have no row.
    """
    segments = segments.where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")
    rest, radius, done = points.where("x IS NOT NULL AND y IS NOT NULL"), first, []
    for _ in range(2):
        found = points_near_segments(rest, segments, radius, point_id, segment_id).withColumn("dist", F.round("dist", digits))
        best = cut(found.groupBy(point_id).agg(F.min(F.struct("dist", segment_id)).alias("b")).select(point_id, f"b.{segment_id}", "b.dist"))
        done.append(best)
        rest, radius = cut(rest.join(best, point_id, "left_anti")), 2 * radius
        if rest.isEmpty():
            return reduce(DataFrame.unionAll, done)
    return reduce(DataFrame.unionAll, [*done, _down_the_squares(rest, segments, first, point_id, segment_id, digits)])


def _down_the_squares(points: DataFrame, segments: DataFrame, size: float, point_id: str, segment_id: str, digits: int) -> DataFrame:
    """nearest_segment of points that may lie far from all segments, by branch and bound.

    Segments stand in the square of their middle, squares in squares twice as wide, each with the box of its segments. Level by
    level a point keeps the squares whose box is no farther than the farthest corner of its best one.
    """
    middle = lambda k: F.floor((F.col(f"{k}1") + F.col(f"{k}2")) / 2 / size)
    placed = segments.select(segment_id, "x1", "y1", "x2", "y2", middle("x").alias("cx"), middle("y").alias("cy"))
    ends = [f(g(f"{k}1", f"{k}2")).alias(f"{k}{n}") for k in "xy" for n, f, g in (("lo", F.min, F.least), ("hi", F.max, F.greatest))]
    tree = [cut(placed.groupBy("cx", "cy").agg(*ends))]
    while tree[-1].count() > 16:  # four squares around the origin at the top
        up = tree[-1].groupBy(F.shiftright("cx", 1).alias("cx"), F.shiftright("cy", 1).alias("cy"))
        tree.append(cut(up.agg(*[f(f"{k}{n}").alias(f"{k}{n}") for k in "xy" for n, f in (("lo", F.min), ("hi", F.max))])))

    def kept(met: DataFrame) -> DataFrame:
        near = lambda k: F.greatest(F.lit(0.0), F.col(f"{k}lo") - F.col(k), F.col(k) - F.col(f"{k}hi"))
        far = lambda k: F.greatest(F.abs(F.col(k) - F.col(f"{k}lo")), F.abs(F.col(k) - F.col(f"{k}hi")))
        most = F.min(F.hypot(far("x"), far("y"))).over(Window.partitionBy(point_id))
        met = met.select(point_id, "x", "y", "cx", "cy", F.hypot(near("x"), near("y")).alias("least"), most.alias("most"))
        return met.where(F.col("least") <= F.col("most") * (1 + 1e-12) + 2 * 10.0**-digits).select(point_id, "x", "y", "cx", "cy")

    front = kept(points.select(point_id, *[F.col(k).cast("double").alias(k) for k in "xy"]).join(F.broadcast(tree[-1]), how="cross"))  # 16 squares at most
    for level in reversed(tree[:-1]):
        inner = level.withColumns({"px": F.shiftright("cx", 1), "py": F.shiftright("cy", 1)})
        front = kept(front.withColumnsRenamed({"cx": "px", "cy": "py"}).join(inner, ["px", "py"]))
    dist = F.round(segment_distance(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2"))), digits)
    found = front.join(placed, ["cx", "cy"]).select(point_id, segment_id, dist.alias("dist"))
    return found.groupBy(point_id).agg(F.min(F.struct("dist", segment_id)).alias("b")).select(point_id, f"b.{segment_id}", "b.dist")


# --- polygons: array<struct<x, y>> rings, not closed --------------------------------------------------------------


def ring_of_wkt(text: Column) -> Column:
    """The outer ring of a POLYGON's WKT as array<struct<x, y>>, without the closing point."""
    body = F.regexp_extract(text, r"POLYGON\s*\(\(([^)]*)\)", 1)
    points = F.transform(F.split(F.trim(body), r"\s*,\s*"), lambda p: F.struct(F.get(F.split(p, r"\s+"), F.lit(0)).try_cast("double").alias("x"), F.get(F.split(p, r"\s+"), F.lit(1)).try_cast("double").alias("y")))
    closed = F.element_at(points, 1) == F.element_at(points, -1)
    return F.when(body == "", None).when(closed, F.slice(points, 1, F.size(points) - 1)).otherwise(points)


def _edges(ring: Column) -> Column:
    """array<struct<a, b>>: each point with the next; the last with the first."""
    turned = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def signed_area(ring: Column) -> Column:
    """Shoelace area; positive counter-clockwise."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2


def ring_length(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + F.sqrt(F.pow(e["a"]["x"] - e["b"]["x"], 2) + F.pow(e["a"]["y"] - e["b"]["y"], 2)))


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    """Centroid of the area."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    area6 = 6 * signed_area(ring)
    along = lambda k: F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["a"][k] + e["b"][k]) * cross(e)) / area6
    return along("x"), along("y")


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule; points on lower and left edges are inside, on upper and right ones outside."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        # Division only where the edge is not level.
        at = F.when(spans, (b["x"] - a["x"]) * (y - a["y"]) / F.when(spans, b["y"] - a["y"]) + a["x"])
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(_edges(ring), F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1


def point_in_polygon(points: DataFrame, polygons: DataFrame, cell: float, point_id: str, polygon_id: str) -> DataFrame:
    """(point_id, polygon_id): the polygon (column ring) that holds each point, the lowest id if several.

    Polygons stand in the square buckets of their boxes; the join is on buckets, the test exact.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    spread = lambda v: F.explode(F.sequence(F.floor(F.array_min(v) / cell), F.floor(F.array_max(v) / cell)))
    g = polygons.select(polygon_id, "ring", spread(xs).alias("bx"), ys.alias("ys")).select(polygon_id, "ring", "bx", spread(F.col("ys")).alias("by"))
    p = points.select(point_id, "x", "y", F.floor(F.col("x") / cell).alias("bx"), F.floor(F.col("y") / cell).alias("by"))
    inside = p.join(g, ["bx", "by"]).where(contains(F.col("ring"), F.col("x"), F.col("y")))
    return inside.groupBy(point_id).agg(F.min(polygon_id).alias(polygon_id))


def clip_half_plane(ring: Column, nx: Column, ny: Column, c: Column) -> Column:
    """The part of a convex ring where nx * x + ny * y <= c."""
    side = lambda p: nx * p["x"] + ny * p["y"] - c

    def step(out: Column, e: Column) -> Column:
        a, b = side(e["a"]), side(e["b"])
        t = a / F.when((a > 0) != (b > 0), a - b)
        cut = F.struct((e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"])).alias("x"), (e["a"]["y"] + t * (e["b"]["y"] - e["a"]["y"])).alias("y"))
        out = F.when(a <= 0, F.concat(out, F.array(F.struct(e["a"]["x"].alias("x"), e["a"]["y"].alias("y"))))).otherwise(out)
        return F.when((a > 0) != (b > 0), F.concat(out, F.array(cut))).otherwise(out)

    empty = F.expr("cast(array() AS array<struct<x:double,y:double>>)")
    return F.when(F.size(ring) == 0, empty).otherwise(F.aggregate(_edges(ring), empty, step))


def _once(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def overlap_area(df: DataFrame, ring: str, box: tuple[str, str, str, str], name: str = "area") -> DataFrame:
    """df with the area of a convex ring within a box (x0, y0, x1, y1 columns).

    Rectangles along the axes are cut by their extents, other rings by four half planes, one after the other.
    """
    x0, y0, x1, y1 = map(F.col, box)
    one, zero = F.lit(1.0), F.lit(0.0)
    planes = F.array(*[F.struct(nx.alias("nx"), ny.alias("ny"), c.cast("double").alias("c")) for nx, ny, c in ((one, zero, x1), (-one, zero, -x0), (zero, one, y1), (zero, -one, -y0))])
    left = F.aggregate(planes, F.col(ring), lambda left, p: clip_half_plane(left, p["nx"], p["ny"], p["c"]))
    cut_off = _once(left, lambda c: F.when(F.size(c) < 3, 0.0).otherwise(F.abs(signed_area(c))))
    a, b, c, d = (F.get(F.col(ring), F.lit(i)) for i in range(4))
    along = lambda i, j: (a[i] == d[i]) & (b[i] == c[i]) & (a[j] == b[j]) & (c[j] == d[j])
    side = lambda k, lo, hi: F.greatest(zero, F.least(F.greatest(a[k], c[k]), hi) - F.greatest(F.least(a[k], c[k]), lo))
    return df.withColumn(name, F.when((F.size(ring) == 4) & (along("x", "y") | along("y", "x")), side("x", x0, x1) * side("y", y0, y1)).otherwise(cut_off))


def circle(x: Column, y: Column, radius: Column, steps: int = 48) -> Column:
    """The outline of a circle as array<struct<x, y>>; the first point stands again at the end."""
    turn = lambda k: 2 * math.pi * k / steps
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.struct((x + radius * F.cos(turn(k))).alias("x"), (y + radius * F.sin(turn(k))).alias("y")))


def transverse_mercator(lat: Column, lon: Column, lon0: float = -60.0, lat0: float = -90.0, scale: float = 1.0, x0: float = 5_500_000.0, y0: float = 0.0) -> tuple[Column, Column]:
    """Plane x, y in metres of WGS84 / GRS80 degrees by the series in the third flattening (fourth order).

    The defaults are the national belt around 60 degrees west.
    """
    a, f = 6378137.0, 1 / 298.257222101
    n = f / (2 - f)
    rect = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    e = math.sqrt(f * (2 - f))

    def conformal(phi):
        s = F.sin(phi)
        return F.sinh(F.atanh(s) - e * F.atanh(e * s))

    t, d = conformal(F.radians(lat)), F.radians(lon - lon0)
    xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
    north, east = xi, eta
    for j, c in enumerate(alpha, 1):
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    # Northing of the origin; the pole is a quarter of a meridian away exactly.
    origin = math.copysign(math.pi / 2, lat0) if abs(lat0) == 90 else 0.0
    if abs(lat0) not in (0, 90):
        s = math.sin(math.radians(lat0))
        xi0 = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
        origin = xi0 + sum(c * math.sin(2 * j * xi0) for j, c in enumerate(alpha, 1))
    return x0 + scale * rect * east, y0 + scale * rect * (north - origin)


def cells_of_polygons(polygons: DataFrame, size: float, polygon_id: str) -> DataFrame:
    """(polygon_id, q, r): the grid cells of the given size that overlap a convex polygon (column ring) that has an area.

    Cells are counted out over the polygon's box, one cell wider on each side, in rows that are dealt to all tasks. A centre
    farther from an edge than a cell's radius decides by itself; only cells on the border are cut with it by half planes.
    """
    from .grid import cell_centre, cell_corners

    box = polygons.select(polygon_id, "ring", *[f(F.col(f"ring.{k}")).alias(n) for n, f, k in (("x0", F.array_min, "x"), ("x1", F.array_max, "x"), ("y0", F.array_min, "y"), ("y1", F.array_max, "y"))], F.signum(signed_area(F.col("ring"))).alias("__turn")).where("__turn <> 0")
    rows = F.sequence(F.floor(F.col("y0") / (1.5 * size)) - 1, F.ceil(F.col("y1") / (1.5 * size)) + 1)
    wide = math.sqrt(3.0) * size

    def plane(e: Column) -> Column:  # nx * x + ny * y <= c on the side of the edge on which the polygon lies
        nx, ny = (e["b"]["y"] - e["a"]["y"]) * F.col("__turn"), (e["a"]["x"] - e["b"]["x"]) * F.col("__turn")
        return F.struct(nx.alias("nx"), ny.alias("ny"), (nx * e["a"]["x"] + ny * e["a"]["y"]).alias("c"), F.sqrt(nx * nx + ny * ny).alias("n"))

    box = box.withColumn("__planes", F.filter(F.transform(_edges(F.col("ring")), plane), lambda p: p["n"] > 0))
    tasks = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = box.select(polygon_id, "__planes", "x0", "x1", F.explode(rows).alias("r")).repartition(tasks, polygon_id, "r")  # else a task for all rows of a polygon
    out = out.withColumn("q", F.explode(F.sequence(F.floor(F.col("x0") / wide - F.col("r") / 2) - 1, F.ceil(F.col("x1") / wide - F.col("r") / 2) + 1)))
    cx, cy = cell_centre(F.col("q"), F.col("r"), size)
    out = out.select(polygon_id, "q", "r", "__planes", cx.alias("__x"), cy.alias("__y"))
    beyond = F.array_max(F.transform("__planes", lambda p: (p["nx"] * F.col("__x") + p["ny"] * F.col("__y") - p["c"]) / p["n"]))
    left = F.aggregate("__planes", cell_corners(F.col("__x"), F.col("__y"), size), lambda left, p: clip_half_plane(left, p["nx"], p["ny"], p["c"]))
    cut_off = _once(left, lambda c: (F.size(c) > 2) & (F.abs(signed_area(c)) > 1e-6))
    return out.where(_once(beyond, lambda d: F.when(d >= size, False).when(d <= -size, True).otherwise(cut_off))).select(polygon_id, "q", "r")


def dissolve_cells(cells: DataFrame, ring: DataFrame, group: str, size: float) -> DataFrame:
    """group, cells, area, outline: hexagons united by group; sides between two cells of a group are inner and dropped."""
    near = ring.where("k = 1").join(cells.select("hex_id", group), "hex_id").join(cells.select(F.col("hex_id").alias("nbr"), F.col(group).alias("__other")), "nbr")
    inner = near.where(F.col(group) == F.col("__other")).groupBy(group).agg(F.count("*").alias("inner"))
    whole = cells.groupBy(group).agg(F.count("*").alias("cells")).join(inner, group, "left")
    return whole.select(group, "cells", (F.col("cells") * (1.5 * math.sqrt(3.0) * size * size)).alias("area"), ((6 * F.col("cells") - F.coalesce("inner", F.lit(0))) * size).alias("outline"))


def web_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Spherical Mercator in radians: x east, y north."""
    return F.radians(lon), F.log(F.tan(math.pi / 4 + F.radians(lat) / 2))


def fit_to_canvas(points: DataFrame, width: float, height: float, margin: float) -> DataFrame:
    """points (x, y) with px, py: scaled alike on both axes into a canvas with a margin, north up."""
    e = points.agg(F.min("x").alias("__x0"), F.max("x").alias("__x1"), F.min("y").alias("__y0"), F.max("y").alias("__y1"))
    scale = F.least((width - 2 * margin) / (F.col("__x1") - F.col("__x0")), (height - 2 * margin) / (F.col("__y1") - F.col("__y0")))
    placed = points.join(F.broadcast(e), how="cross")  # one row
    return placed.select(*points.columns, (margin + (F.col("x") - F.col("__x0")) * scale).alias("px"), (margin + (F.col("__y1") - F.col("y")) * scale).alias("py"))
