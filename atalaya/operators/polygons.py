"""General polygons, with holes and several parts: overlay areas, unions as rings, outlines simplified without gaps.

A shape is a column `parts`: array of parts, each an array of rings, each an array of struct<x, y> without the closing point.
The first ring of a part is its outline, others are holes; the turn of the rings is free. Null and empty shapes, and rings of
fewer than three points, have no area and no edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import signed_area
from .tables import cut

#: Shape of the column parts.
PARTS = "array<array<array<struct<x:double,y:double>>>>"


def parts_of_wkt(text: Column) -> Column:
    """The parts of a POLYGON's or MULTIPOLYGON's WKT; null for other texts."""
    body = F.regexp_extract(text, r"(?s)^\s*(?:MULTI)?POLYGON\s*\((.*)\)\s*$", 1)
    bare = F.regexp_replace(body, r"\s*([(),])\s*", "$1")
    whole = F.when(F.startswith(bare, F.lit("((")), bare).otherwise(F.concat(F.lit("("), bare, F.lit(")")))
    number = lambda p, k: F.get(F.split(F.trim(p), r"\s+"), F.lit(k)).try_cast("double")
    point = lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y"))

    def ring(r: Column) -> Column:
        points = F.transform(F.split(r, ","), point)
        closed = (F.size(points) > 1) & (F.element_at(points, 1) == F.element_at(points, -1))
        return F.when(closed, F.slice(points, 1, F.size(points) - 1)).otherwise(points)

    inner = lambda t: F.regexp_replace(t, r"^\(+|\)+$", "")
    return F.when(body != "", F.transform(F.split(whole, r"\)\),\(\("), lambda part: F.transform(F.split(inner(part), r"\),\("), ring)))


def shape_edges(shapes: DataFrame, shape_id: str) -> DataFrame:
    """(shape_id, ax, ay, bx, by): the directed edges of all rings, with the inside on the left."""
    parts = shapes.select(shape_id, F.explode(F.col("parts")).alias("__part")).select(shape_id, F.posexplode("__part").alias("__k", "__ring")).where("size(__ring) > 2")
    area = signed_area(F.col("__ring"))
    turned = F.when((F.col("__k") == 0) == (area > 0), F.col("__ring")).otherwise(F.reverse("__ring"))
    rings = parts.where(area != 0).select(shape_id, turned.alias("__ring"))
    ends = F.zip_with("__ring", F.concat(F.slice("__ring", 2, F.size("__ring")), F.slice("__ring", 1, 1)), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return rings.select(shape_id, F.explode(ends).alias("e")).select(shape_id, "e.*")


def edge_areas(edges: DataFrame, shape_id: str) -> DataFrame:
    """(shape_id, area) of directed edges with the inside on the left."""
    return edges.groupBy(shape_id).agg((F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"))


def _slabs(edges: DataFrame, shape_id: str, slab: float, name: str) -> DataFrame:
    """shape_id, slab and the part of each sloping edge in it: lo, hi, line y = c + m x, sign +1 above the inside and -1 below."""
    lo, hi = F.least("ax", "bx"), F.greatest("ax", "bx")
    m = (F.col("by") - F.col("ay")) / (F.col("bx") - F.col("ax"))
    lines = edges.where("ax <> bx").select(shape_id, lo.alias("lo"), hi.alias("hi"), "ax", "ay", m.alias("m"), F.signum(F.col("ax") - F.col("bx")).alias("s"))
    cuts = lines.withColumn("slab", F.explode(F.sequence(F.floor(F.col("lo") / slab), F.floor(F.col("hi") / slab))))
    inside = cuts.select(shape_id, "slab", F.greatest("lo", F.col("slab") * slab).alias("lo"), F.least("hi", (F.col("slab") + 1) * slab).alias("hi"), "ax", "ay", "m", "s").where("lo < hi")
    return inside.select(shape_id, "slab", F.struct("lo", "hi", "ax", "ay", "m", "s").alias(name))


def overlay_areas(left: DataFrame, right: DataFrame, left_id: str, right_id: str, slab: float) -> DataFrame:
    """(left_id, right_id, area): the area that each left shape has in common with each right one; see overlay_edges."""
    return overlay_edges(shape_edges(left, left_id), shape_edges(right, right_id), left_id, right_id, slab)


def overlay_edges(a: DataFrame, b: DataFrame, left_id: str, right_id: str, slab: float) -> DataFrame:
    """(left_id, right_id, area) of two tables of directed edges, inside on the left; the names of the ids differ.

    A shape is the signed sum of the strips below its edges, so the area of two shapes' common part is the sum, over their
    edges, of the signed integral of the lower of two lines: exact for holes, bays and several parts, with no clipping.
    Edges are cut at vertical slabs of the given width and met by equi-joins on shape and slab, so neither a shape's edges
    nor a pair's stand in one row or task. Pairs without a common area are left out, but for rounding errors.
    """
    pa, pb = _slabs(a, left_id, slab, "a"), _slabs(b, right_id, slab, "b")
    reach = lambda e, k, n: e.groupBy(k).agg(F.min(F.least("ay", "by")).alias(f"{n}0"), F.max(F.greatest("ay", "by")).alias(f"{n}1"))
    held = lambda p, e, k, n: p.groupBy(k, "slab").agg(F.min(f"{n}.lo").alias(f"{n}l"), F.max(f"{n}.hi").alias(f"{n}h")).join(reach(e, k, f"{n}y"), k)
    tall = lambda h, n: h.withColumn("row", F.explode(F.sequence(F.floor(F.col(f"{n}y0") / slab), F.floor(F.col(f"{n}y1") / slab))))
    # Shapes whose extents within a slab overlap; each pair is met in the least row that both reach.
    pairs = tall(held(pa, a, left_id, "a"), "a").join(tall(held(pb, b, right_id, "b"), "b"), ["slab", "row"])
    pairs = pairs.where((F.col("row") == F.floor(F.greatest("ay0", "by0") / slab)) & (F.col("al") < F.col("bh")) & (F.col("bl") < F.col("ah")) & (F.col("ay0") < F.col("by1")) & (F.col("by0") < F.col("ay1")))
    met = pairs.select(left_id, right_id, "slab", F.least("ay0", "by0").alias("base")).join(pa, [left_id, "slab"]).join(pb, [right_id, "slab"])
    x0, x1 = F.greatest("a.lo", "b.lo"), F.least("a.hi", "b.hi")
    met = met.withColumn("x0", x0).withColumn("x1", x1).where("x0 < x1")
    at = lambda n, x: F.col(f"{n}.ay") + F.col(f"{n}.m") * (F.col(x) - F.col(f"{n}.ax")) - F.col("base")
    met = met.select(left_id, right_id, (F.col("a.s") * F.col("b.s")).alias("s"), (F.col("x1") - F.col("x0")).alias("w"), at("a", "x0").alias("a0"), at("a", "x1").alias("a1"), at("b", "x0").alias("b0"), at("b", "x1").alias("b1"))
    # The lower line's mean height; where the lines cross, the triangle cut off above is taken from the lower chord.
    d0, d1 = F.col("a0") - F.col("b0"), F.col("a1") - F.col("b1")
    upper = (F.col("a0") + F.col("a1")) / 2
    crossed = F.when(d0 > 0, d0 * d0).otherwise(d1 * d1) / F.when(d0 * d1 < 0, F.abs(d0) + F.abs(d1)) / 2
    lower = F.when(d0 * d1 < 0, upper - crossed).when(d0 + d1 > 0, (F.col("b0") + F.col("b1")) / 2).otherwise(upper)
    area = met.groupBy(left_id, right_id).agg(F.sum(F.col("s") * F.col("w") * lower).alias("area"))
    return area.where("area > 0")


def _snapped(edges: DataFrame, keys: list[str], snap: float) -> DataFrame:
    """keys, a, b: edges between points on a lattice of width snap, as structs of longs."""
    point = lambda p: F.struct(F.round(F.col(f"{p}x") / snap).cast("long").alias("x"), F.round(F.col(f"{p}y") / snap).cast("long").alias("y"))
    return edges.select(*keys, point("a").alias("a"), point("b").alias("b")).where("a <> b")


def union_edges(edges: DataFrame, group: str, snap: float = 1e-3) -> DataFrame:
    """(group, ax, ay, bx, by): the outline of each group's union, inside on the left.

    The shapes of a group may share edges but not area, and neighbours must have the same points along a common edge (as
    cells and census tracts have); points nearer than snap are one. An edge that runs both ways within a group is inner.
    """
    e = _snapped(edges, [group], snap)
    once = e.select(group, F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), F.when(F.col("a") < F.col("b"), 1).otherwise(-1).alias("way"))
    left = once.groupBy(group, "p", "q").agg(F.sum("way").alias("way")).where("way <> 0")
    a, b = F.when(F.col("way") > 0, F.col("p")).otherwise(F.col("q")), F.when(F.col("way") > 0, F.col("q")).otherwise(F.col("p"))
    return left.select(group, a.alias("a"), b.alias("b")).select(group, *[(F.col(f"{e}.{k}") * snap).alias(e + k) for e in "ab" for k in "xy"])


def chain_rings(edges: DataFrame, group: str, snap: float = 1e-3) -> DataFrame:
    """(group, ring_id, ring, area): directed edges chained into rings; outlines have positive area, holes negative.

    Where several edges leave a point the sharpest turn to the left is taken, so parts that touch in a point stay apart.
    Rings are found by pointer jumping: each round doubles how far an edge looks ahead for the ring's least edge and keeps the
    steps to it, so rings of n edges take log2 n rounds of one join; only a finished ring is put together in one row.
    """
    e = _snapped(edges, [group], snap).withColumn("e", F.struct("a", "b"))
    ahead = e.select(group, F.col("a").alias("b"), F.col("e").alias("next"))
    way = lambda s: F.atan2((F.col(f"{s}.b.y") - F.col(f"{s}.a.y")).cast("double"), (F.col(f"{s}.b.x") - F.col(f"{s}.a.x")).cast("double"))
    full = 2 * 3.141592653589793
    # Turn from the reversed edge, clockwise: the least positive one is the sharpest left.
    turn = F.pmod(way("next") - way("e"), F.lit(full))
    left = F.when(turn > full / 2, turn - full).otherwise(turn)
    step = e.join(ahead, [group, "b"]).groupBy(group, "e").agg(F.max_by("next", left).alias("next"))
    state = cut(step.select(group, "e", "next", F.least("e", "next").alias("least"), F.when(F.col("next") < F.col("e"), 1).otherwise(0).cast("long").alias("dist"), F.lit(1).cast("long").alias("span")))
    while True:
        far = state.select(group, F.col("e").alias("next"), F.col("next").alias("__next"), F.col("least").alias("__least"), F.col("dist").alias("__dist"))
        new = state.join(far, [group, "next"])
        nearer = F.col("__least") < F.col("least")
        new = cut(new.select(group, "e", F.col("__next").alias("next"), F.least("least", "__least").alias("least"), F.when(nearer, F.col("span") + F.col("__dist")).otherwise(F.col("dist")).alias("dist"), (F.col("span") * 2).alias("span"), nearer.alias("moved")))
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    place = F.struct(F.when(F.col("dist") == 0, F.lit(-(2**62))).otherwise(-F.col("dist")).alias("at"), (F.col("e.a.x") * snap).alias("x"), (F.col("e.a.y") * snap).alias("y"))
    rings = state.groupBy(group, "least").agg(F.sort_array(F.collect_list(place)).alias("p"))
    ring = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    out = rings.select(group, F.xxhash64("least").alias("ring_id"), ring.alias("ring"))
    return out.withColumn("area", signed_area(F.col("ring")))


def simplify_coverage(edges: DataFrame, group: str, tolerance: float, tile: float, snap: float = 1e-3) -> DataFrame:
    """(group, ax, ay, bx, by): outlines of neighbouring shapes simplified alike, so no gaps and no overlaps appear.

    Points are removed whose triangle with the two points next to them is smaller than tolerance, least triangles first, as
    points of the whole coverage: a border is simplified once for both its sides. Points where borders meet stay. All points
    that are least among their neighbours go in one round. None goes whose triangle holds another point, or whose new edge is
    there already; so borders never cross and rings never collapse. Tiles of the given width find the points in a triangle.
    """
    key = lambda p, q: [F.least(p, q).alias("p"), F.greatest(p, q).alias("q")]
    own = cut(_snapped(edges, [group], snap))
    while True:
        ends = own.select(F.col("a").alias("v"), F.col("b").alias("n")).unionAll(own.select(F.col("b").alias("v"), F.col("a").alias("n"))).distinct()
        # At most two neighbours are kept in a row; points with more are junctions.
        spots = ends.groupBy("v").agg(F.count("*").alias("k"), F.min("n").alias("u"), F.max("n").alias("w"))
        cross = (F.col("u.x") - F.col("v.x")).cast("double") * (F.col("w.y") - F.col("v.y")) - (F.col("w.x") - F.col("v.x")).cast("double") * (F.col("u.y") - F.col("v.y"))
        spots = spots.withColumn("size", F.when(F.col("k") == 2, F.abs(cross) / 2 * snap * snap).otherwise(F.lit(float("inf")))).withColumn("rank", F.struct("size", "v"))
        free = spots.where(F.col("size") < tolerance)
        ranks = spots.select(F.col("v").alias("n"), F.col("rank").alias("near"))
        around = ends.join(ranks, "n").groupBy("v").agg(F.min("near").alias("near"))
        going = free.join(around, "v").where(F.col("rank") < F.col("near")).select("v", "u", "w", "rank")
        # One removal for each new edge, none for an edge that exists.
        sides = ends.where(F.col("v") < F.col("n")).select(F.col("v").alias("p"), F.col("n").alias("q"))
        going = going.select("v", *key("u", "w"), "rank").join(sides, ["p", "q"], "left_anti")
        going = going.groupBy("p", "q").agg(F.min_by("v", "rank").alias("v"))
        step = int(tile / snap)
        span = lambda k: F.sequence(F.floor(F.least(f"p.{k}", f"q.{k}", f"v.{k}") / step), F.floor(F.greatest(f"p.{k}", f"q.{k}", f"v.{k}") / step))
        boxed = going.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))
        others = spots.select(F.col("v").alias("o"), F.floor(F.col("v.x") / step).alias("tx"), F.floor(F.col("v.y") / step).alias("ty"))
        side = lambda s, t: (F.col(f"{t}.x") - F.col(f"{s}.x")).cast("double") * (F.col("o.y") - F.col(f"{s}.y")) - (F.col(f"{t}.y") - F.col(f"{s}.y")).cast("double") * (F.col("o.x") - F.col(f"{s}.x"))
        a, b, c = side("p", "v"), side("v", "q"), side("q", "p")
        within = ((a >= 0) & (b >= 0) & (c >= 0)) | ((a <= 0) & (b <= 0) & (c <= 0))
        held = boxed.join(others, ["tx", "ty"]).where((F.col("o") != F.col("p")) & (F.col("o") != F.col("q")) & (F.col("o") != F.col("v")) & within).select("v").distinct()
        going = cut(going.join(held, "v", "left_anti").select("v", "p", "q"))
        if going.isEmpty():
            break
        # Two neighbours never go in one round, so an edge has at most one end that goes.
        gone_a, gone_b = going.select(F.col("v").alias("a"), F.lit(True).alias("ga")), going.select(F.col("v").alias("b"), F.col("p").alias("bp"), F.col("q").alias("bq"))
        marked = own.join(gone_a, "a", "left").join(gone_b, "b", "left").where("ga IS NULL")  # the edge into a removed point goes on to its other end
        end = F.when(F.col("bp").isNull(), F.col("b")).when(F.col("bp") == F.col("a"), F.col("bq")).otherwise(F.col("bp"))
        own = cut(marked.select(group, "a", end.alias("b")))
    return own.select(group, *[(F.col(f"{e}.{k}") * snap).alias(e + k) for e in "ab" for k in "xy"])
