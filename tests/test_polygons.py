"""General polygons against scan lines, tilings and plain chains."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from atalaya.operators import polygons
from atalaya.plans import polygon_queries

SHAPE = f"id long, parts {polygons.PARTS}"


def star(rng, x, y, low, high, n=24):
    turn = np.sort(rng.uniform(0, 2 * math.pi, n))
    far = rng.uniform(low, high, n)
    return [(float(x + f * math.cos(t)), float(y + f * math.sin(t))) for t, f in zip(turn, far)]


def scan(shape, ys):
    """For each height the sorted crossings of all rings: pairs are inside (even-odd)."""
    out = []
    for y in ys:
        xs = []
        for part in shape:
            for ring in part:
                for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                    if (ay > y) != (by > y):
                        xs.append(ax + (y - ay) / (by - ay) * (bx - ax))
        out.append(sorted(xs))
    return out


def common(p, q):
    total = 0.0
    for a, b in zip(p[::2], p[1::2]):
        for c, d in zip(q[::2], q[1::2]):
            total += max(0.0, min(b, d) - max(a, c))
    return total


def test_overlay_equals_scan_lines(spark):
    rng = np.random.default_rng(5)
    # Stars with a hole, of either turn, in two parts; the inner star lies within the outer one.
    shapes = lambda n: [[[star(rng, x, y, 60, 100), star(rng, x, y, 10, 50)[::flip]], [star(rng, x + 250, y, 30, 90)]] for flip in (1, -1) for x, y in rng.uniform(0, 150, (n, 2))]
    left, right = shapes(4), shapes(3)
    frame = lambda s, k: spark.createDataFrame(list(enumerate(s)), SHAPE).withColumnRenamed("id", k)
    got = {(r.l, r.r): r.area for r in polygons.overlay_areas(frame(left, "l"), frame(right, "r"), "l", "r", 37.0).collect()}
    ys = np.arange(-150, 350, 0.05) + 0.013
    lines = [[scan(s, ys) for s in side] for side in (left, right)]
    for i, a in enumerate(lines[0]):
        for j, b in enumerate(lines[1]):
            exact = sum(common(p, q) for p, q in zip(a, b)) * 0.05
            assert abs(got.get((i, j), 0.0) - exact) <= 1e-3 * exact + 1e-6


def test_overlay_with_a_tiling_keeps_all_area(spark):
    rng = np.random.default_rng(6)
    left = spark.createDataFrame([(k, [[star(rng, 300, 300, 20, 290, 200)]]) for k in range(3)], SHAPE)
    box = lambda i, j: [[[(i * 100.0, j * 100.0), (i * 100.0, j * 100 + 100.0), (i * 100 + 100.0, j * 100 + 100.0), (i * 100 + 100.0, j * 100.0)]]]
    tiles = spark.createDataFrame([(10 * i + j, box(i, j)) for i in range(6) for j in range(6)], SHAPE).withColumnRenamed("id", "tile")
    whole = {r.id: r.area for r in polygons.edge_areas(polygons.shape_edges(left, "id"), "id").collect()}
    for slab in (7.0, 1000.0):
        parts = polygons.overlay_areas(left, tiles, "id", "tile", slab).groupBy("id").agg(F.sum("area").alias("area")).collect()
        assert {r.id for r in parts} == set(whole)
        for r in parts:
            assert math.isclose(r.area, whole[r.id], rel_tol=1e-9)


def test_empty_null_and_flat_shapes_have_no_area(spark):
    odd = [(1, None), (2, []), (3, [[]]), (4, [[[]]]), (5, [[[(0.0, 0.0), (1.0, 1.0)]]]), (6, [[[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)]]]), (7, [[[(0.0, 0.0), (None, 1.0), (2.0, 5.0)]]])]
    box = spark.createDataFrame([(1, [[[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]]])], SHAPE)
    shapes = spark.createDataFrame(odd, SHAPE).withColumnRenamed("id", "other")
    assert polygons.overlay_areas(box, shapes, "id", "other", 2.0).count() == 0
    assert polygons.chain_rings(polygons.union_edges(polygons.shape_edges(shapes, "other"), "other"), "other").count() == 0


def test_parts_of_wkt(spark):
    texts = ["POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.1 5.1,5.2 5.1, 5.2 5.2)))", "POINT (1 2)", "POLYGON EMPTY", None]
    rows = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(polygons.parts_of_wkt(F.col("t")).alias("p")).collect()]
    assert [[len(part) for part in p] if p else p for p in rows] == [[2], [1, 2], None, None, None]
    assert [tuple(x) for x in rows[1][1][1]] == [(5.1, 5.1), (5.2, 5.1), (5.2, 5.2)]


def squares(spark, places):
    box = lambda i, j: [[[(i, j), (i + 1.0, j), (i + 1.0, j + 1.0), (i, j + 1.0)]]]
    return polygons.shape_edges(spark.createDataFrame([(g, box(float(i), float(j))) for g, i, j in places], SHAPE), "id")


def test_union_keeps_holes_and_parts_that_touch_apart(spark):
    frame = [(1, i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    touch = [(2, 0, 0), (2, 1, 1)]
    rings = polygons.chain_rings(polygons.union_edges(squares(spark, frame + touch), "id"), "id").collect()
    assert sorted((r.id, round(r.area, 6), len(r.ring)) for r in rings) == [(1, -1.0, 4), (1, 9.0, 12), (2, 1.0, 4), (2, 1.0, 4)]


def test_long_ring_is_one_chain(spark):
    rings = polygons.chain_rings(polygons.union_edges(squares(spark, [(1, i, 0) for i in range(150)]), "id"), "id").collect()
    assert [(len(r.ring), r.area) for r in rings] == [(302, 150.0)]
    steps = [abs(a.x - b.x) + abs(a.y - b.y) for a, b in zip(rings[0].ring, rings[0].ring[1:])]
    assert all(math.isclose(s, 1.0) for s in steps)


def crossing(a, b):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    (p, q), (r, s) = a, b
    return side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0


def test_simplified_borders_have_no_gaps(spark):
    rng = np.random.default_rng(7)
    places = [(int(i // 4 + 3 * (j // 4) + (rng.random() < 0.15)), i, j) for i in range(12) for j in range(12)]
    before = polygons.union_edges(squares(spark, places), "id")
    after = polygons.simplify_coverage(before, "id", 1.1, 2.0).collect()
    edges = [(r.id, (round(r.ax, 3), round(r.ay, 3)), (round(r.bx, 3), round(r.by, 3))) for r in after]
    assert len(edges) < before.count()
    # Each edge has its twin in one other shape or lies on the rim, whose area is that of all shapes together.
    ways = Counter((a, b) for _, a, b in edges)
    assert max(ways.values()) == 1
    rim = [(a, b) for a, b in ways if (b, a) not in ways]
    shoelace = lambda es: sum(a[0] * b[1] - b[0] * a[1] for a, b in es) / 2
    assert math.isclose(shoelace(rim), shoelace(ways), abs_tol=1e-6)
    once = [(a, b) for a, b in ways if a < b or (b, a) not in ways]
    assert not any(crossing(e, f) for k, e in enumerate(once) for f in once[:k])
    # No shape is lost, and in and out edges balance at each point.
    assert {g for g, _, _ in edges} == {g for g, _, _ in places}
    assert Counter((g, a) for g, a, _ in edges) == Counter((g, b) for g, _, b in edges)


def test_simplified_outlines_query(spark, sf_dir):
    rows = polygon_queries.g13_simplified_outlines(spark, sf_dir).collect()
    assert rows and all(r.points >= 3 for r in rows)
