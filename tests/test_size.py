"""What keeps queries whole on larger tables: expressions and rows that do not multiply, and results next to plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from atalaya import bindings as b
from atalaya.operators import boosting, grid, panel, series, spatial, statistics
from atalaya.plans.panel_queries import dense


def nested(df) -> int:
    """How often the optimized plan names a fold over an array."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(")


@pytest.mark.parametrize("query", ["j17_overlay_area", "g11_area_interpolation", "a11_largest_overlap"])
def test_overlaps_are_worked_out_once(spark, sf_dir, query):
    assert nested(entry.queries()[query](spark, sf_dir)) < 20


def test_overlap_of_turned_and_level_rings(spark):
    turn = lambda x, y, a: (x * math.cos(a) - y * math.sin(a), x * math.sin(a) + y * math.cos(a))
    rows = [(i, [dict(zip("xy", turn(*p, a), strict=True)) for p in ((-1, -1), (1, -1), (1, 1), (-1, 1))], -5.0, -5.0, 5.0, 0.0) for i, a in enumerate((0.0, 0.3, math.pi / 2))]
    df = spatial.overlap_area(spark.createDataFrame(rows, "i int, ring array<struct<x:double,y:double>>, x0 double, y0 double, x1 double, y1 double"), "ring", ("x0", "y0", "x1", "y1"))
    assert nested(df.where("area > 0.001")) < 20
    assert [round(r.area, 9) for r in df.where("area > 0.001").orderBy("i").collect()] == [2.0, 2.0, 2.0]  # half of each


def test_cells_of_a_polygon_are_dealt_to_all_tasks(spark):
    ring = "array(struct(0d AS x, 0d AS y), struct(9000d AS x, 0d AS y), struct(9000d AS x, 7000d AS y), struct(0d AS x, 7000d AS y))"
    cells = spatial.cells_of_polygons(spark.sql(f"SELECT 1 AS id, {ring} AS ring"), 100.0, "id")
    assert nested(cells) < 20 and len({r.task for r in cells.select(F.spark_partition_id().alias("task")).collect()}) > 1


def test_cells_beyond_row_200_and_of_no_area(spark):
    ring = "array(struct(0d AS x, 150000d AS y), struct(900d AS x, 150000d AS y), struct(900d AS x, 150700d AS y), struct(0d AS x, 150700d AS y))"
    high = spatial.cells_of_polygons(spark.sql(f"SELECT 1 AS id, {ring} AS ring"), 443.0, "id").collect()
    assert high and min(r.r for r in high) > 200
    flat = "array(struct(0d AS x, 0d AS y), struct(900d AS x, 0d AS y), struct(300d AS x, 0d AS y))"
    assert not spatial.cells_of_polygons(spark.sql(f"SELECT 1 AS id, {flat} AS ring"), 443.0, "id").collect()


def test_weekly_features_are_those_of_the_panel(spark, sf_dir):
    """The same rows, and nothing of the panel's size is sorted or exchanged."""
    got = series.weekly_features(b.cells(spark, sf_dir), b.incidents(spark, sf_dir), b.ring(spark, sf_dir), ("A", "R"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "sequence(" not in plan
    want = panel.lag_features(dense(spark, sf_dir, "week", near=True), "week")
    columns = want.columns
    assert {tuple(r) for r in got.select(columns).collect()} == {tuple(r) for r in want.collect()}
    own = panel.lag_features(dense(spark, sf_dir, "week", tipo="R"), "week").selectExpr("hex_id", "period", "turno", "y", "lag_1", "roll_4", "roll_12")
    assert {tuple(r) for r in got.select("hex_id", "period", "turno", "y_R", "lag_1_R", "roll_4_R", "roll_12_R").collect()} == {tuple(r) for r in own.collect()}


def test_only_the_smaller_child_is_counted(spark):
    """Blocks hold training and validation rows only, and what is left of a parent is the other child's sums."""
    rng = np.random.default_rng(5)
    rows = [(float(a), float(a > 6) + float(e), int(s)) for a, e, s in zip(rng.integers(0, 9, 900), rng.random(900), rng.integers(0, 3, 900), strict=True)]
    df = spark.createDataFrame(rows, "a double, y double, part int")
    bins = boosting.fit_bins(df, ["a"])
    coded, model = boosting.binned(df, bins, ["y", "part"]), boosting.Model("m", "y", "part", ("a",))
    assert coded.columns == ["y", "part", "bins"]
    plain = coded.where("part < 2").selectExpr("bins", "y", "cast(part AS double) AS part")
    base = boosting._packed(plain, ["y", "part"], 1, 1).cache()
    assert base.count() <= plain.rdd.getNumPartitions() and base.agg(F.sum("n")).first()[0] == sum(s < 2 for *_, s in rows)
    tree = boosting.Tree(np.full(7, -1), [None] * 7, np.zeros(7))
    whole = boosting._sums(base, [model], bins, [0.0], [[]], {0: tree}, 0, {})
    boosting.grow_level(tree, 0, {0: whole[0, 0]}, bins, model, 0.1, 1)
    both = boosting._sums(base, [model], bins, [0.0], [[]], {0: tree}, 1, whole)
    for node, side in ((1, tree.left[0]), (2, ~tree.left[0])):
        for k in range(3):
            assert np.allclose(both[0, node][k], np.where(side, whole[0, 0][k], 0.0))
    assert len(boosting._smaller(tree, 1, {0: whole[0, 0]}, bins.sizes())) == 1


def test_permutations_are_not_rows(spark, sf_dir):
    """The hash is Spark's, and a test of many repetitions joins and explodes no more rows than one of few."""
    df = spark.range(-3, 40).selectExpr("id", "cast(id AS int) AS i")
    for r in df.select("id", F.xxhash64("id", F.lit(7), F.lit(42)).alias("l"), F.xxhash64("i", F.lit(7), F.lit(42)).alias("s")).collect():
        for whole, want in ((True, r.l), (False, r.s)):
            got = statistics._xxhash64(42, statistics._xxhash64(7, statistics._xxhash64(r.id, 42, whole), False), False)
            assert got.astype(np.int64)[0] == want
    cells = b.cells(spark, sf_dir)
    values, weights = cells.selectExpr("hex_id", "x + 300 * (hex_id % 3) AS v"), grid.contiguity(b.ring(spark, sf_dir))
    for test in (statistics.moran_permutations, statistics.local_moran_p):
        plan = test(values, weights, reps=999)._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroups" in plan
    v, w = {r.hex_id: r.v for r in values.collect()}, weights.collect()
    mean = sum(v.values()) / len(v)
    ids, z = sorted(v), {h: v[h] - mean for h in v}
    moran = lambda z: sum(e.w * z[e.hex_id] * z[e.nbr] for e in w) / sum(x * x for x in z.values())
    above = 0
    for rep in range(1, 20):
        key = {h: statistics._xxhash64(42, statistics._xxhash64(rep, statistics._xxhash64(h, 42, True), False), False).astype(np.int64)[0] for h in ids}
        above += moran(dict(zip(ids, [z[h] for h in sorted(ids, key=lambda h: (key[h], h))], strict=True))) >= moran(z)
    got = statistics.moran_permutations(values, weights, reps=19).first()
    assert abs(got.moran - moran(z)) < 1e-9 and abs(got.p - (above + 1) / 20) < 1e-9


def test_far_points_go_down_the_squares(spark, monkeypatch):
    """Buckets are never wider than twice the first radius, and points far from all segments find what brute force finds, ties by id."""
    rng, widths, join = np.random.default_rng(11), [], spatial.points_near_segments
    monkeypatch.setattr(spatial, "points_near_segments", lambda p, s, radius, *ids: (widths.append(radius), join(p, s, radius, *ids))[1])
    a = rng.uniform(-300, 300, (60, 2))
    segs = [(i, *map(float, p), *map(float, p + d)) for i, (p, d) in enumerate(zip(a, rng.uniform(-60, 60, (60, 2)), strict=True))] + [(60, 0.0, 0.0, 9.0, 0.0), (61, 0.0, 0.0, 9.0, 0.0), (62, None, 0.0, 1.0, 1.0)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-5000, 5000, (40, 2)))] + [(40, 4.0, -1.0), (41, None, 0.0)]
    df = spark.createDataFrame(segs, "seg int, x1 double, y1 double, x2 double, y2 double")
    got = spatial.nearest_segment(spark.createDataFrame(points, "p int, x double, y double"), df, 20.0, "p", "seg").collect()

    def plain(x, y, x1, y1, x2, y2):
        t = min(1, max(0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
        return round(math.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)), 6)

    want = {i: min((plain(x, y, *s[1:]), s[0]) for s in segs[:-1]) for i, x, y in points[:-1]}
    assert {r.p: r.seg for r in got} == {i: s for i, (_, s) in want.items()} and len(got) == len(want)
    assert all(abs(r.dist - want[r.p][0]) < 2e-6 for r in got) and max(widths) <= 40
    assert spatial.nearest_segment(spark.createDataFrame(points, "p int, x double, y double"), df.where("seg < 0"), 20.0, "p", "seg").count() == 0


def test_daily_sums_make_no_panel(spark, sf_dir):
    got = entry.queries()["w01_daily_panel"](spark, sf_dir)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "sequence(" not in plan
    want = panel.lag_features(dense(spark, sf_dir, "day", near=True), "day").groupBy("hex_id", "turno").agg(F.count("*").alias("rows_n"), *[F.sum(c).alias(c) for c in got.columns[3:]])
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_the_surface_is_fitted_to_a_stored_table(spark, sf_dir):
    """Rounds of the fit read columns of a file; the panel is not made again for each."""
    plan = entry.queries()["l01_tweedie_surface"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
