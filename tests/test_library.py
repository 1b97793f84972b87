"""The reference's unit assertions, invariants of the operators, and every query against its SQL on the small tables."""

import itertools
import math
import random
import zipfile
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from atalaya import bindings as b
from atalaya.functions import scalars
from atalaya.functions.scalars import SHIFTS, day_first, hour_of, percent_rank_average, period_date, shift_of, single_date, thousands, wkt_point
from atalaya.operators import allocation, forecast, graph, grid, metrics, models, panel, spatial, statistics
from atalaya.plans import ORACLES, QUERIES
from atalaya.sources import readers
from atalaya.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Checked here; all of them are checked by the driver.
SAMPLE = ["flagship_hotspots", "w03_weekly_panel", "m01_moran", "j14_point_in_polygon", "j17_overlay_area", "r02_reachable", "e06_conformal", "a27_lorenz", "k05_horizon_bands", "o07_camera_weights", "a12_profiles", "w09_activity", "g03_cells_of_polygons", "o04_ranked_coverage", "o01_small_plans", "m03_local_moran_p", "e08_historical_means", "s12b_normalised_flow", "o10_buffer_sweep"]


def test_shifts(spark):
    hours = spark.createDataFrame([(h,) for h in range(24)], "h int").select("h", shift_of(hour_of(F.col("h"))).alias("t")).collect()
    assert {r.t for r in hours} == set(SHIFTS)
    by = {r.h: r.t for r in hours}
    assert [by[h] for h in (5, 6, 13, 14, 21, 22, 1, 2)] == ["Madrugada", "Mañana", "Mañana", "Tarde", "Tarde", "Noche", "Noche", "Madrugada"]
    texts = spark.createDataFrame([("06:30:00",), ("14:15:00",), ("23:00:00",), ("x",), (None,)], "h string").select(shift_of(hour_of(F.col("h"))).alias("t")).collect()
    assert [r.t for r in texts] == ["Mañana", "Tarde", "Noche", None, None]


def test_parsers(spark):
    r = spark.range(1).select(
        single_date(F.lit("el 3/4/2019")).alias("a"), single_date(F.lit("3/4/2019 y 5/4/2019")).alias("c"), day_first(F.lit("3/4/2019 7:05")).cast("string").alias("d"), period_date(F.lit(201902), F.lit("30")).alias("e"),
        period_date(F.lit(201902), F.lit(28)).alias("f"), thousands(F.lit("1.234,5")).alias("g"), wkt_point(F.lit("POINT (-58.4 -34.6)"))[0].alias("h"),
    ).first()
    assert (r.a, r.c, r.d, r.e, r.f, r.g, r.h) == (date(2019, 4, 3), None, "2019-04-03 07:05:00", None, date(2019, 2, 28), 1234.5, -58.4)


def test_cells(spark):
    pts = spark.createDataFrame([(0.0, 0.0), (None, 1.0), (800.0, 10.0)], "x double, y double")
    q, r = grid.axial_cell(F.col("x"), F.col("y"), 443.0)
    got = pts.select(q.alias("q"), r.alias("r")).collect()
    assert (got[0].q, got[0].r) == (0, 0)
    assert got[1].q is None
    assert (got[2].q, got[2].r) == (1, 0)
    assert [sum(k == n for k, _, _ in grid.offsets(2)) for n in (1, 2)] == [6, 12]


@pytest.mark.parametrize(("real", "pred", "k", "pai", "pei"), [([1] * 100, [1] * 100, 0.2, 1.0, 1.0), ([10] * 20 + [0] * 80, list(range(100, 0, -1)), 0.2, 5.0, 1.0), (list(range(50)), list(range(50)), 0.3, None, 1.0)])
def test_pai_pei(spark, real, pred, k, pai, pei):
    df = spark.createDataFrame([(i, float(x), float(p)) for i, (x, p) in enumerate(zip(real, pred, strict=True))], "hex_id int, real double, pred double")
    r = metrics.hotspots(df, [k]).first()
    assert pai is None or abs(r.pai - pai) < 1e-9
    assert abs(r.pei - pei) < 1e-9
    worse = metrics.hotspots(df.withColumn("pred", -F.col("pred")), [k]).first()
    assert worse.pei <= 1


def test_percent_rank(spark):
    got = spark.createDataFrame([(1,), (2,), (2,), (5,), (None,)], "v int").select("v", percent_rank_average(F.col("v")).alias("p")).collect()
    assert sorted((r.v, r.p) for r in got if r.v) == [(1, 0.25), (2, 0.625), (2, 0.625), (5, 1.0)]


def test_no_leak(spark, sf_dir):
    cells, x = b.cells(spark, sf_dir), b.incidents(spark, sf_dir)
    more = x.unionByName(x.where("fecha >= '2000-06-01'"))
    build = lambda i: panel.lag_features(panel.dense_panel(cells, panel.period_counts(i, "week"), "2000-01-01", "2000-12-31", "week"), "week").where("period <= '2000-05-29'").drop("y")
    assert build(x).exceptAll(build(more)).count() == 0


def test_mass_is_kept(spark, sf_dir):
    pairs = QUERIES["g11_area_interpolation"](spark, sf_dir)
    assert pairs.where("people < 0").count() == 0
    shares = QUERIES["w04_population_share"](spark, sf_dir).agg(F.sum("people")).first()[0]
    homes = b.table(spark, sf_dir, "customer").join(b.cells(spark, sf_dir).select("comuna_id").distinct(), F.col("c_nationkey") == F.col("comuna_id")).count()
    assert abs(shares - homes) < 0.001 * homes


def test_greedy_cover(spark):
    cov = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (3, 13)], "candidate long, demand long")
    dem = spark.createDataFrame([(10, 5.0, 1), (11, 4.0, 1), (12, 3.0, 1), (13, 1.0, 2), (14, 7.0, 3)], "demand long, weight double, comuna_id int")
    assert [r.candidate for r in allocation.greedy_cover(cov, dem, 3).collect()] == [1, 2, 3]
    floor = allocation.greedy_cover(cov, dem, 2, floor="comuna_id")
    assert [r.candidate for r in floor.collect()] == [1, 3]
    assert allocation.plan_state(floor, cov, dem, "comuna_id").first().estado == "feasible"
    covered = [r.covered for r in allocation.greedy_cover(cov, dem, 3).collect()]
    assert covered == sorted(covered)


def test_reachable_has_no_last_round(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(110)], "u long, v long, length_m double")
    got = graph.reachable(spark.createDataFrame([(0,)], "source long"), chain, 1000.0).collect()
    assert {(r.node, r.dist) for r in got} == {(i, float(i)) for i in range(111)}


def test_reachable(spark):
    edges = spark.createDataFrame([(1, 2, 300.0), (2, 3, 300.0), (1, 3, 700.0), (3, 4, 300.0)], "u long, v long, length_m double")
    got = {(r.node, r.dist) for r in graph.reachable(spark.createDataFrame([(1,)], "source long"), edges, 800.0).collect()}
    assert got == {(1, 0.0), (2, 300.0), (3, 600.0)}


def test_geometry(spark):
    ring = spatial.ring_of_wkt(F.lit("POLYGON ((0 0, 4 0, 4 2, 0 2, 0 0))"))
    cx, cy = spatial.ring_centroid(ring)
    r = spark.range(1).select(spatial.signed_area(ring).alias("a"), spatial.ring_length(ring).alias("l"), cx.alias("x"), cy.alias("y"), spatial.contains(ring, F.lit(1.0), F.lit(1.0)).alias("i"), spatial.contains(ring, F.lit(5.0), F.lit(1.0)).alias("o")).first()
    assert (r.a, r.l, r.x, r.y, r.i, r.o) == (8.0, 12.0, 2.0, 1.0, True, False)
    x, y = spatial.transverse_mercator(F.lit(-90.0), F.lit(-60.0))
    p = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(p.x - 5_500_000) < 1e-3
    assert abs(p.y) < 1e-3


def test_forecast_models():
    import numpy as np

    months = np.arange(60.0)
    y = 100 + months + 10 * np.sin(2 * np.pi * months / 12)
    want = 100 + np.arange(60, 72) + 10 * np.sin(2 * np.pi * np.arange(60, 72) / 12)
    assert np.abs(forecast.holt_winters(y, 12) - want).max() < 8
    assert np.abs(forecast.regime_regression(months, y, 12) - want).max() < 12


def test_models(spark):
    daily = spark.createDataFrame([(c, t, (c * 7 + t * 3) % 4) for c in range(3) for t in range(20)], "hex_id long, t long, y int")
    a = {(r.hex_id, r.t): r.a for r in models.activity(daily, 5.0).collect()}
    import math

    phi, y = math.exp(-0.2), [(t * 3) % 4 for t in range(20)]
    state = 0.0
    for t in range(20):
        assert abs(a[0, t] - state) < 1e-9
        state = phi * state + (1 - phi) * y[t]
    ring = spark.createDataFrame([(0, 1, 1), (1, 0, 1), (1, 2, 2)], "hex_id long, nbr long, k long")
    fit = models.fit_hawkes(models.hawkes_design(daily, ring, 5.0), rounds=3)
    assert all(v >= 0 for v in fit.values())


def test_readers(spark, tmp_path):
    (tmp_path / "a_2019.csv").write_bytes("﻿ID ;Valor\n1;1,5\n2;SD\n".encode())
    got = readers.read_delimited(spark, str(tmp_path / "a_2019.csv"), sep=";", null="SD", required=["id", "valor"]).select("id", readers.decimal_comma(F.col("valor")).alias("v")).collect()
    assert [(r.id, r.v) for r in got] == [("1", 1.5), ("2", None)]
    yearly = readers.read_yearly(spark, [str(tmp_path / "a_2019.csv")], {"valor": "v"}, ["id", "v"], sep=";")
    assert {r.anio_archivo for r in yearly.collect()} == {2019}
    with pytest.raises(ValueError, match="missing"):
        readers.read_delimited(spark, str(tmp_path / "a_2019.csv"), sep=";", required=["other"])
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("one.csv", '﻿"A";"B"\n"1";"x"\n2;y\nbad\n')
        z.writestr("two.csv", "b,a\nz,3\n")
    (tmp_path / "broken.zip").write_bytes(b"PK no")
    got = readers.read_zip_members(spark, str(tmp_path / "*.zip"), ["a", "b"]).collect()
    assert sorted((r.a, r.b, r.member) for r in got) == [("1", "x", "one.csv"), ("2", "y", "one.csv"), ("3", "z", "two.csv")]
    (tmp_path / "p.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":"A"},"geometry":{"type":"Point","coordinates":[-58.4,-34.6]}}]}')
    r = readers.read_geojson(spark, str(tmp_path / "p.geojson"), ["n"]).first()
    assert (r.n, r.lon, r.lat) == ("A", -58.4, -34.6)
    (tmp_path / "w.json").write_text('{"T":{"20240101":20.5,"20240102":-999},"P":{"20240101":0.0,"20240102":3.0}}')
    got = readers.read_series_api(spark, str(tmp_path / "w.json"), {"T": "temp", "P": "rain"}).orderBy("fecha").collect()
    assert [(r.temp, r.rain) for r in got] == [(20.5, 0.0), (None, 3.0)]


def test_streaming(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.shift_counts(ingest.read_events(spark, str(tmp_path / "in"), "event_id long, ts timestamp, user_id long"), 10)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("shift_counts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("shift_counts").agg(F.sum("n")).first()[0] == events.count()


def _norm(v):
    if isinstance(v, float):
        return None if v != v else round(v, 5) + 0.0
    if isinstance(v, list):
        return tuple(map(_norm, v))
    return str(v)[:10] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(got.columns)
    want = sorted((tuple(_norm(r[names.index(c)]) for c in got.columns) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(map(_norm, r)) for r in got.collect()), key=str) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nearest_with_nulls_and_far_points(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 5.0), (3, 1e6, 1e6), (4, 3.0, None)], "a long, x double, y double")
    right = spark.createDataFrame([(10, 3.0, 4.0), (11, 0.0, 5.0), (12, None, 0.0)], "b long, x double, y double")
    got = {r.a: (r.b, r.dist) for r in spatial.nearest(left, right, "a", "b", 1.0).collect()}
    assert got[1] == (10, 5.0)
    assert got[2] == got[4] == (None, None)
    assert got[3][0] == 10
    none = spatial.nearest(left, right.where("false"), "a", "b", 1.0).collect()
    assert sorted(r.a for r in none) == [1, 2, 3, 4]
    assert all(r.b is None for r in none)


def test_nearest_segment_reaches_all_points(spark):
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, 9e4, 0.0), (3, None, 0.0)], "p long, x double, y double")
    segments = spark.createDataFrame([(7, 0.0, 0.0, 10.0, 0.0), (8, 0.0, 2.0, 10.0, 2.0)], "s long, x1 double, y1 double, x2 double, y2 double")
    got = {r.p: (r.s, r.dist) for r in spatial.nearest_segment(points, segments, 5.0, "p", "s").collect()}
    assert got == {1: (7, 1.0), 2: (7, 89990.0)}


@pytest.mark.parametrize("tau", [0.5, 3.0, 365.0])
def test_activity_over_ten_years(spark, tau):
    rng = random.Random(5)
    y = [rng.choice([0, 0, 1, 2]) for _ in range(3653)]
    got = [r.a for r in models.activity(spark.createDataFrame([(1, t, v) for t, v in enumerate(y)], "hex_id long, t long, y long"), tau).orderBy("t").collect()]
    phi, want = math.exp(-1 / tau), [0.0]
    for v in y[:-1]:
        want.append(phi * want[-1] + (1 - phi) * v)
    assert max(abs(a - w) for a, w in zip(got, want, strict=True)) < 1e-9


def test_hawkes_grid_finds_the_decay(spark):
    rng = random.Random(8)
    rows = []
    for cell in range(12):
        a, phi = 0.0, math.exp(-1 / 3)
        for t in range(300):
            lam, n, p = 0.2 + 0.6 * a, 0, rng.random()
            q = term = math.exp(-lam)
            while p > q:
                n += 1
                term *= lam / n
                q += term
            rows.append((cell, t, n))
            a = phi * a + (1 - phi) * n
    daily = spark.createDataFrame(rows, "hex_id long, t long, y long")
    ring = spark.createDataFrame([], "hex_id long, nbr long, k int")
    fits = models.tune_hawkes(daily, ring, (0.5, 3.0, 60.0), 240, 30).orderBy("nll").collect()
    assert fits[0].tau == 3.0
    assert abs(fits[0].theta0 - 0.6) < 0.15
    assert all(r.nll is not None for r in fits)


def test_cover_bound_and_floor(spark):
    rng = random.Random(2)
    cover = [(c, dm) for c in range(12) for dm in rng.sample(range(30), 6)]
    weights = [(dm, float(rng.randint(1, 9)), dm % 4) for dm in range(30)]
    plan = allocation.greedy_cover(spark.createDataFrame(cover, "candidate long, demand long"), spark.createDataFrame(weights, "demand long, weight double, g long"), 3).collect()
    by, total = {c: {dm for x, dm in cover if x == c} for c in range(12)}, sum(w for _, w, _ in weights)
    share = lambda sites: sum(w for dm, w, _ in weights if any(dm in by[c] for c in sites)) / total
    best = max(share(s) for s in itertools.combinations(range(12), 3))
    assert abs(plan[-1].covered - share([r.candidate for r in plan])) < 1e-9
    assert plan[-1].covered <= best + 1e-9 <= plan[-1].bound + 2e-9


def test_local_p_of_an_island(spark):
    values = spark.createDataFrame([(i, float(i % 5)) for i in range(9)], "hex_id long, v double")
    weights = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "hex_id long, nbr long, w double")
    got = {r.hex_id: r.p for r in statistics.local_moran_p(values, weights, 99).collect()}
    assert len(got) == 9
    assert got[5] == 1.0
    assert 0 < got[0] < 1


def test_polygon_cells_meet_their_area(spark):
    ring = "array(struct(0d AS x, 0d AS y), struct(900d AS x, 0d AS y), struct(900d AS x, 700d AS y), struct(0d AS x, 700d AS y))"
    for turned in (ring, f"reverse({ring})"):
        got = spatial.cells_of_polygons(spark.sql(f"SELECT 1 AS id, {turned} AS ring"), 100.0, "id").collect()
        cells = {(r.q, r.r) for r in got}
        assert len(cells) == len(got) and 24 <= len(cells) <= 50
        assert (0, 0) in cells


def test_scalars_of_the_last_rows(spark):
    df = spark.createDataFrame([('["a","b"]',), ("c",), (None,)], "t string")
    assert [list(r[0]) for r in df.select(scalars.as_list(F.col("t"))).collect()] == [["a", "b"], ["c"], []]
    one = spark.range(1).select(scalars.slug(F.lit("Línea  Ñandú 4")), scalars.capacity(F.lit("hasta 12.500 o más")), scalars.capacity(F.lit("sin")), scalars.crown_radius(F.lit(0.0), F.lit(10.0)))
    assert one.first()[:] == ("linea_nandu_4", 12500.0, None, 2.2)


def test_backtest_skips_short_histories(spark):
    series = spark.sql("SELECT 'a' AS tipo, add_months(date'2015-01-01', CAST(i AS INT)) AS ds, CAST(50 + i % 12 AS DOUBLE) AS y FROM range(48) t(i)")
    got = forecast.backtest_models(series, "tipo", 84).collect()
    assert len({r.origin for r in got}) == 12
    assert {r.model for r in got} == {"holt_winters", "regime"}
    assert forecast.backtest_models(series.where("ds < '2017-01-01'"), "tipo", 84).count() == 0
