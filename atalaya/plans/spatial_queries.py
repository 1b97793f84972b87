"""Queries of spatial joins, the road graph, allocation, forecasts, exports and the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import bindings as b
from ..functions.scalars import percent_rank_average
from ..operators import allocation, export, forecast, graph, grid, metrics, spatial
from .panel_queries import rounded
from .registry import query

S = b.CELL_SIZE


def points(spark: SparkSession, d: str) -> DataFrame:
    return b.pois(spark, d).select("poi_id", "clase", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


# --- spatial joins --------------------------------------------------------------------------------------------------


@query("j16_within_distance", "SELECT c.hex_id, p.clase, count(*) AS n FROM cells c JOIN pois p ON sqrt(pow(c.x - p.x, 2) + pow(c.y - p.y, 2)) <= 300 GROUP BY 1, 2")
def j16_within_distance(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    near = spatial.within_distance(b.cells(spark, d), p, 300.0, "hex_id", "poi_id")
    return near.join(p.select("poi_id", "clase"), "poi_id").groupBy("hex_id", "clase").agg(F.count("*").alias("n"))


@query("j15_nearest", "SELECT hex_id, poi_id, round(dist, 6) AS dist FROM (SELECT c.hex_id, p.poi_id, sqrt(pow(c.x - p.x, 2) + pow(c.y - p.y, 2)) AS dist, row_number() OVER (PARTITION BY c.hex_id ORDER BY sqrt(pow(c.x - p.x, 2) + pow(c.y - p.y, 2)), p.poi_id) AS rn FROM cells c, pois p) x WHERE rn = 1")
def j15_nearest(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.nearest(b.cells(spark, d).select("hex_id", "x", "y"), points(spark, d), "hex_id", "poi_id", 150.0))


_BOXES = """, boxes AS (SELECT n_nationkey AS zone, (n_nationkey % 5) * w AS x0, (n_nationkey // 5) * h AS y0, (n_nationkey % 5 + 1) * w AS x1, (n_nationkey // 5 + 1) * h AS y1
FROM nation, (SELECT (max(x) + 500) / 5 AS w, (max(y) + 500) / 5 AS h FROM cells) e)"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """zone, x0, y0, x1, y1, ring: rectangles that tile the plane."""
    e = b.cells(spark, d).agg(((F.max("x") + 500) / 5).alias("w"), ((F.max("y") + 500) / 5).alias("h"))
    n = b.table(spark, d, "nation").join(F.broadcast(e), how="cross")  # one row
    i, j = F.col("n_nationkey") % 5, F.expr("n_nationkey div 5")
    x = n.select(F.col("n_nationkey").alias("zone"), (i * F.col("w")).alias("x0"), (j * F.col("h")).alias("y0"), ((i + 1) * F.col("w")).alias("x1"), ((j + 1) * F.col("h")).alias("y1"))
    corner = lambda a, c: F.struct(F.col(a).alias("x"), F.col(c).alias("y"))
    return x.withColumn("ring", F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1")))


@query("j14_point_in_polygon", _BOXES + " SELECT hex_id, zone FROM cells c JOIN boxes ON x >= x0 AND x < x1 AND y >= y0 AND y < y1")
def j14_point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    return spatial.point_in_polygon(b.cells(spark, d), boxes(spark, d), 1000.0, "hex_id", "zone")


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """hex_id, zone, area: squares of side S around the cells' centres cut with the zones."""
    h = S / 2
    square = lambda sx, sy: F.struct((F.col("x") + sx * h).alias("x"), (F.col("y") + sy * h).alias("y"))
    cells = b.cells(spark, d).select("hex_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.array(square(-1, -1), square(1, -1), square(1, 1), square(-1, 1)).alias("hexring"))
    # 25 zones: a bounded side.
    pairs = cells.join(F.broadcast(boxes(spark, d).drop("ring")), (F.col("cx") + h > F.col("x0")) & (F.col("cx") - h < F.col("x1")) & (F.col("cy") + h > F.col("y0")) & (F.col("cy") - h < F.col("y1")))
    return spatial.overlap_area(pairs, "hexring", ("x0", "y0", "x1", "y1")).select("hex_id", "zone", "area")


_OVERLAP = _BOXES + ", cut AS (SELECT hex_id, zone, greatest(0, least(x + 221.5, x1) - greatest(x - 221.5, x0)) * greatest(0, least(y + 221.5, y1) - greatest(y - 221.5, y0)) AS area FROM cells, boxes)"


@query("j17_overlay_area", _OVERLAP + " SELECT hex_id, zone, round(area, 4) AS area FROM cut WHERE area > 0.001")
def j17_overlay_area(spark: SparkSession, d: str) -> DataFrame:
    return rounded(overlaps(spark, d).where("area > 0.001"), 4)


@query("a11_largest_overlap", _OVERLAP + " SELECT hex_id, zone FROM (SELECT hex_id, zone, row_number() OVER (PARTITION BY hex_id ORDER BY round(area, 3) DESC, zone) AS rn FROM cut WHERE area > 0.001) r WHERE rn = 1")
def a11_largest_overlap(spark: SparkSession, d: str) -> DataFrame:
    x = overlaps(spark, d).where("area > 0.001")
    return x.groupBy("hex_id").agg(F.max_by("zone", F.struct(F.round("area", 3), -F.col("zone"))).alias("zone"))


@query("g11_area_interpolation", _OVERLAP + ", z AS (SELECT c_nationkey AS zone, count(*) AS people FROM customer GROUP BY 1) SELECT hex_id, round(sum(area / ((x1 - x0) * (y1 - y0)) * coalesce(people, 0)), 6) AS people FROM cut JOIN boxes b ON b.zone = cut.zone LEFT JOIN z ON z.zone = cut.zone WHERE area > 0.001 GROUP BY hex_id".replace("FROM cut JOIN", "FROM cut JOIN"))
def g11_area_interpolation(spark: SparkSession, d: str) -> DataFrame:
    people = b.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg(F.count("*").alias("people"))
    size = boxes(spark, d).select("zone", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("size"))
    x = overlaps(spark, d).where("area > 0.001").join(size, "zone").join(people, "zone", "left")
    return rounded(x.groupBy("hex_id").agg(F.sum(F.col("area") / F.col("size") * F.coalesce("people", F.lit(0))).alias("people")))


_SEGMENTS = """, seg AS (SELECT e.u * 1000000 + e.v AS seg, a.x AS x1, a.y AS y1, c.x AS x2, c.y AS y2 FROM roads e JOIN cells a ON a.hex_id = e.u JOIN cells c ON c.hex_id = e.v WHERE e.u < e.v),
near AS (SELECT poi_id, seg, sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2)) AS dist FROM (SELECT *, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM pois, seg) z)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    c = b.cells(spark, d)
    e = b.roads(spark, d).where("u < v")
    e = e.join(c.select(F.col("hex_id").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1")), "u").join(c.select(F.col("hex_id").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2")), "v")
    return e.select((F.col("u") * 1000000 + F.col("v")).alias("seg"), "x1", "y1", "x2", "y2")


@query("j18_nearest_segment", _SEGMENTS + " SELECT poi_id, seg, round(round(dist, 6), 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY poi_id ORDER BY round(dist, 6), seg) AS rn FROM near) r WHERE rn = 1")
def j18_nearest_segment(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.nearest_segment(points(spark, d), segments(spark, d), 250.0, "poi_id", "seg"), 4)


@query("j19_points_near_line", _SEGMENTS + " SELECT seg, count(DISTINCT poi_id) AS n FROM near WHERE dist <= 30 GROUP BY seg")
def j19_points_near_line(spark: SparkSession, d: str) -> DataFrame:
    return spatial.points_near_segments(points(spark, d), segments(spark, d), 30.0, "poi_id", "seg").groupBy("seg").agg(F.count_distinct("poi_id").alias("n"))


@query("g09_polygon_measures", _BOXES + " SELECT zone, round((x1 - x0) * (y1 - y0), 3) AS area, round(2 * (x1 - x0 + y1 - y0), 4) AS length, round((x0 + x1) / 2, 4) AS cx, round((y0 + y1) / 2, 4) AS cy FROM boxes")
def g09_polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    point = lambda p: F.concat(F.format_number(p["x"], 9), F.lit(" "), F.format_number(p["y"], 9))
    wkt = F.concat(F.lit("POLYGON (("), F.translate(F.array_join(F.transform("ring", point), ";"), ",", ""), F.lit("))"))
    ring = spatial.ring_of_wkt(F.translate(wkt, ";", ","))
    cx, cy = spatial.ring_centroid(ring)
    x = boxes(spark, d).select("zone", spatial.signed_area(ring).alias("area"), spatial.ring_length(ring).alias("length"), cx.alias("cx"), cy.alias("cy"))
    return x.select("zone", F.round("area", 3).alias("area"), *[F.round(c, 4).alias(c) for c in ("length", "cx", "cy")])


@query("g08_projection")
def g08_projection(spark: SparkSession, d: str) -> DataFrame:
    """The cells' centres laid around the city's latitude and longitude, projected to metres."""
    x, y = spatial.transverse_mercator(-34.6 + F.col("y") / 111320, -58.4 + F.col("x") / 91000)
    return rounded(b.cells(spark, d).select("hex_id", x.alias("east"), y.alias("north")), 3)


@query("c15_circle", ", k AS (SELECT CAST(unnest(range(49)) AS INT) AS k) SELECT hex_id, k, round(x + 800 * cos(2 * pi() * k / 48), 4) AS x, round(y + 800 * sin(2 * pi() * k / 48), 4) AS y FROM cells, k")
def c15_circle(spark: SparkSession, d: str) -> DataFrame:
    x = b.cells(spark, d).select("hex_id", F.posexplode(spatial.circle(F.col("x"), F.col("y"), F.lit(800.0))).alias("k", "p"))
    return rounded(x.select("hex_id", "k", "p.x", "p.y"), 4)


# --- graph ----------------------------------------------------------------------------------------------------------

_REACH = """, walk(source, node, dist) AS (SELECT hex_id, hex_id, 0e0 FROM cells UNION SELECT w.source, e.v, w.dist + e.length_m FROM walk w JOIN roads e ON e.u = w.node WHERE w.dist + e.length_m <= 800),
reach AS (SELECT source, node, min(dist) AS dist FROM walk GROUP BY 1, 2)"""


def reach(spark: SparkSession, d: str, cutoff: float = 800.0) -> DataFrame:
    return graph.reachable(b.cells(spark, d).select(F.col("hex_id").alias("source")), b.roads(spark, d), cutoff)


@query("r02_reachable", _REACH + " SELECT source, node, dist FROM reach")
def r02_reachable(spark: SparkSession, d: str) -> DataFrame:
    return reach(spark, d)


@query("r04_corridor_length", _REACH + ", once AS (SELECT least(u, v) AS a, greatest(u, v) AS b, min(length_m) AS length_m FROM roads WHERE clase < 4 GROUP BY 1, 2) SELECT r.source, round(sum(length_m) / 1000, 6) AS km, count(*) AS edges FROM once o JOIN reach r ON r.node = o.a JOIN reach s ON s.node = o.b AND s.source = r.source GROUP BY r.source")
def r04_corridor_length(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.corridor_length(reach(spark, d), b.roads(spark, d).where("clase < 4")))


@query("r03_covered_edges", _REACH.replace("<= 800", "<= 500") + " SELECT source, count(*) AS n FROM (SELECT DISTINCT r.source, e.u, e.v FROM reach r JOIN roads e ON e.u = r.node OR e.v = r.node) x GROUP BY source")
def r03_covered_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.covered_edges(reach(spark, d, 500.0), b.roads(spark, d)).groupBy("source").agg(F.count("*").alias("n"))


# --- allocation -----------------------------------------------------------------------------------------------------


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return reach(spark, d).select(F.col("source").alias("candidate"), F.col("node").alias("demand")).cache()


@query("a21_coverage_today", _REACH + ", w AS (SELECT hex_id, count(*) AS n FROM incidents GROUP BY 1), plan AS (SELECT hex_id FROM cells WHERE hex_id % 7 = 0) SELECT c.comuna_id, round(sum(CASE WHEN c.hex_id IN (SELECT node FROM reach WHERE source IN (SELECT hex_id FROM plan)) THEN n ELSE 0 END) * 1e0 / sum(n), 6) AS coverage FROM cells c JOIN w ON w.hex_id = c.hex_id GROUP BY c.comuna_id")
def a21_coverage_today(spark: SparkSession, d: str) -> DataFrame:
    w = b.incidents(spark, d).groupBy("hex_id").agg(F.count("*").alias("weight"))
    dem = b.cells(spark, d).drop("weight").join(w, "hex_id").select(F.col("hex_id").alias("demand"), "weight", "comuna_id")
    plan = b.cells(spark, d).where("hex_id % 7 = 0").select(F.col("hex_id").alias("candidate"))
    return rounded(allocation.coverage_by_group(plan, coverage(spark, d), dem, "comuna_id"))


_PLANS = ", plans AS (SELECT tipo AS plan, hex_id AS candidate FROM (SELECT tipo, hex_id, row_number() OVER (PARTITION BY tipo ORDER BY count(*) DESC, hex_id) AS rn FROM incidents WHERE year(fecha) = 2000 GROUP BY 1, 2) x WHERE rn <= 10)"


@query("j24_plan_overlap", _PLANS + " SELECT x.plan AS a, y.plan AS b, round(count(*) / 10e0, 6) AS shared FROM plans x JOIN plans y ON x.candidate = y.candidate GROUP BY 1, 2")
def j24_plan_overlap(spark: SparkSession, d: str) -> DataFrame:
    n = b.incidents(spark, d).where(F.year("fecha") == 2000).groupBy("tipo", "hex_id").agg(F.count("*").alias("n"))
    top = n.withColumn("rn", F.row_number().over(Window.partitionBy("tipo").orderBy(F.desc("n"), "hex_id"))).where("rn <= 10")
    return rounded(allocation.plan_overlap(top.select(F.col("tipo").alias("plan"), F.col("hex_id").alias("candidate"))))


_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2e0) / count({0}) OVER ()"


@query(
    "o07_camera_weights",
    f""", x AS (SELECT c.hex_id, c.weight AS risk, coalesce(l.n, 0) AS lights, coalesce(f.a, 0) AS fa, coalesce(f.b, 0) AS fb FROM cells c LEFT JOIN (SELECT l_suppkey AS hex_id, count(*) AS n FROM lineitem GROUP BY 1) l ON l.hex_id = c.hex_id
    LEFT JOIN (SELECT hex_id, count(*) AS a, count(DISTINCT tipo) AS b FROM incidents_h GROUP BY 1) f ON f.hex_id = c.hex_id),
    w AS (SELECT hex_id, risk * (2 - {_RANK.format("lights")}) * (1 + ({_RANK.format("fa")} + {_RANK.format("fb")}) / 2) AS weight FROM x),
    n AS (SELECT c.hex_id, min(sqrt(pow(c.x - p.x, 2) + pow(c.y - p.y, 2))) AS dist FROM cells c, pois p WHERE p.clase = 'PROMO' GROUP BY c.hex_id)
    SELECT w.hex_id, round(weight * CASE WHEN dist <= 150 THEN 0.3e0 ELSE 1e0 END, 4) AS weight FROM w LEFT JOIN n ON n.hex_id = w.hex_id WHERE dist IS NULL OR dist > 100""",
)
def o07_camera_weights(spark: SparkSession, d: str) -> DataFrame:
    lights = b.incidents(spark, d).groupBy("hex_id").agg(F.count("*").alias("lights"))
    flow = b.incidents_h(spark, d).groupBy("hex_id").agg(F.count("*").alias("flow_a"), F.count_distinct("tipo").alias("flow_b"))
    cells = b.cells(spark, d)
    x = cells.select("hex_id", F.col("weight").alias("risk")).join(lights, "hex_id", "left").join(flow, "hex_id", "left").fillna(0)
    near = spatial.within_distance(cells, points(spark, d).where("clase = 'PROMO'"), 150.0, "hex_id", "poi_id")
    return rounded(allocation.camera_weights(x, near.select("hex_id", "dist")), 4)


@query("o08_network_cameras")
def o08_network_cameras(spark: SparkSession, d: str) -> DataFrame:
    """Cameras on the network: the edges near each site weigh kilometres times the cells' weight; marginal gains."""
    c = b.cells(spark, d).select("hex_id", "weight")
    e = b.roads(spark, d).join(c.select(F.col("hex_id").alias("u"), F.col("weight").alias("wu")), "u").join(c.select(F.col("hex_id").alias("v"), F.col("weight").alias("wv")), "v")
    edges = e.select((F.col("u") * 1000000 + F.col("v")).alias("demand"), (F.col("length_m") / 1000 * (F.col("wu") + F.col("wv")) / 2).alias("weight"))
    cov = graph.covered_edges(reach(spark, d, 500.0), b.roads(spark, d)).select(F.col("source").alias("candidate"), (F.col("u") * 1000000 + F.col("v")).alias("demand")).cache()
    return rounded(allocation.greedy_cover(cov, edges.cache(), 8))


@query("o09_controls", _SEGMENTS + """, acc AS (SELECT seg, seg // 1000000 AS u FROM seg), x AS (SELECT a.u AS access, count(DISTINCT poi_id) AS siniestros, (SELECT sum(length_m) / 1000 FROM roads r WHERE r.u = a.u) AS km FROM acc a LEFT JOIN near n ON n.seg = a.seg AND n.dist <= 30 GROUP BY a.u),
y AS (SELECT access, siniestros / km AS per_km, c.weight AS risk FROM x JOIN cells c ON c.hex_id = x.access), z AS (SELECT access, per_km, (""" + _RANK.format("per_km") + " + " + _RANK.format("risk") + ") / 2 AS score FROM y) SELECT access, round(per_km, 6) AS siniestros_por_km, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, access) AS INT) AS ranking FROM z")
def o09_controls(spark: SparkSession, d: str) -> DataFrame:
    near = spatial.points_near_segments(points(spark, d), segments(spark, d), 30.0, "poi_id", "seg")
    hits = near.groupBy(F.expr("seg div 1000000").alias("access")).agg(F.count_distinct("poi_id").alias("siniestros"))
    starts = segments(spark, d).select(F.expr("seg div 1000000").alias("access")).distinct()
    km = b.roads(spark, d).groupBy(F.col("u").alias("access")).agg((F.sum("length_m") / 1000).alias("km"))
    x = starts.join(hits, "access", "left").fillna(0).join(km, "access").join(b.cells(spark, d).select(F.col("hex_id").alias("access"), F.col("weight").alias("risk")), "access")
    return rounded(allocation.control_ranking(x))


@query("o09_corridor_controls", _REACH + _SEGMENTS + """, once AS (SELECT least(u, v) AS a, greatest(u, v) AS b, min(length_m) AS m FROM roads GROUP BY 1, 2),
tr AS (SELECT p.source AS access, a * 1000000 + b AS seg, m FROM once JOIN reach p ON p.node = a JOIN reach o ON o.node = b AND o.source = p.source), km AS (SELECT access, sum(m) / 1000 AS km FROM tr GROUP BY 1),
h AS (SELECT access, count(DISTINCT poi_id) AS n FROM tr JOIN near ON near.seg = tr.seg AND dist <= 30 GROUP BY 1), k AS (SELECT source AS access, round(avg(weight), 6) AS risk FROM reach JOIN cells ON hex_id = node GROUP BY 1),
y AS (SELECT km.access, coalesce(n, 0) / km AS per_km, risk FROM km LEFT JOIN h ON h.access = km.access JOIN k ON k.access = km.access), z AS (SELECT access, per_km, (""" + _RANK.format("per_km") + " + " + _RANK.format("risk") + ") / 2 AS score FROM y) SELECT access, round(per_km, 6) AS siniestros_por_km, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, access) AS INT) AS ranking FROM z")
def o09_corridor_controls(spark: SparkSession, d: str) -> DataFrame:
    """Accesses ranked by crashes a kilometre along their whole corridors and by the mean risk of the cells on them."""
    r, near = reach(spark, d), spatial.points_near_segments(points(spark, d), segments(spark, d), 30.0, "poi_id", "seg").select("seg", "poi_id")
    trace = graph.corridor_edges(r, b.roads(spark, d)).select(F.col("source").alias("access"), (F.col("a") * 1000000 + F.col("b")).alias("seg"), "length_m")
    hits = trace.join(near, "seg").groupBy("access").agg(F.count_distinct("poi_id").alias("siniestros"))
    risk = r.join(b.cells(spark, d).select(F.col("hex_id").alias("node"), "weight"), "node").groupBy(F.col("source").alias("access")).agg(F.round(F.avg("weight"), 6).alias("risk"))
    km = trace.groupBy("access").agg((F.sum("length_m") / 1000).alias("km"))
    return rounded(allocation.control_ranking(km.join(hits, "access", "left").fillna(0, ["siniestros"]).join(risk, "access")))


@query("m10_rank_gaps", ", a AS (SELECT c.hex_id, n, weight FROM cells c JOIN (SELECT hex_id, count(*) AS n FROM incidents GROUP BY 1) i ON i.hex_id = c.hex_id) SELECT hex_id, rank() OVER (ORDER BY n DESC, hex_id) AS by_count, rank() OVER (ORDER BY weight DESC, hex_id) AS by_weight, abs(rank() OVER (ORDER BY n DESC, hex_id) - rank() OVER (ORDER BY weight DESC, hex_id)) AS gap FROM a")
def m10_rank_gaps(spark: SparkSession, d: str) -> DataFrame:
    n = b.incidents(spark, d).groupBy("hex_id").agg(F.count("*").alias("n"))
    x = b.cells(spark, d).select("hex_id", "weight").join(n, "hex_id")
    place = lambda c: F.rank().over(Window.orderBy(F.desc(c), "hex_id")).cast("long")
    return x.select("hex_id", place("n").alias("by_count"), place("weight").alias("by_weight")).withColumn("gap", F.abs(F.col("by_count") - F.col("by_weight")))


@query("m11_visitor_pressure", ", f AS (SELECT c.comuna_id, count(*) AS a, sum(value) AS v, count(DISTINCT user_id) AS u FROM incidents_h i JOIN cells c ON c.hex_id = i.hex_id GROUP BY 1), p AS (SELECT c_nationkey AS comuna_id, count(*) AS people FROM customer GROUP BY 1), x AS (SELECT f.comuna_id, round((a * 1e0 / sum(a) OVER () + v / sum(v) OVER () + u * 1e0 / sum(u) OVER ()) / 3 / people, 12) AS pressure FROM f JOIN p ON p.comuna_id = f.comuna_id) SELECT comuna_id, round(" + _RANK.format("pressure") + ", 6) AS pct FROM x")
def m11_visitor_pressure(spark: SparkSession, d: str) -> DataFrame:
    x = b.incidents_h(spark, d).join(b.cells(spark, d).select("hex_id", "comuna_id"), "hex_id").groupBy("comuna_id").agg(F.count("*").alias("a"), F.sum("value").alias("v"), F.count_distinct("user_id").alias("u"))
    people = b.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("comuna_id")).agg(F.count("*").alias("people"))
    share = lambda c: F.col(c) / F.sum(c).over(Window.partitionBy())
    x = x.select("comuna_id", ((share("a") + share("v") + share("u")) / 3).alias("s")).join(people, "comuna_id").withColumn("pressure", F.round(F.col("s") / F.col("people"), 12))
    return rounded(x.select("comuna_id", percent_rank_average(F.col("pressure")).alias("pct")))


# --- forecasts ------------------------------------------------------------------------------------------------------


@query("k01_seasonal_naive", ", x AS (SELECT tipo, ds, y, y - lag(y, 12) OVER (PARTITION BY tipo ORDER BY ds) AS diff, row_number() OVER (PARTITION BY tipo ORDER BY ds DESC) AS back FROM monthly_type), s AS (SELECT tipo, stddev_samp(diff) AS sd FROM x GROUP BY tipo) SELECT x.tipo, CAST(ds + INTERVAL 12 MONTH AS DATE) AS ds, y AS yhat, round(y - 1.645e0 * sd, 6) AS low, round(y + 1.645e0 * sd, 6) AS high FROM x JOIN s ON s.tipo = x.tipo WHERE back <= 12")
def k01_seasonal_naive(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.seasonal_naive(b.monthly(spark, d, by_type=True), ["tipo"]))


_BACKTEST = ", o AS (SELECT tipo, ds AS origin, row_number() OVER (PARTITION BY tipo ORDER BY ds DESC) AS back FROM monthly_type), g AS (SELECT tipo, origin, CAST(h AS INT) AS h, CAST(origin + to_months(CAST(h AS INT)) AS DATE) AS ds, CAST(origin + to_months(CAST(h AS INT) - 12) AS DATE) AS src FROM o, range(1, 13) r(h) WHERE back BETWEEN 2 AND 85), bt AS (SELECT g.tipo, g.origin, g.h, a.y AS real, p.y AS pred FROM g JOIN monthly_type a ON a.tipo = g.tipo AND a.ds = g.ds JOIN monthly_type p ON p.tipo = g.tipo AND p.ds = g.src)"


@query("k04_backtest_naive", _BACKTEST + " SELECT * FROM bt")
def k04_backtest_naive(spark: SparkSession, d: str) -> DataFrame:
    return forecast.backtest_naive(b.monthly(spark, d, by_type=True), 84, ["tipo"])


@query("k05_horizon_bands", _BACKTEST + " SELECT tipo, h, round(quantile_cont(pred - real, 0.05), 6) AS q_low, round(quantile_cont(pred - real, 0.95), 6) AS q_high FROM bt GROUP BY tipo, h")
def k05_horizon_bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.error_bands(forecast.backtest_naive(b.monthly(spark, d, by_type=True), 84, ["tipo"]), by=["tipo"]))


@query("k02_backtest_models")
def k02_backtest_models(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.backtest_models(b.monthly(spark, d, by_type=True), "tipo", 84))


@query("a06_forecast_errors", _BACKTEST + " SELECT h, count(*) AS n, round(avg(abs(pred - real)), 6) AS mae, round(sqrt(avg((pred - real) * (pred - real))), 6) AS rmse, round(avg(pred - real), 6) AS bias, round(sum(pred) / sum(real), 6) AS level FROM bt GROUP BY h")
def a06_forecast_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.error_summary(forecast.backtest_naive(b.monthly(spark, d, by_type=True), 84, ["tipo"]), ["h"]))


@query("c07_last_24_months", ", m AS (SELECT max(CAST(date_trunc('month', fecha) AS DATE)) AS top FROM incidents), g AS (SELECT CAST(top - to_months(CAST(k AS INT)) AS DATE) AS ds FROM m, range(24) r(k)), t AS (SELECT DISTINCT tipo FROM incidents) SELECT t.tipo, g.ds, coalesce(n, 0) AS n FROM g CROSS JOIN t LEFT JOIN (SELECT tipo, CAST(date_trunc('month', fecha) AS DATE) AS ds, count(*) AS n FROM incidents GROUP BY 1, 2) k ON k.tipo = t.tipo AND k.ds = g.ds")
def c07_last_24_months(spark: SparkSession, d: str) -> DataFrame:
    x = b.incidents(spark, d).groupBy("tipo", F.trunc("fecha", "month").alias("ds")).agg(F.count("*").alias("n"))
    top = x.agg(F.max("ds").alias("top")).select(F.explode(F.sequence(F.add_months("top", -23), F.col("top"), F.expr("interval 1 month"))).alias("ds"))
    every = x.select("tipo").distinct().join(F.broadcast(top), how="cross")  # 24 months
    return every.join(x, ["tipo", "ds"], "left").fillna(0, ["n"])


# --- the rest -------------------------------------------------------------------------------------------------------


@query("t05_quantile_classes", ", e AS (SELECT quantile_cont(weight, [0.2, 0.4, 0.6, 0.8]) AS e FROM cells) SELECT hex_id, CAST(len(list_filter(e, lambda v: weight > v)) AS INT) AS klass FROM cells, e")
def t05_quantile_classes(spark: SparkSession, d: str) -> DataFrame:
    return export.quantile_classes(b.cells(spark, d), "weight", 5).select("hex_id", "klass")


@query("w13_rank_bins", ", r AS (SELECT hex_id, row_number() OVER (ORDER BY weight, hex_id) AS i, count(*) OVER () AS n FROM cells) SELECT hex_id, CAST((CASE WHEN i > 1 + (n - 1) * 0.25e0 THEN 1 ELSE 0 END) + (CASE WHEN i > 1 + (n - 1) * 0.5e0 THEN 1 ELSE 0 END) + (CASE WHEN i > 1 + (n - 1) * 0.75e0 THEN 1 ELSE 0 END) AS INT) AS quartile FROM r")
def w13_rank_bins(spark: SparkSession, d: str) -> DataFrame:
    return export.rank_bins(b.cells(spark, d), "weight", "hex_id", 4).select("hex_id", F.col("bin").alias("quartile"))


@query("a15_controlled_rounding", ", t AS (SELECT c_nationkey AS zone, count(*) AS total, sum(CASE WHEN c_acctbal < 3000 THEN 1 ELSE 0 END) * 1e0 / count(*) AS frac FROM customer GROUP BY 1) SELECT zone, CAST(round_even(total * frac * 0.97e0, 0) AS BIGINT) AS men, total - CAST(round_even(total * frac * 0.97e0, 0) AS BIGINT) AS women FROM t")
def a15_controlled_rounding(spark: SparkSession, d: str) -> DataFrame:
    t = b.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("zone")).agg(F.count("*").alias("total"), (F.count_if(F.col("c_acctbal") < 3000) / F.count("*")).alias("frac"))
    men = F.bround(F.col("total") * F.col("frac") * 0.97, 0).cast("long")
    return t.select("zone", men.alias("men"), (F.col("total") - men).alias("women"))


@query("a34_access_groups", "SELECT c.comuna_id, string_agg(s_name, ' + ' ORDER BY s_name) AS names, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM cells c JOIN supplier ON s_suppkey = c.hex_id GROUP BY c.comuna_id")
def a34_access_groups(spark: SparkSession, d: str) -> DataFrame:
    s = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("hex_id"), "s_name")
    x = b.cells(spark, d).join(s, "hex_id").groupBy("comuna_id").agg(F.array_join(F.array_sort(F.collect_list("s_name")), " + ").alias("names"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    return rounded(x)


@query("s26_geojson")
def s26_geojson(spark: SparkSession, d: str) -> DataFrame:
    """One GeoJSON feature for each cell, as text."""
    x = b.cells(spark, d)
    return x.select("hex_id", export.polygon_feature(grid.cell_corners(F.col("x"), F.col("y"), S), {"comuna_id": F.col("comuna_id"), "weight": F.round("weight", 6)}).alias("feature"))


@query("f16_profile_json", ", p AS (SELECT tipo, hora, count(*) AS n FROM incidents_h GROUP BY 1, 2), g AS (SELECT t.tipo, h.hora FROM (SELECT DISTINCT tipo FROM incidents_h) t, range(24) h(hora)) SELECT g.tipo, list(coalesce(n, 0) ORDER BY g.hora) AS franja FROM g LEFT JOIN p ON p.tipo = g.tipo AND p.hora = g.hora GROUP BY g.tipo")
def f16_profile_json(spark: SparkSession, d: str) -> DataFrame:
    return export.profile(b.incidents_h(spark, d), "tipo", "hora", list(range(24))).select("tipo", F.col("profile").alias("franja"))


@query("s25_summary_json")
def s25_summary_json(spark: SparkSession, d: str) -> DataFrame:
    x = b.incidents(spark, d).groupBy(F.year("fecha").alias("anio")).agg(F.count("*").alias("delitos"), F.round(F.sum("cantidad"), 2).alias("cantidad"))
    return export.json_records(x, ["anio"])
