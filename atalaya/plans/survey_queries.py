"""Queries of cleaning, joins, grids, sweeps, scenarios and exports; library functions here, SQL written apart from them."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import bindings as b
from ..functions import scalars
from ..functions.scalars import as_list, capacity, crown_radius, single_date, slug
from ..operators import allocation, export, forecast, grid, metrics, spatial, statistics
from ..operators.tables import scratch
from ..sources import readers
from .panel_queries import _BASELINE, _YEARLY, _panel_sql, _yearly, baseline_scores, dense, rounded
from .registry import query
from .spatial_queries import _BOXES, _PLANS, _REACH, _SEGMENTS, S, boxes, points, reach, segments

# --- cleaning and parsing -------------------------------------------------------------------------------------------


@query("p09_digit_rows", "SELECT zona, n FROM (SELECT coalesce(CAST(c_nationkey AS VARCHAR), 'Total') AS zona, count(*) AS n FROM customer GROUP BY ROLLUP(c_nationkey)) t WHERE zona <> 'Total'")
def p09_digit_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table with a row of totals, kept where the key is all digits."""
    t = b.table(spark, d, "customer").rollup("c_nationkey").agg(F.count("*").alias("n"))
    return t.select(F.coalesce(F.col("c_nationkey").cast("string"), F.lit("Total")).alias("zona"), "n").where(F.col("zona").rlike("^[0-9]+$"))


_RAW_DATES = """, raw AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') || ' y ' || strftime(o_orderdate, '%d/%m/%Y')
WHEN 2 THEN 'a confirmar' ELSE 'desde ' || strftime(o_orderdate, '%d/%m/%Y') END AS fecha_raw, CASE o_orderkey % 3 WHEN 0 THEN 'hasta 12.500 personas' WHEN 1 THEN CAST(o_orderkey AS VARCHAR) ELSE 'sin datos' END AS aforo_raw, CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders)"""


@query("p10_best_effort", _RAW_DATES + " SELECT id, CASE WHEN o_orderkey % 4 IN (0, 3) THEN day END AS fecha, fecha_raw, CASE o_orderkey % 3 WHEN 0 THEN 12500e0 WHEN 1 THEN CAST(o_orderkey AS DOUBLE) END AS aforo, aforo_raw FROM raw")
def p10_best_effort(spark: SparkSession, d: str) -> DataFrame:
    """Values read where they can be, beside the raw text: the only date of a text, the first number of another."""
    day, k = F.date_format("o_orderdate", "dd/MM/yyyy"), F.col("o_orderkey")
    date = F.when(k % 4 == 0, day).when(k % 4 == 1, F.concat(day, F.lit(" y "), day)).when(k % 4 == 2, "a confirmar").otherwise(F.concat(F.lit("desde "), day))
    size = F.when(k % 3 == 0, "hasta 12.500 personas").when(k % 3 == 1, k.cast("string")).otherwise("sin datos")
    x = b.table(spark, d, "orders").select(k.alias("id"), date.alias("fecha_raw"), size.alias("aforo_raw"))
    return x.select("id", single_date(F.col("fecha_raw")).alias("fecha"), "fecha_raw", capacity(F.col("aforo_raw")).alias("aforo"), "aforo_raw")


@query("p19_valid_cells", "SELECT hex_id, CAST(comuna_id AS INT) AS comuna_id FROM cells WHERE weight >= 1000")
def p19_valid_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells that lie in a district, its number as an integer; here those of non-negative balance do."""
    x = b.cells(spark, d).select("hex_id", F.when(F.col("weight") >= 1000, F.col("barrio_id")).alias("barrio_id"), F.col("comuna_id").cast("double").alias("comuna_id"))
    return x.where("barrio_id IS NOT NULL").select("hex_id", F.col("comuna_id").cast("int").alias("comuna_id"))


@query("p23_slug", "SELECT DISTINCT n_name AS name, lower(replace(n_name, ' ', '_')) AS key FROM nation UNION SELECT DISTINCT p_type || ' ' || p_brand, lower(replace(replace(p_type || ' ' || p_brand, '#', '_'), ' ', '_')) FROM part")
def p23_slug(spark: SparkSession, d: str) -> DataFrame:
    parts = b.table(spark, d, "part").select(F.concat_ws(" ", "p_type", "p_brand").alias("name"))
    return b.table(spark, d, "nation").select(F.col("n_name").alias("name")).unionAll(parts).distinct().select("name", slug(F.col("name")).alias("key"))


@query("f17_list_or_scalar", "SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN [c_mktsegment, 'x'] WHEN 1 THEN [c_mktsegment] ELSE CAST([] AS VARCHAR[]) END AS tags FROM customer")
def f17_list_or_scalar(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("c_mktsegment")
    raw = F.when(k % 3 == 0, F.concat(F.lit('["'), s, F.lit('","x"]'))).when(k % 3 == 1, s)
    return b.table(spark, d, "customer").select(k.alias("id"), as_list(raw).alias("tags"))


@query("g16_crown_radius", "SELECT p_partkey AS id, round(CASE WHEN p_size > 5 THEN least(6e0, greatest(1.2e0, 0.08e0 * p_size * 2)) ELSE least(5e0, greatest(1.2e0, 0.22e0 * p_retailprice / 50)) END, 6) AS radius FROM part")
def g16_crown_radius(spark: SparkSession, d: str) -> DataFrame:
    trunk = F.when(F.col("p_size") > 5, F.col("p_size") * 2)
    return rounded(b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), crown_radius(trunk, F.col("p_retailprice") / 50).alias("radius")))


@query("g15_building_layer", "SELECT p_brand AS parcela, count(*) AS n, round(max(least(240e0, p_size * 6)), 1) AS altura, sum(CASE WHEN least(240e0, p_size * 6) >= 40 THEN 1 ELSE 0 END) AS hitos FROM part WHERE p_size > 0 AND p_retailprice / 93 >= 10 GROUP BY 1")
def g15_building_layer(spark: SparkSession, d: str) -> DataFrame:
    """Buildings of positive height and ten square metres or more, heights clipped at 240; landmarks from 40 metres."""
    x = b.table(spark, d, "part").select(F.col("p_brand").alias("parcela"), (F.col("p_size") * 6.0).alias("altura"), (F.col("p_retailprice") / 93).alias("area_m2"))
    x = x.where("altura > 0").withColumn("altura", F.round(F.least("altura", F.lit(240.0)), 1)).where("area_m2 >= 10")
    return x.groupBy("parcela").agg(F.count("*").alias("n"), F.max("altura").alias("altura"), F.count_if(F.col("altura") >= 40).alias("hitos"))


# --- readers: tables written as raw files and read back ----------------------------------------------------------------


def _raw(spark: SparkSession, df: DataFrame, kind: str = "csv", **options) -> str:
    path = f"{scratch(spark)}/raw-{uuid.uuid4().hex}"
    df.write.options(**options).format(kind).save(path)
    return path


@query("s06_csv_scan", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS nombre, c_mktsegment AS rubro FROM customer")
def s06_csv_scan(spark: SparkSession, d: str) -> DataFrame:
    x = b.table(spark, d, "customer").select(F.col("c_custkey").alias("﻿ ID "), F.col("c_name").alias("Nombre"), F.col("c_mktsegment").alias("Segmento"))
    return readers.read_delimited(spark, _raw(spark, x, header=True), aliases={"segmento": "rubro"}, required=("id", "nombre", "rubro"))


@query("s07_decimal_comma", "SELECT c_custkey AS id, round(c_acctbal, 2) AS saldo FROM customer")
def s07_decimal_comma(spark: SparkSession, d: str) -> DataFrame:
    x = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.translate(F.format_string("%.2f", F.col("c_acctbal").cast("double")), ".", ",").alias("saldo"))
    return readers.read_delimited(spark, _raw(spark, x, header=True, sep=";"), sep=";").select(F.col("id").cast("long").alias("id"), readers.decimal_comma(F.col("saldo")).alias("saldo"))


@query("s08_latin1_scan", "SELECT CAST(c_custkey AS VARCHAR) AS id, 'Señor ' || c_name || ' Núñez' AS nombre FROM customer")
def s08_latin1_scan(spark: SparkSession, d: str) -> DataFrame:
    x = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Señor "), "c_name", F.lit(" Núñez")).alias("nombre"))
    return readers.read_delimited(spark, _raw(spark, x, header=True, encoding="ISO-8859-1"), encoding="ISO-8859-1")


@query("s09_null_token", "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END AS medida FROM part")
def s09_null_token(spark: SparkSession, d: str) -> DataFrame:
    x = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise("SD").alias("medida"))
    return readers.read_delimited(spark, _raw(spark, x, header=True, sep=";"), sep=";", null="SD")


@query("s10_yearly_scan", "SELECT anio AS anio_archivo, count(*) AS n FROM (SELECT CAST(year(o_orderdate) AS INT) AS anio FROM orders) o GROUP BY 1")
def s10_yearly_scan(spark: SparkSession, d: str) -> DataFrame:
    """One file a year, their headers different, read under one schema."""
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tipo"), F.year("o_orderdate").alias("y"))
    top, paths = f"{scratch(spark)}/yearly-{uuid.uuid4().hex}", []
    for (y,) in o.select("y").distinct().orderBy("y").collect():  # some seven years
        x = o.where(F.col("y") == y).select("id", F.col("tipo").alias("tipo" if y % 2 else "Tipo_Delito"))
        x.write.option("header", True).csv(f"{top}/delitos_{y}")
        paths.append(f"{top}/delitos_{y}")
    out = None
    for path in paths:
        x = readers.read_delimited(spark, path, aliases={"tipo_delito": "tipo"}, required=("id", "tipo")).withColumn("anio_archivo", F.lit(int(path[-4:])))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("anio_archivo").agg(F.count("*").alias("n"))


@query("s12b_normalised_flow", "SELECT CAST(o_orderdate AS DATE) AS fecha, CAST(o_orderkey % 24 AS INT) AS hora, o_orderpriority AS estacion, CAST(o_custkey % 7 AS VARCHAR) AS linea, CAST(o_orderkey % 90 AS DOUBLE) AS cantidad FROM orders WHERE o_orderkey % 5 <> 0")
def s12b_normalised_flow(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = b.table(spark, d, "orders").select(
        F.when(k % 5 != 0, F.date_format("o_orderdate", "d/M/yyyy")).otherwise("sin fecha").alias(" FECHA "), F.format_string("%02d:15:00", (k % 24).cast("int")).alias("DESDE"), F.col("o_orderpriority").alias("Estacion"),
        F.concat(F.lit("Linea_"), (F.col("o_custkey") % 7).cast("string")).alias("linea"), (k % 90).cast("string").alias("pax_TOTAL"), F.lit("9").alias("total_otro"),
    )
    return readers.normalise_flow(readers.read_delimited(spark, _raw(spark, raw, header=True)))


@query("s14_line_stops", "SELECT DISTINCT l_suppkey % 40 AS linea, l_partkey AS parada FROM lineitem")
def s14_line_stops(spark: SparkSession, d: str) -> DataFrame:
    """The distinct (line, stop) pairs of a long table of stop times, read from its text file by two columns."""
    x = b.table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("route_id"), F.col("l_partkey").alias("stop_id"), F.col("l_linenumber").alias("stop_sequence"), F.col("l_shipdate").cast("string").alias("arrival_time"))
    read = readers.read_delimited(spark, _raw(spark, x, header=True), aliases={"route_id": "linea", "stop_id": "parada"})
    return read.select(F.col("linea").cast("long").alias("linea"), F.col("parada").cast("long").alias("parada")).distinct()


@query("s13_gtfs_stops", "SELECT CAST(poi_id AS VARCHAR) AS stop_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM pois WHERE x <> 0 AND y <> 0")
def s13_gtfs_stops(spark: SparkSession, d: str) -> DataFrame:
    """A stops file, without rows whose coordinates are missing or zero."""
    x = points(spark, d).select(F.col("poi_id").alias("stop_id"), F.col("x").alias("stop_lon"), F.col("y").alias("stop_lat"))
    read = readers.read_delimited(spark, _raw(spark, x, header=True))
    out = read.select("stop_id", F.col("stop_lon").try_cast("double").alias("x"), F.col("stop_lat").try_cast("double").alias("y"))
    return out.where("x IS NOT NULL AND y IS NOT NULL AND x <> 0 AND y <> 0")


@query("s17_series_api", "SELECT ds AS fecha, CASE WHEN month(ds) <> 3 THEN y END AS lluvia, y * 2 AS temp FROM monthly")
def s17_series_api(spark: SparkSession, d: str) -> DataFrame:
    """A JSON answer of two series by date, -999 standing for no value; one small document of monthly values."""
    m = b.monthly(spark, d).select(F.date_format("ds", "yyyyMMdd").alias("k"), F.when(F.month("ds") != 3, F.col("y")).otherwise(-999.0).alias("rain"), (F.col("y") * 2).alias("temp"))
    of = lambda c: F.map_from_entries(F.collect_list(F.struct("k", c)))
    doc = m.agg(F.to_json(F.struct(of("rain").alias("PRECTOT"), of("temp").alias("T2M"))).alias("value"))
    return readers.read_series_api(spark, _raw(spark, doc, "text"), {"PRECTOT": "lluvia", "T2M": "temp"})


@query("s19_geojson_scan", "SELECT CAST(poi_id AS VARCHAR) AS id, clase, CAST(x AS DOUBLE) AS lon, CAST(y AS DOUBLE) AS lat FROM pois")
def s19_geojson_scan(spark: SparkSession, d: str) -> DataFrame:
    """Point features in files of one collection each (a hundred here), read back as a table."""
    p = points(spark, d).select((F.col("poi_id") % 100).alias("part"), export.point_feature(F.col("x"), F.col("y"), {"id": F.col("poi_id").cast("string"), "clase": F.col("clase")}).alias("f"))
    docs = p.groupBy("part").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("value"))
    path = f"{scratch(spark)}/geojson-{uuid.uuid4().hex}"
    docs.repartition(100, "part").write.partitionBy("part").text(path)
    return readers.read_geojson(spark, f"{path}/part=*", ["id", "clase"])


@query("s24_parquet_sink", "SELECT CAST(year(fecha) AS INT) AS anio, tipo, count(*) AS n FROM incidents GROUP BY 1, 2")
def s24_parquet_sink(spark: SparkSession, d: str) -> DataFrame:
    """Incidents written by year and read back with the year from the folder names."""
    x = b.incidents(spark, d).withColumn("anio", F.year("fecha"))
    path = f"{scratch(spark)}/sink-{uuid.uuid4().hex}"
    x.repartition("anio").write.partitionBy("anio").parquet(path)
    return spark.read.parquet(path).groupBy("anio", "tipo").agg(F.count("*").alias("n"))


@query("s23_split_frames", "SELECT CASE WHEN year(fecha) <= 1998 THEN 'train' WHEN year(fecha) = 1999 THEN 'val' ELSE 'test' END AS part, count(*) AS n, round(sum(cantidad), 2) AS cantidad FROM incidents GROUP BY 1")
def s23_split_frames(spark: SparkSession, d: str) -> DataFrame:
    frames = readers.split_frames(b.incidents(spark, d).withColumn("anio", F.year("fecha")), "anio", ["cantidad"], 1998, 1999)
    sums = [x.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.round(F.sum("cantidad"), 2).cast("double").alias("cantidad")) for name, x in zip(("train", "val", "test"), frames, strict=True)]
    return sums[0].unionAll(sums[1]).unionAll(sums[2])


# --- joins and aggregates -------------------------------------------------------------------------------------------


@query("j21_regex_key_join", "SELECT p.p_brand AS brand, s.s_suppkey AS line, count(*) AS parts FROM part p JOIN supplier s ON CAST(regexp_extract(p.p_brand, '([0-9]+)', 1) AS BIGINT) = CAST(regexp_extract(s.s_name, '([0-9]+)', 1) AS BIGINT) GROUP BY 1, 2")
def j21_regex_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines joined with their short names by the number written in either."""
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1).try_cast("long")
    p = b.table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("parts")).withColumn("line", number("brand"))
    return p.join(b.table(spark, d, "supplier").select(number("s_name").alias("line")), "line").groupBy("brand", "line").agg(F.sum("parts").alias("parts"))


@query("j03_flow_join", ", flow AS (SELECT l_suppkey AS hex_id, ['Mañana', 'Tarde', 'Noche', 'Madrugada'][l_linenumber % 4 + 1] AS turno, sum(l_quantity) AS pax FROM lineitem GROUP BY 1, 2), n AS (SELECT hex_id, turno, count(*) AS y FROM incidents GROUP BY 1, 2) SELECT n.hex_id, n.turno, y, round(coalesce(pax, 0), 2) AS pax FROM n LEFT JOIN flow f ON f.hex_id = n.hex_id AND f.turno = n.turno")
def j03_flow_join(spark: SparkSession, d: str) -> DataFrame:
    lines = b.table(spark, d, "lineitem")
    turno = F.element_at(F.array(*map(F.lit, ("Mañana", "Tarde", "Noche", "Madrugada"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    pax = lines.groupBy(F.col("l_suppkey").alias("hex_id"), turno.alias("turno")).agg(F.sum("l_quantity").alias("pax"))
    n = b.incidents(spark, d).groupBy("hex_id", "turno").agg(F.count("*").alias("y"))
    return n.join(pax, ["hex_id", "turno"], "left").select("hex_id", "turno", "y", F.round(F.coalesce("pax", F.lit(0)), 2).cast("double").alias("pax"))


@query("j04_date_join", ", w AS (SELECT CAST(o_orderdate AS DATE) AS fecha, count(*) % 11 * 0.5e0 AS precip FROM orders GROUP BY 1) SELECT i.fecha, count(*) AS n, max(precip) AS precip, coalesce(max(precip) > 1, false) AS llueve FROM incidents i LEFT JOIN w ON w.fecha = i.fecha GROUP BY 1")
def j04_date_join(spark: SparkSession, d: str) -> DataFrame:
    """Daily incidents with the day's weather; days without a measure are not rainy."""
    weather = b.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("fecha")).agg((F.count("*") % 11 * 0.5).alias("precip"))
    days = b.incidents(spark, d).groupBy("fecha").agg(F.count("*").alias("n"))
    return days.join(weather, "fecha", "left").select("fecha", "n", "precip", F.coalesce(F.col("precip") > 1, F.lit(False)).alias("llueve"))


@query("c02_filtered_totals", ", z AS (SELECT c_nationkey AS comuna_id, count(*) AS people FROM customer GROUP BY 1), i AS (SELECT comuna_id, count(*) AS n FROM incidents i JOIN cells c ON c.hex_id = i.hex_id WHERE tipo = 'R' GROUP BY 1) SELECT z.comuna_id, people, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100000e0 / people, 6) AS rate FROM z LEFT JOIN i ON i.comuna_id = z.comuna_id WHERE z.comuna_id BETWEEN 5 AND 9")
def c02_filtered_totals(spark: SparkSession, d: str) -> DataFrame:
    zones = b.table(spark, d, "customer").where("c_nationkey BETWEEN 5 AND 9").groupBy(F.col("c_nationkey").alias("comuna_id")).agg(F.count("*").alias("people"))
    n = b.incidents(spark, d).where("tipo = 'R'").join(b.cells(spark, d).select("hex_id", "comuna_id"), "hex_id")
    return rounded(export.zone_totals(zones, n, "comuna_id"))


@query("t06_sorted_table", ", z AS (SELECT n_nationkey AS zone, n_name AS name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS people FROM nation), r AS (SELECT name, CASE WHEN people > 0 THEN round(n * 100000e0 / people, 6) END AS rate FROM z) SELECT name, rate, row_number() OVER (ORDER BY coalesce(rate, -1) DESC, name) AS position FROM r")
def t06_sorted_table(spark: SparkSession, d: str) -> DataFrame:
    """The table of zones ordered by a computed rate; zones without one come last."""
    n = b.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    people = b.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("people"))
    z = b.table(spark, d, "nation").join(n, "n_nationkey", "left").join(people, "n_nationkey", "left").fillna(0, ["n"])
    rate = F.round(F.when(F.col("people") > 0, F.col("n") * 100000.0 / F.col("people")), 6)
    return export.sorted_table(z.select(F.col("n_name").alias("name"), rate.alias("rate")), "rate", "name")


@query("c01_url_state", "SELECT page_id, CASE WHEN regexp_extract(coalesce(url, ''), '[?&]lang=([^&#]*)', 1) IN ('en', 'es') THEN regexp_extract(coalesce(url, ''), '[?&]lang=([^&#]*)', 1) ELSE 'en' END AS lang, coalesce(TRY_CAST(nullif(regexp_extract(coalesce(url, ''), '[?&]id=([0-9]+)([&#]|$)', 1), '') AS BIGINT), 75) AS k FROM pages")
def c01_url_state(spark: SparkSession, d: str) -> DataFrame:
    """A choice and a number from each page's URL, defaults where they are missing or not valid."""
    return b.table(spark, d, "pages").select("page_id", export.url_choice(F.col("url"), "lang", ["en", "es"], "en").alias("lang"), export.url_number(F.col("url"), "id", 75).alias("k"))


@query("c13_draw_units", """, x AS (SELECT hex_id, CAST(comuna_id AS VARCHAR) AS comuna, weight FROM cells)
SELECT 'riesgo' AS surface, 'fine' AS unit, CAST(hex_id AS VARCHAR) AS id, round(weight, 6) AS value FROM x UNION ALL SELECT 'edad', 'coarse', comuna, round(avg(CASE WHEN weight > 3000 THEN weight END), 6) FROM x GROUP BY comuna HAVING avg(CASE WHEN weight > 3000 THEN weight END) IS NOT NULL""")
def c13_draw_units(spark: SparkSession, d: str) -> DataFrame:
    x = b.cells(spark, d).select("hex_id", F.col("comuna_id").alias("comuna"), F.col("weight").alias("riesgo"), F.when(F.col("weight") > 3000, F.col("weight")).alias("edad"))
    return rounded(export.draw_unit(x, {"riesgo": "fine", "edad": "coarse"}, "hex_id", "comuna"))


# --- grid and geometry ----------------------------------------------------------------------------------------------


@query("g02_tagged_tables", """, p AS (SELECT 'pois' AS tabla, poi_id AS id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM pois UNION ALL SELECT 'estaciones', poi_id, x * 0.5, y * 0.5 FROM pois WHERE clase = 'PROMO'),
f AS (SELECT *, (sqrt(3e0) / 3 * x - y / 3e0) / 443e0 AS q, (2e0 / 3 * y) / 443e0 AS r FROM p), g AS (SELECT *, -q - r AS s, floor(q + 0.5) AS nq, floor(r + 0.5) AS nr, floor(-q - r + 0.5) AS ns FROM f),
h AS (SELECT tabla, id, CAST(CASE WHEN abs(nq - q) > abs(nr - r) AND abs(nq - q) > abs(ns - s) THEN -nr - ns ELSE nq END AS BIGINT) AS q, CAST(CASE WHEN NOT (abs(nq - q) > abs(nr - r) AND abs(nq - q) > abs(ns - s)) AND abs(nr - r) > abs(ns - s) THEN -nq - ns ELSE nr END AS BIGINT) AS r FROM g)
SELECT h.tabla, c.hex_id, count(*) AS n FROM h JOIN cells c ON c.q = h.q AND c.r = h.r GROUP BY 1, 2""")
def g02_tagged_tables(spark: SparkSession, d: str) -> DataFrame:
    """Several point tables tagged with the cell they fall in, by one rule."""
    p = points(spark, d)
    tables = {"pois": p, "estaciones": p.where("clase = 'PROMO'").select("poi_id", "clase", (F.col("x") * 0.5).alias("x"), (F.col("y") * 0.5).alias("y"))}
    out = None
    for name, x in tables.items():
        q, r = grid.axial_cell(F.col("x"), F.col("y"), S)
        x = x.select(F.lit(name).alias("tabla"), q.cast("long").alias("q"), r.cast("long").alias("r"))
        out = x if out is None else out.unionAll(x)
    return out.join(b.cells(spark, d).select("hex_id", "q", "r"), ["q", "r"]).groupBy("tabla", "hex_id").agg(F.count("*").alias("n"))


_AXES = [(math.cos(a), math.sin(a)) for a in (0.0, math.pi / 3, 2 * math.pi / 3)]
_SEPARATE = " AND ".join(f"abs((cx - (x0 + x1) / 2) * {u!r} + (cy - (y0 + y1) / 2) * {v!r}) < 443 * sqrt(3e0) / 2 + (x1 - x0) / 2 * abs({u!r}) + (y1 - y0) / 2 * abs({v!r}) - 1e-6" for u, v in _AXES)


@query("g03_cells_of_polygons", _BOXES + f""", spots AS (SELECT zone, x0, y0, x1, y1, q, r, 443 * sqrt(3e0) * (q + r / 2e0) AS cx, 443 * 1.5e0 * r AS cy FROM boxes, (SELECT unnest(range(-400, 400)) AS q) a, (SELECT unnest(range(-4, 200)) AS r) b)
SELECT zone, q, r FROM spots WHERE {_SEPARATE} AND abs(cy - (y0 + y1) / 2) < 443 + (y1 - y0) / 2 - 1e-6""")
def g03_cells_of_polygons(spark: SparkSession, d: str) -> DataFrame:
    """Cells that overlap each zone; the SQL tests the separating axes instead of cutting."""
    return spatial.cells_of_polygons(boxes(spark, d).select("zone", "ring"), S, "zone")


@query("a16_dissolve", ", i AS (SELECT a.comuna_id, count(*) AS pairs FROM ring g JOIN cells a ON a.hex_id = g.hex_id JOIN cells c ON c.hex_id = g.nbr WHERE k = 1 AND a.comuna_id = c.comuna_id GROUP BY 1) SELECT c.comuna_id, count(*) AS cells, round(count(*) * 3 * sqrt(3e0) / 2 * 443 * 443, 3) AS area, (6 * count(*) - coalesce(any_value(pairs), 0)) * 443e0 AS outline FROM cells c LEFT JOIN i ON i.comuna_id = c.comuna_id GROUP BY 1")
def a16_dissolve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spatial.dissolve_cells(b.cells(spark, d), b.ring(spark, d, 1), "comuna_id", S), 3)


@query("g10_city_outline", "SELECT count(*) AS cells, round(count(*) * 3 * sqrt(3e0) / 2 * 443 * 443, 3) AS area, (6 * count(*) - (SELECT count(*) FROM ring WHERE k = 1)) * 443e0 AS outline FROM cells")
def g10_city_outline(spark: SparkSession, d: str) -> DataFrame:
    """The union of all cells."""
    x = b.cells(spark, d).withColumn("city", F.lit(1))
    return rounded(spatial.dissolve_cells(x, b.ring(spark, d, 1), "city", S).drop("city"), 3)


@query("g14_canvas", ", p AS (SELECT hex_id, radians(-58.4 + x / 91000) AS x, ln(tan(pi() / 4 + radians(-34.6 + y / 111320) / 2)) AS y FROM cells), e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, least(760 / (max(x) - min(x)), 560 / (max(y) - min(y))) AS k FROM p) SELECT hex_id, round(20 + (x - x0) * k, 4) AS px, round(20 + (y1 - y) * k, 4) AS py FROM p, e")
def g14_canvas(spark: SparkSession, d: str) -> DataFrame:
    x, y = spatial.web_mercator(-34.6 + F.col("y") / 111320, -58.4 + F.col("x") / 91000)
    p = b.cells(spark, d).select("hex_id", x.alias("x"), y.alias("y"))
    return rounded(spatial.fit_to_canvas(p, 800.0, 600.0, 20.0).select("hex_id", "px", "py"), 4)


_CONV = ", ".join(f"({f}, '{o}', {w})" for f, o, w in ((0, "u", "0.5e0"), (1, "u", "-0.25e0"), (0, "v", "0.1e0"), (1, "v", "2e0")))


@query("r08_graph_convolution", f""", e AS (SELECT hex_id AS i, nbr AS j FROM ring WHERE k = 1 UNION ALL SELECT hex_id, hex_id FROM cells), g AS (SELECT i, count(*) AS d FROM e GROUP BY i),
x AS (SELECT hex_id AS j, 0 AS f, weight / 1000 AS x FROM cells UNION ALL SELECT hex_id, 1, comuna_id / 10e0 FROM cells), w(f, o, w) AS (VALUES {_CONV})
SELECT e.i, w.o AS out, round(sum(x * w / sqrt(a.d * c.d)), 6) AS value FROM e JOIN g a ON a.i = e.i JOIN g c ON c.i = e.j JOIN x ON x.j = e.j JOIN w ON w.f = x.f GROUP BY 1, 2""")
def r08_graph_convolution(spark: SparkSession, d: str) -> DataFrame:
    cells = b.cells(spark, d)
    x = cells.select(F.col("hex_id").alias("j"), F.explode(F.array(F.struct(F.lit(0).alias("feature"), (F.col("weight") / 1000).cast("double").alias("x")), F.struct(F.lit(1).alias("feature"), (F.col("comuna_id") / 10).cast("double").alias("x")))).alias("s")).select("j", "s.*")
    w = spark.createDataFrame([(0, "u", 0.5), (1, "u", -0.25), (0, "v", 0.1), (1, "v", 2.0)], "feature int, out string, w double")
    return rounded(grid.graph_convolution(grid.normalised_adjacency(b.ring(spark, d, 1), cells), x, w))


@query("m03_local_moran_p", _YEARLY + """, z AS (SELECT hex_id, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z, row_number() OVER (ORDER BY hex_id) - 1 AS i, count(*) OVER () - 1 AS others FROM v WHERE anio = 2000),
l AS (SELECT w.hex_id, sum(w.w * z.z) AS lag FROM w JOIN z ON z.hex_id = w.nbr GROUP BY 1),
s AS (SELECT w.hex_id, w.w, row_number() OVER (PARTITION BY w.hex_id ORDER BY nbr) AS j, z.i, z.others FROM w JOIN z ON z.hex_id = w.hex_id),
p AS (SELECT s.*, rep, ((i * 7919 + rep * 104729 + j * 1299709) * 48271 % 2147483647) % others AS pick FROM s, (SELECT unnest(range(1, 1000)) AS rep) r),
n AS (SELECT p.hex_id, rep, sum(p.w * t.z) AS lag FROM p JOIN z t ON t.i = CASE WHEN pick >= p.i THEN pick + 1 ELSE pick END GROUP BY 1, 2),
h AS (SELECT n.hex_id, sum(CASE WHEN round(abs(z.z * n.lag), 9) >= round(abs(z.z * l.lag), 9) THEN 1 ELSE 0 END) AS c FROM n JOIN z ON z.hex_id = n.hex_id JOIN l ON l.hex_id = n.hex_id GROUP BY 1)
SELECT z.hex_id, round((coalesce(c, 999) + 1) / 1000e0, 6) AS p FROM z LEFT JOIN h ON h.hex_id = z.hex_id""")
def m03_local_moran_p(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.local_moran_p(_yearly(spark, d).where("anio = 2000"), grid.contiguity(b.ring(spark, d))))


# --- evaluation and forecasts ---------------------------------------------------------------------------------------


@query("a25b_narrated_month", _BASELINE + """, m AS (SELECT hex_id, count(*) AS n FROM incidents WHERE year(fecha) = 2000 AND month(fecha) = 6 GROUP BY 1), x AS (SELECT u.hex_id, coalesce(m.n, 0) AS real, round(u.pred / 12, 6) AS pred FROM u LEFT JOIN m ON m.hex_id = u.hex_id),
o AS (SELECT *, row_number() OVER (ORDER BY pred DESC, hex_id) AS rn, count(*) OVER () AS n FROM x) SELECT CAST(sum(real) AS BIGINT) AS real, round(sum(pred), 4) AS predicted, round(sum(CASE WHEN rn <= greatest(1, CAST(round_even(n * 0.2, 0) AS INT)) THEN real ELSE 0 END) * 1e0 / sum(real), 6) AS share_top20, round(sum(CASE WHEN rn <= 5 THEN real - pred ELSE 0 END), 4) AS top5_difference FROM o""")
def a25b_narrated_month(spark: SparkSession, d: str) -> DataFrame:
    """One month told: incidents, what was expected, the share in the top fifth of cells, and the gap in the top five."""
    x = baseline_scores(spark, d).groupBy("hex_id").agg(F.round(F.sum("pred"), 6).alias("pred"))
    n = b.incidents(spark, d).where("year(fecha) = 2000 AND month(fecha) = 6").groupBy("hex_id").agg(F.count("*").alias("n"))
    x = x.join(n, "hex_id", "left").select("hex_id", F.coalesce("n", F.lit(0)).alias("real"), F.round(F.col("pred") / 12, 6).alias("pred"))
    top = metrics.hotspots(x, [0.2]).select(F.round("recall", 6).alias("share_top20"))
    five = x.orderBy(F.desc("pred"), "hex_id").limit(5).agg(F.round(F.sum(F.col("real") - F.col("pred")), 4).alias("top5_difference"))
    sums = x.agg(F.sum("real").alias("real"), F.round(F.sum("pred"), 4).alias("predicted"))
    return sums.join(top, how="cross").join(five, how="cross")  # one row each


@query("e06_conformal_asymmetric", _panel_sql("week") + """, q AS (SELECT hex_id, turno, quantile_cont(y, 0.1) AS low, quantile_cont(y, 0.9) AS high FROM dense WHERE year(period) <= 1998 GROUP BY 1, 2),
cal AS (SELECT low - y AS below, y - high AS above FROM dense f JOIN q ON q.hex_id = f.hex_id AND q.turno = f.turno WHERE year(period) = 1999),
k AS (SELECT count(*) AS n, CAST(ceil(round((count(*) - 1) * least(1e0, ceil(round((count(*) + 1) * 0.9e0, 9)) / count(*)), 9)) AS BIGINT) AS i FROM cal),
qs AS (SELECT (SELECT below FROM (SELECT below, row_number() OVER (ORDER BY below) - 1 AS r FROM cal) o, k WHERE r = i) AS ql, (SELECT above FROM (SELECT above, row_number() OVER (ORDER BY above) - 1 AS r FROM cal) o, k WHERE r = i) AS qh)
SELECT round(any_value(ql), 6) AS q_low, round(any_value(qh), 6) AS q_high, round(avg(CASE WHEN y BETWEEN low - ql AND high + qh THEN 1e0 ELSE 0e0 END), 6) AS coverage, count(*) AS n FROM dense f JOIN q ON q.hex_id = f.hex_id AND q.turno = f.turno, qs WHERE year(period) = 2000""")
def e06_conformal_asymmetric(spark: SparkSession, d: str) -> DataFrame:
    """Corrections of either end, fitted on 1999 and judged on 2000."""
    x = dense(spark, d, "week")
    q = x.where("year(period) <= 1998").groupBy("hex_id", "turno").agg(F.percentile("y", 0.1).alias("low"), F.percentile("y", 0.9).alias("high"))
    both = x.where("year(period) IN (1999, 2000)").join(q, ["hex_id", "turno"])
    cal = both.where("year(period) = 1999").select((F.col("low") - F.col("y")).alias("below"), (F.col("y") - F.col("high")).alias("above"))
    low = metrics.higher_quantile(cal, "below", 0.9).select(F.col("q").alias("q_low"))
    high = metrics.higher_quantile(cal, "above", 0.9).select(F.col("q").alias("q_high"))
    test = both.where("year(period) = 2000").join(F.broadcast(low), how="cross").join(F.broadcast(high), how="cross")  # one row each
    inside = (F.col("y") >= F.col("low") - F.col("q_low")) & (F.col("y") <= F.col("high") + F.col("q_high"))
    return rounded(test.groupBy("q_low", "q_high").agg(F.avg(inside.cast("double")).alias("coverage"), F.count("*").alias("n")))


@query("e08_historical_means", _panel_sql("week") + """, t AS (SELECT hex_id, turno, avg(y) AS naive_full, avg(CASE WHEN year(period) = 1998 THEN y END) AS naive_last, avg(CASE WHEN year(period) >= 1997 THEN y END) AS naive_two, avg(CASE WHEN year(period) NOT IN (1996) THEN y END) AS naive_without FROM dense WHERE year(period) <= 1998 GROUP BY 1, 2),
f AS (SELECT sum(d.y) / sum(t.naive_full) AS factor FROM dense d JOIN t ON t.hex_id = d.hex_id AND t.turno = d.turno WHERE year(period) = 1999),
l AS (SELECT v.variante, d.y, v.pred FROM dense d JOIN t ON t.hex_id = d.hex_id AND t.turno = d.turno, f, LATERAL (VALUES ('naive_full', naive_full), ('naive_last', naive_last), ('naive_two', naive_two), ('naive_without', naive_without), ('naive_recalibrated', naive_full * factor)) v(variante, pred) WHERE year(period) = 2000)
SELECT variante, round(avg(abs(pred - y)), 6) AS mae, round(sqrt(avg((pred - y) * (pred - y))), 6) AS rmse, round(sum(pred) / sum(y), 6) AS level FROM l GROUP BY 1""")
def e08_historical_means(spark: SparkSession, d: str) -> DataFrame:
    """Five historical means by cell and shift, judged on 2000; the last one's level is set by the year 1999."""
    x = dense(spark, d, "week").withColumn("anio", F.year("period"))
    spans = {"naive_full": F.lit(True), "naive_last": F.col("anio") == 1998, "naive_two": F.col("anio") >= 1997, "naive_without": F.col("anio") != 1996}
    means = x.where("anio <= 1998").groupBy("hex_id", "turno").agg(*[F.avg(F.when(c, F.col("y"))).alias(n) for n, c in spans.items()])
    later = x.where("anio IN (1999, 2000)").join(means, ["hex_id", "turno"])
    factor = later.where("anio = 1999").agg((F.sum("y") / F.sum("naive_full")).alias("factor"))
    test = later.where("anio = 2000").join(F.broadcast(factor), how="cross").withColumn("naive_recalibrated", F.col("naive_full") * F.col("factor"))  # one row
    long = test.select(F.col("y").alias("real"), F.explode(F.array(*[F.struct(F.lit(n).alias("variante"), F.col(n).alias("pred")) for n in (*spans, "naive_recalibrated")])).alias("v")).select("real", "v.*")
    return rounded(metrics.error_summary(long, ["variante"]).select("variante", "mae", "rmse", "level"))


@query("l03_by_type", """, t AS (SELECT tipo, hex_id, count(*) / 5e0 AS pred FROM incidents WHERE year(fecha) BETWEEN 1995 AND 1999 GROUP BY 1, 2), a AS (SELECT hex_id, count(*) / 5e0 AS pred FROM incidents WHERE year(fecha) BETWEEN 1995 AND 1999 GROUP BY 1),
s AS (SELECT tipo, count(*) * 1e0 / sum(count(*)) OVER () AS share FROM incidents WHERE year(fecha) BETWEEN 1995 AND 1999 GROUP BY 1), r AS (SELECT tipo, hex_id, count(*) AS n FROM incidents WHERE year(fecha) = 2000 GROUP BY 1, 2),
g AS (SELECT s.tipo, c.hex_id, share FROM s, cells c) SELECT g.tipo, round(avg(abs(coalesce(t.pred, 0) - coalesce(n, 0))), 6) AS mae_own, round(avg(abs(coalesce(a.pred, 0) * share - coalesce(n, 0))), 6) AS mae_aggregate FROM g LEFT JOIN t ON t.tipo = g.tipo AND t.hex_id = g.hex_id LEFT JOIN a ON a.hex_id = g.hex_id LEFT JOIN r ON r.tipo = g.tipo AND r.hex_id = g.hex_id GROUP BY 1""")
def l03_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Each type's own yearly mean by cell against the aggregate mean times the type's share, judged on 2000."""
    x = b.incidents(spark, d).withColumn("anio", F.year("fecha")).where("anio BETWEEN 1995 AND 2000").groupBy("tipo", "hex_id").agg(F.count_if(F.col("anio") < 2000).alias("past"), F.count_if(F.col("anio") == 2000).alias("n"))
    share = x.groupBy("tipo").agg(F.sum("past").alias("p")).where("p > 0")
    total = x.agg(F.sum("past").alias("total"))
    every = b.cells(spark, d).select("hex_id").join(F.broadcast(share.join(total, how="cross").select("tipo", (F.col("p") / F.col("total")).alias("share"))), how="cross")  # a few types
    whole = x.groupBy("hex_id").agg((F.sum("past") / 5).alias("all"))
    y = every.join(x, ["tipo", "hex_id"], "left").join(whole, "hex_id", "left").fillna(0)
    return rounded(y.groupBy("tipo").agg(F.avg(F.abs(F.col("past") / 5 - F.col("n"))).alias("mae_own"), F.avg(F.abs(F.col("all") * F.col("share") - F.col("n"))).alias("mae_aggregate")))


@query("k05_error_bands", ", e AS (SELECT ds, lag(y, 12) OVER (ORDER BY ds) - y AS e FROM monthly) SELECT CAST(month(ds) AS INT) AS mes, round(quantile_cont(e, 0.05), 6) AS q_low, round(quantile_cont(e, 0.95), 6) AS q_high, count(e) AS n FROM e GROUP BY 1")
def k05_error_bands(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the seasonal naive's error by calendar month; one series, so one window."""
    e = b.monthly(spark, d).withColumn("e", F.lag("y", 12).over(Window.orderBy("ds")) - F.col("y"))
    return rounded(e.groupBy(F.month("ds").alias("mes")).agg(F.percentile("e", 0.05).alias("q_low"), F.percentile("e", 0.95).alias("q_high"), F.count("e").alias("n")))


_MODELS = """, o AS (SELECT tipo, ds AS origin, y AS last, row_number() OVER (PARTITION BY tipo ORDER BY ds DESC) AS back, avg(y) OVER (PARTITION BY tipo ORDER BY ds ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS year_mean FROM monthly_type),
g AS (SELECT o.*, CAST(h AS INT) AS h FROM o, range(1, 13) r(h) WHERE back BETWEEN 2 AND 61),
x AS (SELECT g.tipo, g.h, a.y AS real, p.y AS naive, g.last, g.year_mean FROM g JOIN monthly_type a ON a.tipo = g.tipo AND a.ds = CAST(g.origin + to_months(g.h) AS DATE) JOIN monthly_type p ON p.tipo = g.tipo AND p.ds = CAST(g.origin + to_months(g.h - 12) AS DATE)),
m AS (SELECT h, 'naive' AS model, avg(abs(naive - real)) AS mae, avg(naive - real) AS bias FROM x GROUP BY 1 UNION ALL SELECT h, 'persistence', avg(abs(last - real)), avg(last - real) FROM x GROUP BY 1 UNION ALL SELECT h, 'year_mean', avg(abs(year_mean - real)), avg(year_mean - real) FROM x GROUP BY 1)
"""


def _models(spark: SparkSession, d: str) -> DataFrame:
    """h, model, mae, bias of three simple models over 60 origins."""
    m = b.monthly(spark, d, by_type=True)
    w = Window.partitionBy("tipo").orderBy("ds")
    known = m.select("tipo", F.col("ds").alias("origin"), F.col("y").alias("persistence"), F.avg("y").over(w.rowsBetween(-11, 0)).alias("year_mean"))
    x = forecast.backtest_naive(m, 60, ["tipo"]).withColumnRenamed("pred", "naive").join(known, ["tipo", "origin"])
    long = x.select("h", "real", F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.col(k).alias("pred")) for k in ("naive", "persistence", "year_mean")])).alias("v")).select("h", "real", "v.*")
    return metrics.error_summary(long, ["h", "model"]).select("h", "model", "mae", "bias")


@query("c11_best_by_horizon", _MODELS + " SELECT h, model, round(mae, 6) AS mae FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY round(mae, 9), model) AS rn FROM m) r WHERE rn = 1")
def c11_best_by_horizon(spark: SparkSession, d: str) -> DataFrame:
    """The model of least error at each horizon."""
    best = _models(spark, d).groupBy("h").agg(F.min(F.struct(F.round("mae", 9).alias("mae"), "model")).alias("b"))
    return rounded(best.select("h", "b.model", "b.mae"))


@query("k07_export_bundle", _MODELS + " SELECT model, list(round(mae, 3) ORDER BY h) AS mae_by_horizon, round(avg(bias), 6) AS bias FROM m GROUP BY model")
def k07_export_bundle(spark: SparkSession, d: str) -> DataFrame:
    """For each model its errors in the order of horizons (twelve), and its mean bias."""
    x = _models(spark, d)
    order = F.array_sort(F.collect_list(F.struct("h", F.round("mae", 3).alias("mae"))))
    return rounded(x.groupBy("model").agg(F.transform(order, lambda s: s["mae"]).alias("mae_by_horizon"), F.avg("bias").alias("bias")))


@query("k06_final_forecast", ", n AS (SELECT tipo, count(*) AS months, max(ds) AS last FROM monthly_type GROUP BY 1 HAVING count(*) >= 36) SELECT m.tipo, CAST(m.ds + INTERVAL 12 MONTH AS DATE) AS ds, m.y AS yhat FROM monthly_type m JOIN n ON n.tipo = m.tipo WHERE m.ds > CAST(n.last - INTERVAL 12 MONTH AS DATE)")
def k06_final_forecast(spark: SparkSession, d: str) -> DataFrame:
    """The year ahead for each type with three years of history, by the seasonal naive model."""
    m = b.monthly(spark, d, by_type=True)
    long = m.groupBy("tipo").agg(F.count("*").alias("n")).where(F.col("n") >= forecast.MIN_HISTORY).select("tipo")
    return forecast.seasonal_naive(m.join(long, "tipo"), ["tipo"]).select("tipo", "ds", "yhat")


# --- plans, sweeps and scenarios --------------------------------------------------------------------------------------

_TODAY = _REACH + """, w AS (SELECT hex_id, count(*) AS n FROM incidents GROUP BY 1), top AS (SELECT hex_id FROM (SELECT hex_id, row_number() OVER (ORDER BY n DESC, hex_id) AS rn FROM w) t WHERE rn <= 14),
held AS (SELECT c.comuna_id, c.hex_id, n, c.hex_id IN (SELECT node FROM reach WHERE source IN (SELECT hex_id FROM top)) AS plan, c.hex_id IN (SELECT node FROM reach JOIN cells s ON s.hex_id = source WHERE s.weight > 9000) AS today FROM cells c JOIN w ON w.hex_id = c.hex_id)
"""


@query("c10_plan_vs_today", _TODAY + "SELECT comuna_id, round(sum(CASE WHEN plan THEN n ELSE 0 END) * 1e0 / sum(n), 6) AS plan, round(sum(CASE WHEN today THEN n ELSE 0 END) * 1e0 / sum(n), 6) AS today, sum(CASE WHEN plan THEN n ELSE 0 END) < sum(CASE WHEN today THEN n ELSE 0 END) AS worse FROM held GROUP BY 1")
def c10_plan_vs_today(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by district of the fourteen busiest cells as sites, against the sites of today, and who loses."""
    w = b.incidents(spark, d).groupBy("hex_id").agg(F.count("*").alias("weight"))
    cells, cov = b.cells(spark, d), reach(spark, d).select(F.col("source").alias("candidate"), F.col("node").alias("demand"))
    dem = cells.drop("weight").join(w, "hex_id").select(F.col("hex_id").alias("demand"), "weight", "comuna_id")
    plan = w.orderBy(F.desc("weight"), "hex_id").limit(14).select(F.col("hex_id").alias("candidate"))
    today = cells.where("weight > 9000").select(F.col("hex_id").alias("candidate"))
    x = allocation.coverage_by_group(plan, cov, dem, "comuna_id").withColumnRenamed("coverage", "plan")
    y = allocation.coverage_by_group(today, cov, dem, "comuna_id").withColumnRenamed("coverage", "today")
    return rounded(x.join(y, "comuna_id").withColumn("worse", F.col("plan") < F.col("today")))


_SITES = ", sites AS (SELECT hex_id AS candidate, row_number() OVER (ORDER BY weight DESC, hex_id) AS place FROM cells)"


@query("o04_ranked_coverage", _REACH + _SITES + """, radii(radius) AS (VALUES (300e0), (400e0), (500e0), (600e0), (700e0), (750e0), (800e0)), f AS (SELECT radius, node, min(place) AS place FROM reach JOIN sites ON candidate = source, radii WHERE dist <= radius GROUP BY 1, 2)
SELECT radius, CAST(k AS INT) AS k, round(sum(CASE WHEN place <= k THEN c.weight ELSE 0 END) / (SELECT sum(weight) FROM cells), 6) AS covered FROM f JOIN cells c ON c.hex_id = node, (SELECT unnest([5, 10, 15, 20, 30, 40, 50, 60, 75, 110]) AS k) ks GROUP BY 1, 2""")
def o04_ranked_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Seven radii by ten plan sizes of one ranking of sites, from one reach table at the largest radius."""
    cells = b.cells(spark, d)
    ranking = cells.select(F.col("hex_id").alias("candidate"), F.row_number().over(Window.orderBy(F.desc("weight"), "hex_id")).alias("place"))
    near = reach(spark, d).select(F.col("source").alias("candidate"), F.col("node").alias("demand"), "dist")
    dem = cells.select(F.col("hex_id").alias("demand"), "weight")
    return rounded(allocation.ranked_coverage(ranking, near, dem, (300.0, 400.0, 500.0, 600.0, 700.0, 750.0, 800.0), (5, 10, 15, 20, 30, 40, 50, 60, 75, 110)))


@query("o12_ranked_gain", _REACH + _SITES + ", f AS (SELECT node, min(place) AS place FROM reach JOIN sites ON candidate = source WHERE dist <= 800 GROUP BY 1) SELECT round(sum(CASE WHEN place <= 10 THEN weight ELSE 0 END) / sum(weight), 6) AS base, round(sum(CASE WHEN place <= 16 THEN weight ELSE 0 END) / sum(weight), 6) AS scenario, round(sum(CASE WHEN place BETWEEN 11 AND 16 THEN weight ELSE 0 END) / sum(weight), 6) AS gain FROM cells c LEFT JOIN f ON f.node = c.hex_id")
def o12_ranked_gain(spark: SparkSession, d: str) -> DataFrame:
    """What six more sites add to ten."""
    cells = b.cells(spark, d)
    ranking = cells.select(F.col("hex_id").alias("candidate"), F.row_number().over(Window.orderBy(F.desc("weight"), "hex_id")).alias("place"))
    near = reach(spark, d).select(F.col("source").alias("candidate"), F.col("node").alias("demand"), "dist")
    x = allocation.ranked_coverage(ranking, near, cells.select(F.col("hex_id").alias("demand"), "weight"), (800.0,), (10, 16))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("covered")))
    return rounded(x.agg(at(10).alias("base"), at(16).alias("scenario"), (at(16) - at(10)).alias("gain")))


@query("o11_conditions", ", x AS (SELECT hex_id, comuna_id, weight, comuna_id * 10e0 AS light, CASE WHEN comuna_id IN (3, 7) THEN 250e0 ELSE comuna_id * 10e0 END AS light2 FROM cells) SELECT hex_id, round(weight * (1 + light / 100), 6) AS base, round(weight * (1 + light2 / 100), 6) AS scenario, round(weight * (light2 - light) / 100, 6) AS delta FROM x")
def o11_conditions(spark: SparkSession, d: str) -> DataFrame:
    """A scenario: a feature set to another value in chosen cells, both states scored, and the difference."""
    from ..operators.panel import override

    x = b.cells(spark, d).select("hex_id", "weight", (F.col("comuna_id") * 10.0).alias("light"), "comuna_id")
    changes = x.where("comuna_id IN (3, 7)").select("hex_id", F.lit("light").alias("feature"), F.lit(250.0).alias("value"))
    score = lambda df, name: df.select("hex_id", (F.col("weight") * (1 + F.col("light") / 100)).alias(name))
    both = score(x, "base").join(score(override(x, changes, ["light"]), "scenario"), "hex_id")
    return rounded(both.withColumn("delta", F.col("scenario") - F.col("base")))


@query("o06_busiest_retention", _PLANS + ", risk AS (SELECT tipo AS surface, hex_id AS candidate, count(*) AS risk FROM incidents WHERE year(fecha) = 2000 GROUP BY 1, 2), h AS (SELECT plan, surface, sum(risk) AS held FROM plans JOIN risk ON risk.candidate = plans.candidate GROUP BY 1, 2) SELECT h.plan, h.surface, round(h.held * 1e0 / o.held, 6) AS retained FROM h JOIN h o ON o.surface = h.surface AND o.plan = o.surface")
def o06_busiest_retention(spark: SparkSession, d: str) -> DataFrame:
    """What the plan for each type keeps of the risk of every other."""
    n = b.incidents(spark, d).where(F.year("fecha") == 2000).groupBy(F.col("tipo").alias("surface"), F.col("hex_id").alias("candidate")).agg(F.count("*").alias("risk"))
    top = n.withColumn("rn", F.row_number().over(Window.partitionBy("surface").orderBy(F.desc("risk"), "candidate"))).where("rn <= 10").select(F.col("surface").alias("plan"), "candidate")
    return rounded(allocation.retention(top, n))


_SWEEP = _SEGMENTS + """, hits AS (SELECT b AS parameter, seg // 1000000 AS access, count(DISTINCT poi_id) AS n FROM near, (VALUES (10), (20), (30), (40), (50), (60), (75)) bs(b) WHERE dist <= b GROUP BY 1, 2),
km AS (SELECT u AS access, sum(length_m) / 1000 AS km FROM roads GROUP BY 1), every AS (SELECT DISTINCT seg // 1000000 AS access FROM seg), grid2 AS (SELECT access, b AS parameter FROM every, (VALUES (10), (20), (30), (40), (50), (60), (75)) bs(b)),
ranked AS (SELECT g.parameter, g.access, row_number() OVER (PARTITION BY g.parameter ORDER BY round(coalesce(n, 0) / km, 9) DESC, g.access) AS ranking FROM grid2 g JOIN km ON km.access = g.access LEFT JOIN hits h ON h.access = g.access AND h.parameter = g.parameter)
"""


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    """parameter (buffer in metres), access, ranking: accesses by crashes a kilometre, from one join at the widest buffer."""
    widths = (10, 20, 30, 40, 50, 60, 75)
    near = spatial.points_near_segments(points(spark, d), segments(spark, d), float(max(widths)), "poi_id", "seg").withColumn("access", F.expr("seg div 1000000"))
    near = near.groupBy("access", "poi_id").agg(F.min("dist").alias("dist")).withColumn("parameter", F.explode(F.array(*map(F.lit, widths)))).where("dist <= parameter")
    hits = near.groupBy("parameter", "access").agg(F.count("*").alias("n"))
    km = b.roads(spark, d).groupBy(F.col("u").alias("access")).agg((F.sum("length_m") / 1000).alias("km"))
    every = segments(spark, d).select(F.expr("seg div 1000000").alias("access")).distinct().withColumn("parameter", F.explode(F.array(*map(F.lit, widths))))
    x = every.join(hits, ["parameter", "access"], "left").join(km, "access").withColumn("per_km", F.round(F.coalesce("n", F.lit(0)) / F.col("km"), 9))
    return x.select("parameter", "access", F.row_number().over(Window.partitionBy("parameter").orderBy(F.desc("per_km"), "access")).cast("long").alias("ranking"))


@query("j25_aligned_rankings", _SWEEP + "SELECT a.access, a.ranking AS at_30, c.ranking AS at_60, c.ranking - a.ranking AS moved FROM ranked a JOIN ranked c ON c.access = a.access WHERE a.parameter = 30 AND c.parameter = 60")
def j25_aligned_rankings(spark: SparkSession, d: str) -> DataFrame:
    x = _sweep(spark, d)
    a, c = x.where("parameter = 30").select("access", F.col("ranking").alias("at_30")), x.where("parameter = 60").select("access", F.col("ranking").alias("at_60"))
    return a.join(c, "access").withColumn("moved", F.col("at_60") - F.col("at_30"))


@query("o10_buffer_sweep", _SWEEP + "SELECT r.parameter, round(corr(r.ranking, b.ranking), 6) AS spearman, sum(CASE WHEN r.ranking <> b.ranking THEN 1 ELSE 0 END) AS moved FROM ranked r JOIN ranked b ON b.access = r.access AND b.parameter = 30 GROUP BY 1")
def o10_buffer_sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(allocation.rank_stability(_sweep(spark, d), 30))


@query("s27_layer_geojson", "SELECT clase, count(*) AS n, round(sum(round(x / 91000e0, 6)), 4) AS lon, round(sum(round(y / 111320e0, 6)), 4) AS lat FROM pois WHERE clase IN ('PROMO', 'ECONOMY') GROUP BY 1")
def s27_layer_geojson(spark: SparkSession, d: str) -> DataFrame:
    """Two layers as point features of six decimals, read again from their text."""
    x = points(spark, d).where("clase IN ('PROMO', 'ECONOMY')").select(export.point_feature(F.col("x") / 91000, F.col("y") / 111320, {"clase": F.col("clase")}).alias("f"))
    f = x.select(F.from_json("f", "geometry struct<coordinates: array<double>>, properties struct<clase: string>").alias("f"))
    return f.groupBy(F.col("f.properties.clase").alias("clase")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("f.geometry.coordinates")[0]), 4).alias("lon"), F.round(F.sum(F.col("f.geometry.coordinates")[1]), 4).alias("lat"))


@query("o13_plan_names", "SELECT turno, k, 'plan_' || turno || '_k' || k || '.json' AS file FROM (VALUES ('tarde'), ('noche')) t(turno), (SELECT DISTINCT CAST(comuna_id AS INT) AS k FROM cells) c WHERE k > 0")
def o13_plan_names(spark: SparkSession, d: str) -> DataFrame:
    """The file of each plan, by shift and size."""
    k = b.cells(spark, d).select(F.col("comuna_id").cast("int").alias("k")).where("k > 0").distinct()
    return k.withColumn("turno", F.explode(F.array(F.lit("tarde"), F.lit("noche")))).select("turno", "k", F.concat(F.lit("plan_"), "turno", F.lit("_k"), F.col("k").cast("string"), F.lit(".json")).alias("file"))


# --- parsing of single values -----------------------------------------------------------------------------------------


@query("f03_line_number", "SELECT s_suppkey AS id, CAST(regexp_extract(s_name, '([0-9]+)', 1) AS BIGINT) AS line FROM supplier")
def f03_line_number(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), scalars.number_in(F.col("s_name")).alias("line"))


@query("f04_thousands", "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey * 1234.5e0 END AS value FROM customer")
def f04_thousands(spark: SparkSession, d: str) -> DataFrame:
    """Numbers written with dots for thousands and a comma for decimals; other text gives null."""
    k = F.col("c_custkey")
    text = F.when(k % 7 == 0, "s/d").otherwise(scalars.regional_number(k * 1234.5, 1))
    return b.table(spark, d, "customer").select(k.alias("id"), scalars.thousands(text).alias("value"))


@query("f05_wkt_point", "SELECT poi_id AS id, CAST(x AS DOUBLE) AS x, CAST(-y AS DOUBLE) AS y FROM pois")
def f05_wkt_point(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    x, y = scalars.wkt_point(F.concat(F.lit("POINT ("), F.col("x").cast("decimal(20,1)").cast("string"), F.lit(" "), (-F.col("y")).cast("decimal(20,1)").cast("string"), F.lit(")")))
    return p.select(F.col("poi_id").alias("id"), x.alias("x"), y.alias("y"))


@query("f06_day_first", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_hours(CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 24 END AS INT)) END AS ts FROM orders")
def f06_day_first(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps written day first, with or without a time; other text gives null."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "d/M/yyyy")
    hour = (k % 24).cast("int")
    text = F.when(k % 5 == 0, "sin dato").when(k % 3 == 0, day).when(k % 3 == 1, F.concat(day, F.format_string(" %d:00", hour))).otherwise(F.concat(day, F.format_string(" %d:00:00", hour)))
    return b.table(spark, d, "orders").select(k.alias("id"), scalars.day_first(text).alias("ts"))


@query("f07_period_date", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 31 + 1 <= day(last_day(CAST(o_orderdate AS DATE))) THEN CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(o_orderkey % 31 AS INT) END AS fecha FROM orders")
def f07_period_date(spark: SparkSession, d: str) -> DataFrame:
    """Dates of a yyyyMM period and a day's number; null where the month has no such day."""
    x = b.table(spark, d, "orders")
    return x.select(F.col("o_orderkey").alias("id"), scalars.period_date(F.date_format("o_orderdate", "yyyyMM"), (F.col("o_orderkey") % 31 + 1)).alias("fecha"))


@query("a22_equity_summary", _TODAY + ", s AS (SELECT comuna_id, sum(CASE WHEN plan THEN n ELSE 0 END) * 1e0 / sum(n) AS coverage FROM held GROUP BY 1) SELECT (SELECT comuna_id FROM s ORDER BY round(coverage, 9), comuna_id LIMIT 1) AS worst, (SELECT comuna_id FROM s ORDER BY round(coverage, 9) DESC, comuna_id LIMIT 1) AS best, round(max(coverage) - min(coverage), 6) AS gap, round(median(coverage), 6) AS median, sum(CASE WHEN coverage < 0.1 THEN 1 ELSE 0 END) AS below FROM s")
def a22_equity_summary(spark: SparkSession, d: str) -> DataFrame:
    """Of the fourteen busiest sites' coverage by district: the worst, the best, the gap, the median, and how many have under a tenth."""
    w = b.incidents(spark, d).groupBy("hex_id").agg(F.count("*").alias("weight"))
    cov = reach(spark, d).select(F.col("source").alias("candidate"), F.col("node").alias("demand"))
    dem = b.cells(spark, d).drop("weight").join(w, "hex_id").select(F.col("hex_id").alias("demand"), "weight", "comuna_id")
    plan = w.orderBy(F.desc("weight"), "hex_id").limit(14).select(F.col("hex_id").alias("candidate"))
    return rounded(allocation.equity_summary(allocation.coverage_by_group(plan, cov, dem, "comuna_id"), "comuna_id"))


@query("l06_importance", """, x AS (SELECT c.hex_id, coalesce(n, 0) AS y, weight AS a, comuna_id * 1e0 AS b, q * 1e0 AS c FROM cells c LEFT JOIN (SELECT hex_id, count(*) AS n FROM incidents WHERE year(fecha) = 2000 GROUP BY 1) i ON i.hex_id = c.hex_id)
SELECT f.feature, round(abs(f.r), 6) AS importance, row_number() OVER (ORDER BY round(abs(f.r), 9) DESC, f.feature) AS place FROM (SELECT 'weight' AS feature, corr(y, a) AS r FROM x UNION ALL SELECT 'comuna', corr(y, b) FROM x UNION ALL SELECT 'q', corr(y, c) FROM x) f""")
def l06_importance(spark: SparkSession, d: str) -> DataFrame:
    """Features by the strength of their correlation with next year's count, the model-free measure of importance."""
    n = b.incidents(spark, d).where("year(fecha) = 2000").groupBy("hex_id").agg(F.count("*").alias("n"))
    x = b.cells(spark, d).join(n, "hex_id", "left").select(F.coalesce("n", F.lit(0)).alias("y"), F.col("weight").alias("weight"), F.col("comuna_id").alias("comuna"), "q")
    return rounded(statistics.correlation_importance(x, "y", ["weight", "comuna", "q"]))
