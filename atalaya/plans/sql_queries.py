"""Queries that plain SQL says best: one text over the domain tables, read by Spark here and by DuckDB as the check."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .. import bindings
from .registry import query

SOURCES = {
    "cells": bindings.cells, "incidents": bindings.incidents, "incidents_h": bindings.incidents_h, "monthly": bindings.monthly, "pois": bindings.pois, "ring": bindings.ring, "roads": bindings.roads,
    "monthly_type": lambda s, d: bindings.monthly(s, d, by_type=True),
}


def shared(name: str, sql: str) -> None:
    """Register SQL whose {tables} are domain tables, or else tables of the folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = set(re.findall(r"\{(\w+)\}", sql))
        return spark.sql(sql, **{t: SOURCES[t](spark, sf_dir) if t in SOURCES else bindings.table(spark, sf_dir, t) for t in used})

    run.__doc__ = f"{name}: see its SQL."
    query(name, re.sub(r"\{(\w+)\}", r"\1", sql))(run)


# --- cleaning -------------------------------------------------------------------------------------------------------
shared("p03_valid_coordinates", "SELECT poi_id, x, y FROM {pois} WHERE x IS NOT NULL AND y IS NOT NULL AND x <> 0 AND y <> 0")
shared("p04_bounding_box", "SELECT poi_id, CASE WHEN x BETWEEN 1000 AND 5000 AND y BETWEEN 500 AND 4000 THEN x END AS x, CASE WHEN x BETWEEN 1000 AND 5000 AND y BETWEEN 500 AND 4000 THEN y END AS y FROM {pois}")
shared("p05_range_projection", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS height, p_type AS species FROM {part} WHERE p_size BETWEEN 0 AND 40")
shared("p12_clip", "SELECT c_custkey, least(greatest(c_acctbal, 0.0), 5000.0) AS clipped FROM {customer}")
shared(
    "p13_ratio_fill",
    "SELECT c_nationkey AS zone, count(*) AS homes, round(coalesce(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) * 1e0 / nullif(count(*), 0), 0), 6) AS nbi_frac FROM {customer} GROUP BY c_nationkey",
)
shared("p14_street_class", "SELECT u, v, CASE WHEN clase = 0 THEN 'motorway' WHEN clase IN (1, 2) THEN 'avenue' WHEN clase = 3 THEN 'street' ELSE 'other' END AS street FROM {roads}")
shared("p17_rain_flag", "SELECT event_id, coalesce(value > 1.0, false) AS rain FROM {events}")
shared(
    "p20_year_split",
    "SELECT CASE WHEN year(fecha) <= 1999 THEN 'train' WHEN year(fecha) = 2000 THEN 'val' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT hex_id) AS cells FROM {incidents} GROUP BY 1",
)
shared("p22_latest_snapshot", "SELECT hex_id, turno, tipo, cantidad FROM {incidents} WHERE fecha = (SELECT max(fecha) FROM {incidents})")

# --- joins ----------------------------------------------------------------------------------------------------------
shared(
    "j01_dimension_join",
    "SELECT c.comuna_id, n.n_regionkey, count(*) AS n, round(sum(i.cantidad), 6) AS amount FROM {incidents} i LEFT JOIN {cells} c ON i.hex_id = c.hex_id LEFT JOIN {nation} n ON c.comuna_id = n.n_nationkey GROUP BY c.comuna_id, n.n_regionkey",
)
shared(
    "j05_event_flags",
    """SELECT g.hex_id, g.fecha, f.hex_id IS NOT NULL AS event_here FROM (SELECT DISTINCT hex_id, fecha FROM {incidents_h}) g
    LEFT JOIN (SELECT DISTINCT hex_id, fecha FROM {incidents_h} WHERE tipo = 'purchase') f ON g.hex_id = f.hex_id AND g.fecha = f.fecha""",
)
shared(
    "j07_full_outer",
    """SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.customers, 0) AS customers, coalesce(b.rich_suppliers, 0) AS rich_suppliers
    FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM {customer} WHERE c_acctbal > 5000 GROUP BY c_nationkey) a
    FULL OUTER JOIN (SELECT s_nationkey AS nation, count(*) AS rich_suppliers FROM {supplier} WHERE s_acctbal > 8000 GROUP BY s_nationkey) b ON a.nation = b.nation""",
)
shared("j10_semi_join", "SELECT hex_id, comuna_id FROM {cells} c WHERE EXISTS (SELECT 1 FROM {incidents_h} i WHERE i.hex_id = c.hex_id)")
shared("j11_anti_join", "SELECT c_custkey, c_nationkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND year(o.o_orderdate) = 2000)")
shared(
    "j23_ratio_to_last_year",
    """SELECT b.mes, b.subtipo, a.n AS before, b.n AS after, round(b.n * 1e0 / a.n, 6) AS ratio
    FROM (SELECT month(fecha) AS mes, subtipo, count(*) AS n FROM {incidents} WHERE year(fecha) = 1999 GROUP BY 1, 2) a
    JOIN (SELECT month(fecha) AS mes, subtipo, count(*) AS n FROM {incidents} WHERE year(fecha) = 2000 GROUP BY 1, 2) b ON a.mes = b.mes AND a.subtipo = b.subtipo""",
)
shared("j26_demand_weights", "SELECT c.hex_id, round(c.weight * z.old_frac, 6) AS elderly FROM {cells} c JOIN (SELECT c_nationkey AS zone, avg(CASE WHEN c_acctbal > 7000 THEN 1e0 ELSE 0e0 END) AS old_frac FROM {customer} GROUP BY c_nationkey) z ON z.zone = c.comuna_id")

# --- aggregation ----------------------------------------------------------------------------------------------------
shared("a01_counts", "SELECT hex_id, fecha, turno, count(*) AS n FROM {incidents} GROUP BY hex_id, fecha, turno")
shared("a02_counts_with_zero", "SELECT c.hex_id, coalesce(p.n, 0) AS cameras FROM {cells} c LEFT JOIN (SELECT user_id AS hex_id, count(*) AS n FROM {events} GROUP BY user_id) p ON p.hex_id = c.hex_id")
shared(
    "a03_two_levels",
    """SELECT hex_id, hora, sum(viajes) AS viajes, count(*) AS stations FROM (SELECT user_id, hex_id, hora, count(*) AS viajes FROM {incidents_h} GROUP BY user_id, hex_id, hora) s GROUP BY hex_id, hora""",
)
shared("a04_historical_mean", "SELECT hex_id, turno, round(avg(n), 6) AS mean FROM (SELECT hex_id, turno, fecha, count(*) AS n FROM {incidents} WHERE year(fecha) <= 1999 GROUP BY hex_id, turno, fecha) d GROUP BY hex_id, turno")
shared("a05_named_aggregates", "SELECT comuna_id, round(sum(weight), 4) AS total, round(avg(weight), 6) AS mean, min(barrio_id) AS barrio_id, count(*) AS cells FROM {cells} GROUP BY comuna_id")
shared(
    "a07_pivot",
    "SELECT hex_id, sum(CASE WHEN turno = 'Mañana' THEN 1 ELSE 0 END) AS manana, sum(CASE WHEN turno = 'Tarde' THEN 1 ELSE 0 END) AS tarde, sum(CASE WHEN turno = 'Noche' THEN 1 ELSE 0 END) AS noche, sum(CASE WHEN turno = 'Madrugada' THEN 1 ELSE 0 END) AS madrugada FROM {incidents} GROUP BY hex_id",
)
shared("a08_composition", "SELECT anio, tipo, round(n * 1e0 / sum(n) OVER (PARTITION BY anio), 6) AS share FROM (SELECT year(fecha) AS anio, tipo, count(*) AS n FROM {incidents} GROUP BY 1, 2) t")
shared("a09_distinct_counts", "SELECT tipo, count(DISTINCT hex_id) AS cells, count(DISTINCT fecha) AS days FROM {incidents} GROUP BY tipo")
shared(
    "a10_mode",
    "SELECT user_id, tipo, n FROM (SELECT user_id, tipo, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, tipo) AS rn FROM (SELECT user_id, event_type AS tipo, count(*) AS n FROM {events} GROUP BY user_id, event_type) c) r WHERE rn = 1",
)
shared(
    "a12_profiles",
    """SELECT coalesce(tipo, 'todos') AS tipo, turno, count(*) AS n FROM {incidents} WHERE year(fecha) = 2000 GROUP BY GROUPING SETS ((tipo, turno), (turno))""",
)
shared("a13_monthly_by_type", "SELECT tipo, CAST(date_trunc('month', fecha) AS DATE) AS ds, count(*) AS n, round(sum(cantidad), 4) AS amount FROM {incidents} GROUP BY 1, 2")
shared("a14_weighted_share", "SELECT c_mktsegment AS segment, round(sum(CASE WHEN c_acctbal < 0 THEN 1e0 ELSE 0e0 END) / count(*), 6) AS frac, round(sum(c_acctbal * c_nationkey) / sum(c_nationkey), 6) AS weighted FROM {customer} GROUP BY c_mktsegment")
shared(
    "a17_allocation",
    """SELECT s.hex_id, round(sum(t.pax * s.stops * 1e0 / t.stops), 4) AS pax FROM (SELECT tipo, hex_id, count(*) AS stops FROM {incidents_h} GROUP BY tipo, hex_id) s
    JOIN (SELECT tipo, count(*) AS stops, sum(value) AS pax FROM {incidents_h} GROUP BY tipo) t ON t.tipo = s.tipo GROUP BY s.hex_id""",
)
shared("a18_last_complete_year", "SELECT max(anio) AS anio FROM (SELECT year(ds) AS anio FROM {monthly} GROUP BY 1 HAVING count(DISTINCT month(ds)) >= 12) y")
shared(
    "a22_equity_of_coverage",
    """SELECT comuna_id, round(sum(CASE WHEN covered THEN weight ELSE 0 END) / sum(weight), 6) AS coverage, count(*) AS cells FROM
    (SELECT c.comuna_id, c.weight, EXISTS (SELECT 1 FROM {ring} r JOIN {incidents_h} i ON i.hex_id = r.nbr WHERE r.hex_id = c.hex_id AND r.k = 1 AND i.hora = 3 AND i.tipo = 'purchase') AS covered FROM {cells} c) x GROUP BY comuna_id""",
)
shared("a23_level_vs_base", "SELECT anio, n, round(n * 1e0 / (SELECT avg(n) FROM (SELECT year(fecha) AS anio, count(*) AS n FROM {incidents} WHERE year(fecha) BETWEEN 1995 AND 1997 GROUP BY 1) b), 6) AS level FROM (SELECT year(fecha) AS anio, count(*) AS n FROM {incidents} GROUP BY 1) y")
shared("a24_index_numbers", "SELECT mes, n, round(n / avg(n) OVER (), 6) AS idx FROM (SELECT month(fecha) AS mes, count(*) AS n FROM {incidents} GROUP BY 1) m")
shared("a29_repeated_points", "SELECT poi_id, x, y, count(*) OVER (PARTITION BY x, y) >= 2 AS repeated FROM {pois}")
shared("a30_rollup_barrio", "SELECT c.barrio_id, c.comuna_id, count(DISTINCT c.hex_id) AS cells, count(i.hex_id) AS n, round(count(i.hex_id) * 1e0 / count(DISTINCT c.hex_id), 6) AS per_cell FROM {cells} c LEFT JOIN {incidents} i ON i.hex_id = c.hex_id GROUP BY c.barrio_id, c.comuna_id")
shared("a32_dispersion", "SELECT tipo, round(var_samp(n) / avg(n), 6) AS dispersion, round(avg(CASE WHEN n = 1 THEN 1e0 ELSE 0e0 END), 6) AS share_one FROM (SELECT tipo, hex_id, fecha, count(*) AS n FROM {incidents} GROUP BY tipo, hex_id, fecha) c GROUP BY tipo")
shared("a33_weighted_survey", "SELECT c.comuna_id, round(sum(CASE WHEN c.comuna_id <> i.user_id % 25 THEN i.value ELSE 0 END), 4) AS visits FROM {incidents_h} i JOIN {cells} c ON c.hex_id = i.hex_id GROUP BY c.comuna_id")

# --- windows, order, sets -------------------------------------------------------------------------------------------
shared("w04_population_share", "SELECT hex_id, round(pop * weight / sum(weight) OVER (PARTITION BY comuna_id), 6) AS people FROM {cells} c JOIN (SELECT c_nationkey, count(*) AS pop FROM {customer} GROUP BY c_nationkey) p ON p.c_nationkey = c.comuna_id")
shared(
    "w05_percentile_rank",
    "SELECT hex_id, round((rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) / count(n) OVER (), 6) AS pct FROM (SELECT hex_id, count(*) AS n FROM {incidents} GROUP BY hex_id) c",
)
shared("w07_cumulative_share", "SELECT hex_id, n, round(sum(n) OVER (ORDER BY n DESC, hex_id ROWS UNBOUNDED PRECEDING) * 1e0 / sum(n) OVER (), 6) AS cum FROM (SELECT hex_id, count(*) AS n FROM {incidents} GROUP BY hex_id) c")
shared("w08_seasonal_difference", "SELECT tipo, ds, y, y - lag(y, 12) OVER (PARTITION BY tipo ORDER BY ds) AS diff FROM {monthly_type}")
shared("w10_trailing_mean", "SELECT tipo, ds, round(avg(y) OVER (PARTITION BY tipo ORDER BY ds ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS mean12 FROM {monthly_type}")
shared("w11_first_of_group", "SELECT clase, poi_id, x FROM (SELECT clase, poi_id, x, row_number() OVER (PARTITION BY clase ORDER BY x, poi_id) AS rn FROM {pois}) r WHERE rn = 1")
shared("t03_top_n", "SELECT hex_id, n FROM (SELECT hex_id, count(*) AS n FROM {incidents} GROUP BY hex_id) c ORDER BY n DESC, hex_id LIMIT 10")
shared("t04_greedy_top", "SELECT hex_id, weight, row_number() OVER (ORDER BY weight DESC, hex_id) AS ranking FROM {cells} ORDER BY weight DESC, hex_id LIMIT 30")
shared(
    "t02_top_overlap",
    """SELECT count(*) AS shared FROM (SELECT hex_id, row_number() OVER (ORDER BY count(*) DESC, hex_id) AS rn FROM {incidents} WHERE year(fecha) = 1999 GROUP BY hex_id) a
    JOIN (SELECT hex_id, row_number() OVER (ORDER BY count(*) DESC, hex_id) AS rn FROM {incidents} WHERE year(fecha) = 2000 GROUP BY hex_id) b ON a.hex_id = b.hex_id
    WHERE a.rn <= (SELECT count(*) FROM {cells}) / 5 AND b.rn <= (SELECT count(*) FROM {cells}) / 5""",
)
shared("u01_union_all", "SELECT hex_id AS candidate, 'cell' AS kind FROM {cells} UNION ALL SELECT user_id, 'station' FROM {incidents_h} GROUP BY user_id")
shared("u03_intersect", "SELECT hex_id FROM {incidents} WHERE tipo = 'R' AND year(fecha) = 2000 INTERSECT SELECT hex_id FROM {incidents_h} WHERE hora < 6")
shared("u04_except", "SELECT hex_id FROM {cells} EXCEPT SELECT hex_id FROM {incidents_h} WHERE hora = 3 AND tipo = 'purchase'")

# --- graph, statistics ----------------------------------------------------------------------------------------------
shared("r06_edge_demand", "SELECT u, v, round(length_m / 1000 * (a.weight + b.weight) / 2, 6) AS demand FROM {roads} e JOIN {cells} a ON a.hex_id = e.u JOIN {cells} b ON b.hex_id = e.v")
shared(
    "m04_spearman",
    """SELECT round(corr(ra, rb), 6) AS rho FROM (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb
    FROM (SELECT hex_id, CAST(sum(CASE WHEN year(fecha) = 1999 THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN year(fecha) = 2000 THEN 1 ELSE 0 END) AS DOUBLE) AS b FROM {incidents} GROUP BY hex_id) c) r""",
)
shared(
    "m05_partial_correlation",
    """SELECT round(xy, 6) AS pearson, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM (SELECT corr(x, y) AS xy, corr(x, z) AS xz, corr(y, z) AS yz FROM
    (SELECT CAST(s.n AS DOUBLE) AS x, c.weight AS y, CAST(c.comuna_id AS DOUBLE) AS z FROM {cells} c JOIN (SELECT hex_id, count(*) AS n FROM {incidents} GROUP BY hex_id) s ON s.hex_id = c.hex_id) v) w""",
)
shared(
    "m06_ratio_slope",
    """SELECT round(slope, 6) AS slope, CASE WHEN abs(slope) < 0.01 THEN 'step' WHEN slope > 0 THEN 'ramp' ELSE 'progressive fall' END AS label FROM (SELECT regr_slope(b.n * 1e0 / a.n, CAST(a.mes AS DOUBLE)) AS slope FROM
    (SELECT month(fecha) AS mes, count(*) AS n FROM {incidents} WHERE year(fecha) = 1999 GROUP BY 1) a JOIN (SELECT month(fecha) AS mes, count(*) AS n FROM {incidents} WHERE year(fecha) = 2000 GROUP BY 1) b ON a.mes = b.mes) s""",
)
shared(
    "m07_noise_of_ratios",
    """SELECT tipo, round(stddev_samp(b * 1e0 / a) / avg(b * 1e0 / a), 6) AS cv, round(sqrt(avg(1e0 / a + 1e0 / b)), 6) AS expected FROM (SELECT i.tipo, c.comuna_id, sum(CASE WHEN year(fecha) = 1999 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN year(fecha) = 2000 THEN 1 ELSE 0 END) AS b
    FROM {incidents} i JOIN {cells} c ON c.hex_id = i.hex_id GROUP BY i.tipo, c.comuna_id) x WHERE a > 0 AND b > 0 GROUP BY tipo""",
)
shared(
    "m08_reweighted_mix",
    """SELECT i.hex_id, round(sum(w.weight), 6) AS n FROM {incidents} i JOIN (SELECT tipo, (a * 1e0 / sum(a) OVER ()) / (b * 1e0 / sum(b) OVER ()) AS weight FROM
    (SELECT tipo, sum(CASE WHEN year(fecha) = 1999 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN year(fecha) = 2000 THEN 1 ELSE 0 END) AS b FROM {incidents} GROUP BY tipo) t) w ON w.tipo = i.tipo WHERE year(i.fecha) = 2000 GROUP BY i.hex_id""",
)
shared("l08_combined_surface", "SELECT hex_id, turno, round(avg(score), 6) AS score FROM (SELECT hex_id, turno, n * 1e0 / max(n) OVER (PARTITION BY tipo) AS score FROM (SELECT hex_id, turno, tipo, count(*) AS n FROM {incidents} WHERE year(fecha) = 2000 GROUP BY hex_id, turno, tipo) c) s GROUP BY hex_id, turno")

# --- dashboard ------------------------------------------------------------------------------------------------------
shared("c03_yearly_delta", "SELECT tipo, anio, n, n - lag(n) OVER (PARTITION BY tipo ORDER BY anio) AS delta FROM (SELECT tipo, year(fecha) AS anio, count(*) AS n FROM {incidents} GROUP BY 1, 2) t")
shared("c06_peaks", "SELECT tipo, hora, n, n < 1000 AS small FROM (SELECT tipo, hora, n, row_number() OVER (PARTITION BY tipo ORDER BY n DESC, hora) AS rn FROM (SELECT tipo, hora, count(*) AS n FROM {incidents_h} GROUP BY tipo, hora) h) r WHERE rn = 1")
shared("c08_nearest_k", "SELECT k FROM (SELECT p_size AS k, row_number() OVER (ORDER BY abs(p_size - 33), p_size) AS rn FROM {part}) r WHERE rn = 1")
shared("c09_ranking_in_comuna", "SELECT hex_id, comuna_id, rank() OVER (PARTITION BY comuna_id ORDER BY weight DESC, hex_id) AS place, round(weight / sum(weight) OVER (PARTITION BY comuna_id), 6) AS share FROM {cells}")
shared("c14_top_categories", "SELECT p_type, count(*) AS n FROM {part} GROUP BY p_type ORDER BY n DESC, p_type LIMIT 8")

# --- more of the inventory ------------------------------------------------------------------------------------------
shared("p02_column_subset", "SELECT s_suppkey, s_name, s_nationkey FROM {supplier}")
shared("p07_fill_from_other", "SELECT p_partkey, trim(coalesce(CASE WHEN p_size > 25 THEN p_name END, concat(p_brand, ' ', p_type))) AS name FROM {part}")
shared("p08_alias_replacement", "SELECT n_nationkey, CASE n_name WHEN 'NATION_0' THEN 'FIRST' WHEN 'NATION_1' THEN 'SECOND' ELSE n_name END AS name FROM {nation}")
shared(
    "p11_dialect_union",
    "SELECT 'order' AS kind, o_orderkey AS id, CAST(o_orderdate AS DATE) AS fecha, o_totalprice AS amount FROM {orders} WHERE o_orderstatus = 'P' UNION ALL SELECT 'event', event_id, CAST(ts AS DATE), value FROM {events} WHERE event_type = 'purchase'",
)
shared(
    "p16_derived_algebra",
    "SELECT zone, p65, p0_14, round(100e0 - p65 - p0_14, 6) AS p15_64, round((p65 + p0_14) / (100e0 - p65 - p0_14) * 100, 6) AS dependency FROM (SELECT c_nationkey AS zone, round(avg(CASE WHEN c_acctbal > 8000 THEN 100e0 ELSE 0e0 END), 6) AS p65, round(avg(CASE WHEN c_acctbal < 0 THEN 100e0 ELSE 0e0 END), 6) AS p0_14 FROM {customer} GROUP BY c_nationkey) t WHERE p65 + p0_14 < 100",
)
shared("j02_composite_join", "SELECT g.hex_id, g.turno, coalesce(n, 0) AS n FROM (SELECT c.hex_id, t.turno FROM {cells} c CROSS JOIN (SELECT DISTINCT turno FROM {incidents}) t) g LEFT JOIN (SELECT hex_id, turno, count(*) AS n FROM {incidents} WHERE tipo = 'A' AND year(fecha) = 2001 GROUP BY hex_id, turno) k ON k.hex_id = g.hex_id AND k.turno = g.turno")
shared("j06_station_flow", "SELECT c.comuna_id, i.hora, count(*) AS viajes, round(sum(i.value), 4) AS pasajeros FROM {incidents_h} i JOIN {cells} c ON c.hex_id = i.hex_id GROUP BY c.comuna_id, i.hora")
shared("j08_inner_of_aggregates", "SELECT a.zone, a.n AS homes, b.n AS offices FROM (SELECT c_nationkey AS zone, count(*) AS n FROM {customer} GROUP BY c_nationkey) a JOIN (SELECT s_nationkey AS zone, count(*) AS n FROM {supplier} GROUP BY s_nationkey) b ON a.zone = b.zone")
shared("j09_lookup_with_mean", "SELECT c.hex_id, round(coalesce(m.m, (SELECT avg(value) FROM {incidents_h})), 6) AS m FROM {cells} c LEFT JOIN (SELECT hex_id, avg(value) AS m FROM {incidents_h} WHERE hora < 2 GROUP BY hex_id) m ON m.hex_id = c.hex_id")
shared("j22_alias_sum", "SELECT coalesce(a.alias, n.n_name) AS name, sum(k.n) AS n FROM {nation} n JOIN (SELECT s_nationkey, count(*) AS n FROM {supplier} GROUP BY s_nationkey) k ON k.s_nationkey = n.n_nationkey LEFT JOIN (SELECT n_nationkey AS k, 'JOINED' AS alias FROM {nation} WHERE n_nationkey IN (3, 4, 5)) a ON a.k = n.n_nationkey GROUP BY 1")
shared("a19_victim_summary", "SELECT subtipo, count(*) AS facts, sum(CASE WHEN cantidad >= 40 THEN 1 ELSE 0 END) AS victims, sum(CASE WHEN cantidad >= 40 THEN 1 ELSE 0 END) = 0 AS none FROM {incidents} WHERE year(fecha) BETWEEN 1998 AND 2001 GROUP BY subtipo")
shared("a20_kpis", "SELECT year(fecha) AS anio, count(*) AS delitos, count(DISTINCT hex_id) AS cells, count(DISTINCT fecha) AS days, round(count(*) * 1e0 / count(DISTINCT fecha), 6) AS per_day FROM {incidents} GROUP BY 1")
shared("a31_zone_bundle", "SELECT r.r_name, n.n_name, count(c.c_custkey) AS people, round(avg(c.c_acctbal), 6) AS wealth FROM {region} r JOIN {nation} n ON n.n_regionkey = r.r_regionkey LEFT JOIN {customer} c ON c.c_nationkey = n.n_nationkey GROUP BY r.r_name, n.n_name")
shared("w06_ranking", "SELECT hex_id, rank() OVER (ORDER BY weight DESC) AS place, dense_rank() OVER (ORDER BY comuna_id) AS zone_place FROM {cells}")
shared("f09_month_truncation", "SELECT CAST(date_trunc('month', fecha) AS DATE) AS mes, count(*) AS n FROM {incidents} GROUP BY 1")
shared("f10_covered_days", "SELECT anio, sum(d) AS days FROM (SELECT year(m) AS anio, extract(DAY FROM last_day(m)) AS d FROM (SELECT DISTINCT CAST(date_trunc('month', fecha) AS DATE) AS m FROM {incidents}) x) y GROUP BY anio")
shared("c04_surface_fallback", "SELECT c.hex_id, coalesce(t.n, a.n, 0) AS score FROM {cells} c LEFT JOIN (SELECT hex_id, count(*) AS n FROM {incidents} WHERE tipo = 'R' AND turno = 'Noche' AND year(fecha) = 2001 GROUP BY hex_id) t ON t.hex_id = c.hex_id LEFT JOIN (SELECT hex_id, count(*) AS n FROM {incidents} GROUP BY hex_id) a ON a.hex_id = c.hex_id")
shared("l10_daily_from_shifts", "SELECT hex_id, fecha, sum(n) AS n FROM (SELECT hex_id, fecha, turno, count(*) AS n FROM {incidents} WHERE year(fecha) = 2001 GROUP BY hex_id, fecha, turno) s GROUP BY hex_id, fecha")
