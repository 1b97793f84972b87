"""Where queries register themselves, with the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) -> DataFrame; oracle is SQL over the views CELLS etc. of BINDINGS_SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = f"WITH RECURSIVE {BINDINGS_SQL}{oracle.strip()}" if oracle.strip().startswith(",") else f"WITH RECURSIVE {BINDINGS_SQL} {oracle.strip()}"
        return f

    return add


#: The domain tables in DuckDB SQL, as in bindings.py.
BINDINGS_SQL = """
wide AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM supplier),
cells AS (
  SELECT s_suppkey AS hex_id, s_suppkey % w AS q, s_suppkey // w AS r, 443 * sqrt(3.0) * ((s_suppkey % w) + (s_suppkey // w) / 2.0) AS x,
         443 * 1.5 * (s_suppkey // w) AS y, s_nationkey AS comuna_id, n_name AS barrio_id, s_acctbal + 1000 AS weight
  FROM supplier JOIN nation ON n_nationkey = s_nationkey, wide),
incidents AS (
  SELECT CAST(l_shipdate AS DATE) AS fecha, l_suppkey AS hex_id, ['Mañana', 'Tarde', 'Noche', 'Madrugada'][l_linenumber % 4 + 1] AS turno,
         l_returnflag AS tipo, l_returnflag || l_linestatus AS subtipo, l_quantity AS cantidad FROM lineitem),
incidents_h AS (
  SELECT ts, CAST(ts AS DATE) AS fecha, CAST(hour(ts) AS INT) AS hora, user_id, user_id % (SELECT count(*) FROM supplier) + 1 AS hex_id, event_type AS tipo, value FROM events),
monthly AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY 1),
monthly_type AS (SELECT o_orderpriority AS tipo, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y FROM orders GROUP BY 1, 2),
pois AS (
  SELECT p_partkey AS poi_id, p_type AS clase, (p_partkey * 97) % mx AS x, (p_partkey * 61) % my AS y
  FROM part, (SELECT CAST(floor(max(x)) AS BIGINT) + 1 AS mx, CAST(floor(max(y)) AS BIGINT) + 1 AS my FROM cells) e),
offsets(k, dq, dr) AS (
  SELECT (abs(dq) + abs(dr) + abs(dq + dr)) // 2, dq, dr FROM (SELECT unnest(range(-2, 3)) AS dq) a, (SELECT unnest(range(-2, 3)) AS dr) b
  WHERE (abs(dq) + abs(dr) + abs(dq + dr)) // 2 BETWEEN 1 AND 2),
ring AS (SELECT c.hex_id, n.hex_id AS nbr, k FROM cells c, offsets o JOIN cells n ON n.q = c.q + dq AND n.r = c.r + dr),
roads AS (SELECT hex_id AS u, nbr AS v, CAST(300 + (hex_id * 37 + nbr * 11) % 400 AS DOUBLE) AS length_m, (hex_id + nbr) % 5 AS clase FROM ring WHERE k = 1)
"""
