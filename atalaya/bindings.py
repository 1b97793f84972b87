"""The domain tables, derived from the driver's tables by arithmetic that any SQL engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalars import SHIFTS
from .operators.grid import ring_table

#: Circumradius of a grid cell in metres.
CELL_SIZE = 443.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """hex_id, axial q and r, plane x and y, comuna_id, barrio_id, weight: one row for each supplier."""
    s = table(spark, d, "supplier")
    wide = s.agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("w"))
    s = s.join(F.broadcast(wide), how="cross")  # one row
    s = s.withColumn("q", F.col("s_suppkey") % F.col("w")).withColumn("r", F.expr("s_suppkey div w"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    s = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)  # 25 nations
    return s.select(
        F.col("s_suppkey").alias("hex_id"), "q", "r", (CELL_SIZE * F.sqrt(F.lit(3.0)) * (F.col("q") + F.col("r") / 2)).alias("x"), (CELL_SIZE * 1.5 * F.col("r")).alias("y"),
        F.col("s_nationkey").alias("comuna_id"), F.col("n_name").alias("barrio_id"), (F.col("s_acctbal") + 1000).alias("weight"),
    )


def incidents(spark: SparkSession, d: str) -> DataFrame:
    """fecha, hex_id, turno, tipo, subtipo, cantidad."""
    turno = F.element_at(F.array(*map(F.lit, SHIFTS)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return table(spark, d, "lineitem").select(
        F.to_date("l_shipdate").alias("fecha"), F.col("l_suppkey").alias("hex_id"), turno.alias("turno"), F.col("l_returnflag").alias("tipo"),
        F.concat("l_returnflag", "l_linestatus").alias("subtipo"), F.col("l_quantity").alias("cantidad"),
    )


def incidents_h(spark: SparkSession, d: str) -> DataFrame:
    """ts, fecha, hora, user_id, hex_id, tipo, value: the short hourly stream."""
    n = table(spark, d, "supplier").agg(F.count("*").alias("n_cells"))
    return table(spark, d, "events").join(F.broadcast(n), how="cross").select(
        "ts", F.to_date("ts").alias("fecha"), F.hour("ts").alias("hora"), "user_id", (F.col("user_id") % F.col("n_cells") + 1).alias("hex_id"), F.col("event_type").alias("tipo"), "value",
    )


def monthly(spark: SparkSession, d: str, by_type: bool = False) -> DataFrame:
    """(tipo,) ds, y: orders by month."""
    keys = [F.trunc("o_orderdate", "month").alias("ds")]
    if by_type:
        keys.insert(0, F.col("o_orderpriority").alias("tipo"))
    return table(spark, d, "orders").groupBy(*keys).agg(F.count("*").cast("double").alias("y"))


def pois(spark: SparkSession, d: str) -> DataFrame:
    """poi_id, clase, x, y: points strewn over the plane."""
    edge = cells(spark, d).agg((F.floor(F.max("x")) + 1).alias("mx"), (F.floor(F.max("y")) + 1).alias("my"))
    p = table(spark, d, "part").join(F.broadcast(edge), how="cross")  # one row
    return p.select(F.col("p_partkey").alias("poi_id"), F.col("p_type").alias("clase"), (F.col("p_partkey") * 97 % F.col("mx")).alias("x"), (F.col("p_partkey") * 61 % F.col("my")).alias("y"))


def ring(spark: SparkSession, d: str, radius: int = 2) -> DataFrame:
    """hex_id, nbr, k: neighbours at grid distance k."""
    return ring_table(cells(spark, d), radius)


def roads(spark: SparkSession, d: str) -> DataFrame:
    """u, v, length_m, clase: directed edges between neighbouring cells."""
    e = ring(spark, d, 1).select(F.col("hex_id").alias("u"), F.col("nbr").alias("v"))
    return e.select("u", "v", (300 + (F.col("u") * 37 + F.col("v") * 11) % 400).cast("double").alias("length_m"), ((F.col("u") + F.col("v")) % 5).alias("clase"))
