"""Export documents: JSON records, GeoJSON features, profiles, classes for maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_records(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """One JSON object a row, in a column json, ordered; a text sink of it is a JSON-lines file."""
    return df.orderBy(*order).select(*order, F.to_json(F.struct(*df.columns)).alias("json"))


def polygon_feature(ring: Column, properties: Mapping[str, Column], digits: int = 6) -> Column:
    """A GeoJSON polygon feature as text: the ring closed, coordinates rounded."""
    point = lambda p: F.array(F.round(p["x"], digits), F.round(p["y"], digits))
    closed = F.concat(F.transform(ring, point), F.transform(F.slice(ring, 1, 1), point))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c.alias(k) for k, c in properties.items()]).alias("properties")))


def point_feature(x: Column, y: Column, properties: Mapping[str, Column], digits: int = 6) -> Column:
    """A GeoJSON point feature as text."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.round(x, digits), F.round(y, digits)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c.alias(k) for k, c in properties.items()]).alias("properties")))


def profile(df: DataFrame, group: str, bucket: str, domain: Sequence) -> DataFrame:
    """group, profile: counts by bucket over a fixed domain, zero-filled, in the domain's order."""
    counts = [F.count_if(F.col(bucket) == v) for v in domain]
    return df.groupBy(group).agg(F.array(*counts).alias("profile"))


def quantile_classes(df: DataFrame, value: str, classes: int) -> DataFrame:
    """df with klass 0 to classes - 1 by quantile cuts with linear interpolation; nulls have none."""
    cuts = df.agg(F.percentile(value, [i / classes for i in range(1, classes)]).alias("__cuts"))
    placed = df.join(F.broadcast(cuts), how="cross")  # one row
    above = F.aggregate("__cuts", F.lit(0), lambda n, c: n + F.when(F.col(value) > c, 1).otherwise(0))
    return placed.withColumn("klass", F.when(F.col(value).isNotNull(), above)).drop("__cuts")


def rank_bins(df: DataFrame, value: str, tie: str, bins: int) -> DataFrame:
    """df with bin 0 to bins - 1: quantile edges on first-come ranks, so 10 rows in 4 bins are 3, 2, 2, 3."""
    ranked = df.withColumn("__i", F.row_number().over(Window.orderBy(value, tie))).withColumn("__n", F.count("*").over(Window.partitionBy()))
    bin_of = sum([F.when(F.col("__i") > 1 + (F.col("__n") - 1) * (k / bins), 1).otherwise(0) for k in range(1, bins)], F.lit(0))
    return ranked.withColumn("bin", bin_of).drop("__i", "__n")


def sorted_table(df: DataFrame, by: str, tie: str, descending: bool = True) -> DataFrame:
    """df with position: rows ordered by any column, nulls last as if they were -1, ties by name."""
    value = F.coalesce(F.col(by), F.lit(-1.0))
    return df.withColumn("position", F.row_number().over(Window.orderBy(F.desc(value) if descending else F.asc(value), tie)).cast("long"))


def zone_totals(zones: DataFrame, incidents: DataFrame, zone: str) -> DataFrame:
    """zone, people, n, rate: incidents counted by zone, and the zone's people taken once."""
    n = incidents.groupBy(zone).agg(F.count("*").alias("n"))
    return zones.join(n, zone, "left").select(zone, "people", F.coalesce("n", F.lit(0)).alias("n")).withColumn("rate", F.when(F.col("people") > 0, F.col("n") * 100000.0 / F.col("people")))


def url_choice(url: Column, key: str, valid: Sequence[str], default: str) -> Column:
    """A parameter of a URL if it is one of the valid values, else the default."""
    value = F.regexp_extract(F.coalesce(url, F.lit("")), rf"[?&]{key}=([^&#]*)", 1)
    return F.when(value.isin(*valid), value).otherwise(default)


def url_number(url: Column, key: str, default: int) -> Column:
    """A whole number from a URL's parameter, else the default."""
    value = F.regexp_extract(F.coalesce(url, F.lit("")), rf"[?&]{key}=([0-9]+)(?:[&#]|$)", 1)
    return F.coalesce(value.try_cast("long"), F.lit(default).cast("long"))


def draw_unit(df: DataFrame, fields: Mapping[str, str], fine: str, coarse: str) -> DataFrame:
    """surface, unit, id, value: each surface at the finest unit its data has; fields names the unit of each. Nulls are left out."""
    out = None
    for field, unit in fields.items():
        key = fine if unit == "fine" else coarse
        x = df.groupBy(F.col(key).cast("string").alias("id")).agg(F.avg(field).alias("value")).where("value IS NOT NULL").select(F.lit(field).alias("surface"), F.lit(unit).alias("unit"), "id", "value")
        out = x if out is None else out.unionAll(x)
    return out
