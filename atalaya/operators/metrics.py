"""Prediction quality: errors, hotspot recall, PAI and PEI, calibration, coverage, conformal corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import share_top


def error_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, mae, rmse, bias (mean of pred - real), level (sum of pred over sum of real) of columns real and pred."""
    gap = F.col("pred") - F.col("real")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(gap).alias("bias"), (F.sum("pred") / F.sum("real")).alias("level")
    )


def hotspots(df: DataFrame, shares: Sequence[float], unit: str = "hex_id", by: Sequence[str] = ()) -> DataFrame:
    """k, top_n, recall, pai, pei for units with columns real and pred, each unit once in each group of `by`.

    Both rankings (by prediction, and by hindsight) run as one window each; ties go to the lower unit id. PAI divides by
    the nominal share, PEI by the PAI of hindsight.
    """
    group = Window.partitionBy(*by)
    ranked = df.select(
        *by, "real", F.row_number().over(group.orderBy(F.desc("pred"), unit)).alias("rp"), F.row_number().over(group.orderBy(F.desc("real"), unit)).alias("rr"), F.count("*").over(group).alias("n")
    )
    cuts = ranked.select("*", F.explode(F.array(*map(F.lit, shares))).alias("k"))
    cuts = cuts.withColumn("top_n", F.greatest(F.lit(1), F.bround(F.col("n") * F.col("k")).cast("int")))
    out = cuts.groupBy(*by, "k", "top_n").agg(F.sum("real").alias("all"), F.sum(F.when(F.col("rp") <= F.col("top_n"), F.col("real")).otherwise(0)).alias("hit"), F.sum(F.when(F.col("rr") <= F.col("top_n"), F.col("real")).otherwise(0)).alias("best"))
    recall = F.try_divide("hit", "all")
    return out.select(*by, "k", "top_n", recall.alias("recall"), (recall / F.col("k")).alias("pai"), F.try_divide("hit", "best").alias("pei"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_pred, mean_real by quantile edges of pred (linear interpolation); equal edges fall together."""
    edges = df.agg(F.percentile("pred", [i / bins for i in range(bins + 1)]).alias("e"))
    placed = df.join(F.broadcast(edges), how="cross")  # one row
    bin_of = F.aggregate(F.slice("e", 2, bins - 1), F.lit(0), lambda a, x: a + F.when(F.col("pred") > x, 1).otherwise(0))
    return placed.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), F.avg("pred").alias("mean_pred"), F.avg("real").alias("mean_real"))


def interval_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, coverage, width, crossings of intervals low..high around mid for real."""
    inside = (F.col("real") >= F.col("low")) & (F.col("real") <= F.col("high"))
    crossed = (F.col("low") > F.col("mid")) | (F.col("mid") > F.col("high"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("high") - F.col("low")).alias("width"), F.avg(crossed.cast("double")).alias("crossings"))


def higher_quantile(df: DataFrame, score: str, level: float, by: Sequence[str] = ()) -> DataFrame:
    """The finite-sample conformal quantile: order statistic at index ceil((n - 1) min(1, ceil((n + 1) level) / n)).

    Equal scores are counted first, so the windows run over distinct values, not rows.
    """
    group = Window.partitionBy(*by)
    levels = df.groupBy(*by, score).agg(F.count("*").alias("__c"))
    ranked = levels.select(*by, score, "__c", F.sum("__c").over(group.orderBy(score)).alias("__upto"), F.sum("__c").over(group).alias("n"))
    at = F.ceil(F.round((F.col("n") - 1) * F.least(F.lit(1.0), F.ceil(F.round((F.col("n") + 1) * level, 9)) / F.col("n")), 9))
    return ranked.where((F.col("__upto") > at) & (F.col("__upto") - F.col("__c") <= at)).select(*by, "n", F.col(score).alias("q"))


def poisson_nll(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean Poisson negative log likelihood of real under pred, without the factorial term."""
    lam = F.greatest("pred", F.lit(1e-9))
    return df.groupBy(*by).agg(F.avg(lam - F.col("real") * F.log(lam)).alias("nll"))


def lorenz(df: DataFrame, count: str, unit: str) -> DataFrame:
    """n, share_zero, share_for_25, share_for_50, mass_top_1, mass_top_5 of units with their counts (zeros included)."""
    # Units of equal count are alike, so a cumulative sum over distinct counts, not over units, is enough.
    levels = df.groupBy(F.col(count).cast("double").alias("c")).agg(F.count(unit).alias("m"))
    down = Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    curve = levels.select("c", "m", F.sum("m").over(down).alias("units"), F.sum(F.col("c") * F.col("m")).over(down).alias("mass"))
    total = df.agg(F.count("*").alias("n"), F.sum(F.col(count).cast("double")).alias("total"), F.avg((F.col(count) == 0).cast("double")).alias("share_zero"))
    x = curve.join(F.broadcast(total), how="cross")  # one row
    before_units, before_mass = F.col("units") - F.col("m"), F.col("mass") - F.col("c") * F.col("m")

    def units_for(t: float):  # the first unit at which the cumulated share reaches t
        need = F.ceil(F.round(F.try_divide(t * F.col("total") - before_mass, F.col("c")), 9))
        return F.min(F.when(F.col("mass") >= t * F.col("total") - 1e-9, before_units + F.greatest(F.lit(1), need)))

    def mass_in(k: float):
        top = share_top(F.col("n"), k)
        return F.max(F.when((top > before_units) & (top <= F.col("units")), (before_mass + F.col("c") * (top - before_units)) / F.col("total")))

    return x.groupBy("n", "share_zero", "total").agg(units_for(0.25).alias("u25"), units_for(0.5).alias("u50"), mass_in(0.01).alias("mass_top_1"), mass_in(0.05).alias("mass_top_5")).select(
        "n", "share_zero", (F.col("u25") / F.col("n")).alias("share_for_25"), (F.col("u50") / F.col("n")).alias("share_for_50"), "mass_top_1", "mass_top_5"
    )
