"""Monthly forecasts: seasonal naive by windows, Holt-Winters and a regime regression for each series and origin."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Horizon, shortest history, width of the bands.
HORIZON, MIN_HISTORY, Z = 12, 36, 1.645


def seasonal_naive(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by,) ds, yhat, low, high: last year's month, with bands from the spread of year-on-year changes (12 ahead)."""
    w = Window.partitionBy(*by).orderBy("ds")
    x = series.withColumn("diff", F.col("y") - F.lag("y", 12).over(w))
    x = x.select(*by, "ds", "y", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ds"))).alias("back"), F.stddev_samp("diff").over(Window.partitionBy(*by)).alias("sd"))
    return x.where(F.col("back") <= HORIZON).select(*by, F.add_months("ds", 12).alias("ds"), F.col("y").alias("yhat"), (F.col("y") - Z * F.col("sd")).alias("low"), (F.col("y") + Z * F.col("sd")).alias("high"))


def backtest_naive(series: DataFrame, origins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by,) origin, h, real, pred: rolling origins at the last months, horizons 1 to HORIZON, seasonal naive."""
    last = Window.partitionBy(*by).orderBy(F.desc("ds"))
    ends = series.select(*by, F.col("ds").alias("origin"), F.row_number().over(last).alias("back")).where(F.col("back").between(2, origins + 1)).drop("back")
    grid = ends.select("*", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))).alias("h"))
    grid = grid.withColumn("ds", F.add_months("origin", F.col("h"))).withColumn("src", F.add_months("origin", F.col("h") - 12))
    real = series.select(*by, "ds", F.col("y").alias("real"))
    pred = series.select(*by, F.col("ds").alias("src"), F.col("y").alias("pred"))
    return grid.join(real, [*by, "ds"]).join(pred, [*by, "src"]).select(*by, "origin", "h", "real", "pred")


def holt_winters(y: np.ndarray, steps: int, period: int = 12) -> np.ndarray:
    """Additive level, trend and season; smoothing chosen on a small grid by squared one-step errors."""
    best, out = np.inf, np.full(steps, y[-1] if len(y) else np.nan)
    if len(y) < 2 * period:
        return out
    for alpha in (0.1, 0.3, 0.5, 0.8):
        for beta in (0.0, 0.05, 0.2):
            for gamma in (0.05, 0.2, 0.5):
                level, trend = y[:period].mean(), (y[period : 2 * period].mean() - y[:period].mean()) / period
                season, sse = list(y[:period] - level), 0.0
                for t in range(period, len(y)):
                    sse += (y[t] - level - trend - season[t - period]) ** 2
                    new = alpha * (y[t] - season[t - period]) + (1 - alpha) * (level + trend)
                    trend = beta * (new - level) + (1 - beta) * trend
                    level = new
                    season.append(gamma * (y[t] - level) + (1 - gamma) * season[t - period])
                if sse < best:
                    best, out = sse, np.array([level + (h + 1) * trend + season[len(y) - period + h % period] for h in range(steps)])
    return out


def regime_regression(months: np.ndarray, y: np.ndarray, steps: int, regimes: Sequence[tuple[int, int | None]] = ()) -> np.ndarray:
    """Log-linear trend, two yearly harmonics and regime indicators by least squares; months count from any start.

    Only regimes that began by the last month are seen; one still open there goes on.
    """
    last, ahead = months[-1], months[-1] + 1 + np.arange(steps)

    def design(m: np.ndarray) -> np.ndarray:
        cols = [np.ones(len(m)), m / 12.0] + [f(2 * np.pi * k * m / 12) for k in (1, 2) for f in (np.sin, np.cos)]
        cols += [(m >= a) & ((m <= b) if b is not None and b <= last else True) for a, b in regimes if a <= last]
        return np.column_stack([np.asarray(c, float) for c in cols])

    x = design(months)
    beta = np.linalg.solve(x.T @ x + 1e-6 * np.eye(x.shape[1]), x.T @ np.log1p(y))
    return np.expm1(design(ahead) @ beta)


def backtest_models(series: DataFrame, key: str, origins: int, regimes: Sequence[tuple[int, int | None]] = ()) -> DataFrame:
    """key, origin, model, h, real, pred: each series and origin is a group of its own (a few hundred months)."""
    last = Window.partitionBy(key).orderBy(F.desc("ds"))
    known = F.row_number().over(Window.partitionBy(key).orderBy("ds"))
    ends = series.select(key, F.col("ds").alias("origin"), F.row_number().over(last).alias("back"), known.alias("known"))
    ends = ends.where(F.col("back").between(2, origins + 1) & (F.col("known") >= MIN_HISTORY)).select(key, "origin")
    every = ends.join(series, key)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        origin = pdf["origin"].iloc[0]
        past, after = pdf[pdf["ds"] <= origin], pdf[pdf["ds"] > origin].head(HORIZON)
        months = np.array([d.year * 12 + d.month for d in pd.to_datetime(past["ds"])], float)
        y = past["y"].to_numpy(float)
        parts = []
        for model, yhat in (("holt_winters", holt_winters(y, len(after))), ("regime", regime_regression(months, y, len(after), regimes))):
            parts.append(pd.DataFrame({key: pdf[key].iloc[0], "origin": origin, "model": model, "h": np.arange(1, len(after) + 1), "real": after["y"].to_numpy(float), "pred": yhat}))
        return pd.concat(parts)

    kind = dict(series.dtypes)[key]
    return every.groupBy(key, "origin").applyInPandas(fit, f"{key} {kind}, origin date, model string, h int, real double, pred double")


def error_bands(backtest: DataFrame, width: float = 0.9, by: Sequence[str] = ()) -> DataFrame:
    """(by,) h, q_low, q_high: empirical quantiles of pred - real by horizon."""
    a = (1 - width) / 2
    e = backtest.withColumn("e", F.col("pred") - F.col("real"))
    return e.groupBy(*by, "h").agg(F.percentile("e", a).alias("q_low"), F.percentile("e", 1 - a).alias("q_high"))
