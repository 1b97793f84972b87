"""The dense space-time panel: cell x period x shift, with lags, rolling sums, neighbours and calendar.

One code path for the daily and the weekly grain. Every dynamic feature of a row uses rows strictly before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import SHIFTS, week_start

#: Fixed values of each grain: lags and rolling windows in periods, and the rolling sum that neighbours share.
GRAINS = {"day": ((7, 30, 365), (7, 30), 30), "week": ((1, 4, 52), (4, 12), 4)}


def period_counts(incidents: DataFrame, grain: str = "day", tipo: str | None = None) -> DataFrame:
    """hex_id, period, turno, y: incidents counted; tipo restricts the type. Null keys are dropped."""
    x = incidents.where("hex_id IS NOT NULL AND fecha IS NOT NULL AND turno IS NOT NULL")
    if tipo is not None:
        x = x.where(F.col("tipo") == tipo)
    period = F.col("fecha") if grain == "day" else week_start(F.col("fecha"))
    return x.groupBy("hex_id", period.alias("period"), "turno").agg(F.count("*").alias("y"))


def dense_grid(cells: DataFrame, first: str, last: str, grain: str = "day") -> DataFrame:
    """hex_id, period, turno: all periods from first to last (dates) in each cell and shift; exploded, not joined."""
    step = "interval 1 day" if grain == "day" else "interval 7 days"
    a, b = (f"date '{x}'" if grain == "day" else f"to_date(date_trunc('week', date '{x}'))" for x in (first, last))
    shifts = F.array(*map(F.lit, SHIFTS))
    return cells.select("hex_id", F.explode(shifts).alias("turno")).select("hex_id", F.explode(F.expr(f"sequence({a}, {b}, {step})")).alias("period"), "turno")


def dense_panel(cells: DataFrame, counts: DataFrame, first: str, last: str, grain: str = "day") -> DataFrame:
    """The grid with y (0 where nothing was counted)."""
    return dense_grid(cells, first, last, grain).join(counts, ["hex_id", "period", "turno"], "left").fillna(0, ["y"])


def neighbour_counts(panel: DataFrame, counts: DataFrame, ring: DataFrame) -> DataFrame:
    """panel with n1 and n2: what was counted (counts: hex_id, period, turno, y; only where it is not 0) in rings 1 and 2."""
    near = counts.select(F.col("hex_id").alias("nbr"), "period", "turno", "y").join(ring, "nbr")
    near = near.groupBy("hex_id", "period", "turno").agg(*[F.sum(F.when(F.col("k") == k, F.col("y"))).alias(f"n{k}") for k in (1, 2)])
    return panel.join(near, ["hex_id", "period", "turno"], "left").fillna(0, ["n1", "n2"])


def lag_features(panel: DataFrame, grain: str = "day", by: Sequence[str] = ("hex_id", "turno")) -> DataFrame:
    """lag_n and roll_n columns over the dense panel, and nbr1 and nbr2 if it has n1 and n2; one exchange serves all of them.

    nbr1 and nbr2 are the sums of the neighbours' own rolling sums. A rolling sum is linear, so the neighbours' counts are
    added up first and rolled once; null in the first period, else 0 or more.
    """
    lags, rolls, shared = GRAINS[grain]
    w = Window.partitionBy(*by).orderBy("period")
    near = [F.sum(f"n{k}").over(w.rowsBetween(-shared, -1)).alias(f"nbr{k}") for k in (1, 2) if f"n{k}" in panel.columns]
    return panel.select(*[c for c in panel.columns if c not in ("n1", "n2")], *[F.lag("y", n).over(w).alias(f"lag_{n}") for n in lags], *[F.sum("y").over(w.rowsBetween(-n, -1)).alias(f"roll_{n}") for n in rolls], *near)


def calendar_features(panel: DataFrame, holidays: DataFrame, grain: str = "day") -> DataFrame:
    """dia_semana (Monday 0), mes, semana and es_feriado (weekly: whether the week has a holiday). holidays: (fecha)."""
    day = F.col("fecha") if grain == "day" else week_start(F.col("fecha"))
    marked = holidays.select(day.alias("period"), F.lit(True).alias("es_feriado")).distinct()
    out = panel.join(F.broadcast(marked), "period", "left")  # some dozens of days a year
    return out.select(*panel.columns, F.weekday("period").alias("dia_semana"), F.month("period").alias("mes"), F.weekofyear("period").alias("semana"), F.coalesce("es_feriado", F.lit(False)).alias("es_feriado"))


def split_by_year(df: DataFrame, date: str, train_to: int, val: int) -> DataFrame:
    """A column split: train (years up to train_to), val, test (later)."""
    return df.withColumn("split", F.when(F.year(date) <= train_to, "train").when(F.year(date) == val, "val").otherwise("test"))


def group_holdout(df: DataFrame, unit: str, percent: int = 20, seed: int = 42) -> DataFrame:
    """A column held: whole units drawn by a hash."""
    return df.withColumn("held", F.pmod(F.xxhash64(unit, F.lit(seed)), F.lit(100)) < percent)


def override(df: DataFrame, changes: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Counterfactual values: changes (hex_id, feature, value) replace the named features; others must not occur."""
    wide = changes.withColumn("ok", F.assert_true(F.col("feature").isin(*allowed), F.lit("feature not allowed"))).where("ok IS NULL")
    wide = wide.groupBy("hex_id").pivot("feature", list(allowed)).agg(F.max("value"))
    wide = wide.select("hex_id", *[F.col(f).alias(f"__{f}") for f in allowed])
    out = df.join(wide, "hex_id", "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in allowed else F.col(c) for c in df.columns])
