"""Queries of the panel, the metrics, the grid and the spatial statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import bindings as b
from ..functions.scalars import SHIFTS, fold_name, hour_of, one_every, rate_per_100k, regional_number, shift_of, tokens
from ..operators import grid, hawkes, metrics, models, panel, series, statistics
from ..operators.tables import cut, stored
from .registry import query

#: Shares of units called hot, and the decays in days that the fit tries.
SHARES = (0.05, 0.1, 0.2, 0.3)
TAUS = (0.5, 1, 2, 3, 5, 7, 14, 30, 60, 90, 180, 365)
_SHIFT_ROWS = "(VALUES ('Mañana'), ('Tarde'), ('Noche'), ('Madrugada')) s(turno)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All doubles rounded: sums of floats differ by their order."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- the flagship: does last period's map predict this one's? -------------------------------------------------------

_BASELINE = f"""
, mean AS (SELECT hex_id, turno, count(*) * 1e0 / (SELECT count(DISTINCT fecha) FROM incidents WHERE year(fecha) <= 1999) AS m FROM incidents WHERE year(fecha) <= 1999 GROUP BY 1, 2),
test AS (SELECT hex_id, turno, count(*) AS n FROM incidents WHERE year(fecha) = 2000 GROUP BY 1, 2),
scored AS (
  SELECT c.hex_id, c.comuna_id, s.turno, coalesce(t.n, 0) AS real, round(coalesce(m.m, (SELECT avg(m) FROM mean)) * (SELECT count(DISTINCT fecha) FROM incidents WHERE year(fecha) = 2000), 6) AS pred
  FROM cells c CROSS JOIN {_SHIFT_ROWS} LEFT JOIN mean m ON m.hex_id = c.hex_id AND m.turno = s.turno LEFT JOIN test t ON t.hex_id = c.hex_id AND t.turno = s.turno),
u AS (SELECT hex_id, sum(real) AS real, round(sum(pred), 6) AS pred FROM scored GROUP BY hex_id)
"""
_HOTSPOTS = """
, ranked AS (SELECT *, row_number() OVER (ORDER BY pred DESC, hex_id) AS rp, row_number() OVER (ORDER BY real DESC, hex_id) AS rr, count(*) OVER () AS n FROM u),
cuts AS (SELECT *, greatest(1, CAST(round_even(n * k, 0) AS INT)) AS top_n FROM ranked, (VALUES (0.05e0), (0.1e0), (0.2e0), (0.3e0)) ks(k)),
hot AS (SELECT k, top_n, sum(CASE WHEN rp <= top_n THEN real ELSE 0 END) * 1e0 / sum(real) AS recall, sum(CASE WHEN rp <= top_n THEN real ELSE 0 END) * 1e0 / sum(CASE WHEN rr <= top_n THEN real ELSE 0 END) AS pei FROM cuts GROUP BY k, top_n)
"""


def baseline_scores(spark: SparkSession, d: str) -> DataFrame:
    """hex_id, comuna_id, turno, real (2000), pred: the daily mean to 1999 by cell and shift times the days of 2000.

    Dense over cells and shifts; cells without history take the mean of means.
    """
    x = b.incidents(spark, d).select("hex_id", "turno", "fecha", F.year("fecha").alias("y")).where("y <= 2000")
    # One pass counts both periods; null where a cell and shift has none.
    counts = x.groupBy("hex_id", "turno").agg(F.sum(F.when(F.col("y") <= 1999, 1)).alias("c"), F.sum(F.when(F.col("y") == 2000, 1)).alias("n"))
    days = x.agg(F.count_distinct(F.when(F.col("y") <= 1999, F.col("fecha"))).alias("days"), F.count_distinct(F.when(F.col("y") == 2000, F.col("fecha"))).alias("d"))
    one = days.join(counts.agg(F.avg("c").alias("g")), how="cross")  # one row each
    dense = b.cells(spark, d).select("hex_id", "comuna_id", F.explode(F.array(*map(F.lit, SHIFTS))).alias("turno"))
    out = dense.join(counts, ["hex_id", "turno"], "left").join(F.broadcast(one), how="cross")
    return out.select("hex_id", "comuna_id", "turno", F.coalesce("n", F.lit(0)).alias("real"), F.round(F.coalesce("c", "g") / F.col("days") * F.col("d"), 6).alias("pred"))


@query("flagship_hotspots", _BASELINE + _HOTSPOTS + "SELECT h.k, top_n, round(recall, 6) AS recall, round(recall / h.k, 6) AS pai, round(pei, 6) AS pei, round((SELECT avg(abs(pred - real)) FROM scored), 6) AS mae, round((SELECT sum(pred) / sum(real) FROM scored), 6) AS level FROM hot h")
def flagship_hotspots(spark: SparkSession, d: str) -> DataFrame:
    scored = cut(baseline_scores(spark, d))
    cells = scored.groupBy("hex_id").agg(F.sum("real").alias("real"), F.round(F.sum("pred"), 6).alias("pred"))
    errors = metrics.error_summary(scored).select("mae", "level")
    return rounded(metrics.hotspots(cells, SHARES).join(F.broadcast(errors), how="cross"))  # one row


@query("e01_errors", _BASELINE + "SELECT turno, count(*) AS n, round(avg(abs(pred - real)), 6) AS mae, round(sqrt(avg((pred - real) * (pred - real))), 6) AS rmse, round(avg(pred - real), 6) AS bias, round(sum(pred) / sum(real), 6) AS level FROM scored GROUP BY turno")
def e01_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.error_summary(baseline_scores(spark, d), ["turno"]))


@query("e07_poisson_nll", _BASELINE + "SELECT turno, round(avg(greatest(pred, 1e-9) - real * ln(greatest(pred, 1e-9))), 6) AS nll FROM scored GROUP BY turno")
def e07_poisson_nll(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.poisson_nll(baseline_scores(spark, d), ["turno"]))


@query(
    "a25_calibration",
    _BASELINE
    + """, edges AS (SELECT quantile_cont(pred, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM scored),
    placed AS (SELECT CAST(len(list_filter(e, lambda x: pred > x)) AS INT) AS bin, pred, real FROM scored, edges) SELECT bin, count(*) AS n, round(avg(pred), 6) AS mean_pred, round(avg(real), 6) AS mean_real FROM placed GROUP BY bin""",
)
def a25_calibration(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.calibration(baseline_scores(spark, d)))


_LORENZ = """, u AS (SELECT c.hex_id, coalesce(n, 0) AS n FROM cells c LEFT JOIN (SELECT hex_id, count(*) AS n FROM incidents_h GROUP BY 1) i ON i.hex_id = c.hex_id),
o AS (SELECT n, row_number() OVER (ORDER BY n DESC, hex_id) AS i, sum(n) OVER (ORDER BY n DESC, hex_id ROWS UNBOUNDED PRECEDING) * 1e0 / sum(n) OVER () AS cum, count(*) OVER () AS m FROM u)
SELECT any_value(m) AS n, round(avg(CASE WHEN n = 0 THEN 1e0 ELSE 0e0 END), 6) AS share_zero, round(min(CASE WHEN cum >= 0.25 - 1e-12 THEN i END) * 1e0 / any_value(m), 6) AS share_for_25, round(min(CASE WHEN cum >= 0.5 - 1e-12 THEN i END) * 1e0 / any_value(m), 6) AS share_for_50,
  round(max(CASE WHEN i = greatest(1, CAST(round_even(m * 0.01, 0) AS INT)) THEN cum END), 6) AS mass_top_1, round(max(CASE WHEN i = greatest(1, CAST(round_even(m * 0.05, 0) AS INT)) THEN cum END), 6) AS mass_top_5 FROM o"""


@query("a27_lorenz", _LORENZ)
def a27_lorenz(spark: SparkSession, d: str) -> DataFrame:
    n = b.incidents_h(spark, d).groupBy("hex_id").agg(F.count("*").alias("n"))
    return rounded(metrics.lorenz(b.cells(spark, d).select("hex_id").join(n, "hex_id", "left").fillna(0), "n", "hex_id"))


# --- the panel ------------------------------------------------------------------------------------------------------


def _panel_sql(grain: str) -> str:
    lags, rolls, shared = panel.GRAINS[grain]
    step = "7 days" if grain == "week" else "1 day"
    period = "CAST(date_trunc('week', fecha) AS DATE)" if grain == "week" else "fecha"
    cols = ", ".join([f"lag(y, {n}) OVER w AS lag_{n}" for n in lags] + [f"CAST(sum(y) OVER (PARTITION BY hex_id, turno ORDER BY period ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS BIGINT) AS roll_{n}" for n in rolls])
    return f"""
, counts AS (SELECT hex_id, {period} AS period, turno, count(*) AS n FROM incidents GROUP BY 1, 2, 3),
periods AS (SELECT CAST(unnest(generate_series((SELECT CAST(min(period) AS TIMESTAMP) FROM counts), (SELECT CAST(max(period) AS TIMESTAMP) FROM counts), INTERVAL {step})) AS DATE) AS period),
dense AS (SELECT c.hex_id, p.period, s.turno, coalesce(n, 0) AS y FROM cells c CROSS JOIN periods p CROSS JOIN {_SHIFT_ROWS} LEFT JOIN counts k ON k.hex_id = c.hex_id AND k.period = p.period AND k.turno = s.turno),
featured AS (SELECT *, {cols} FROM dense WINDOW w AS (PARTITION BY hex_id, turno ORDER BY period)),
sums AS (SELECT g.hex_id, f.period, f.turno, CAST(sum(CASE WHEN k = 1 THEN f.roll_{shared} END) AS BIGINT) AS s1, CAST(sum(CASE WHEN k = 2 THEN f.roll_{shared} END) AS BIGINT) AS s2 FROM ring g JOIN featured f ON f.hex_id = g.nbr GROUP BY 1, 2, 3)
"""


def dense(spark: SparkSession, d: str, grain: str, tipo: str | None = None, near: bool = False) -> DataFrame:
    """The panel over all dates of the incidents; near adds the neighbours' counts."""
    x = b.incidents(spark, d)
    first, last = x.agg(F.min("fecha"), F.max("fecha")).first()
    counts = panel.period_counts(x, grain, tipo)
    out = panel.dense_panel(b.cells(spark, d), counts, str(first), str(last), grain)
    return panel.neighbour_counts(out, counts, b.ring(spark, d)) if near else out


_NEIGHBOURS = """SELECT f.*, CASE WHEN f.period > (SELECT min(period) FROM periods) THEN coalesce(s1, 0) END AS nbr1, CASE WHEN f.period > (SELECT min(period) FROM periods) THEN coalesce(s2, 0) END AS nbr2
FROM featured f LEFT JOIN sums s ON s.hex_id = f.hex_id AND s.period = f.period AND s.turno = f.turno"""


#: The neighbours' counts are added up before they are rolled; w01's SQL rolls them first.
_LINEAR = """, near AS (SELECT g.hex_id, k.period, k.turno, sum(CASE WHEN g.k = 1 THEN n ELSE 0 END) AS n1, sum(CASE WHEN g.k = 2 THEN n ELSE 0 END) AS n2 FROM ring g JOIN counts k ON k.hex_id = g.nbr GROUP BY 1, 2, 3)
SELECT f.*, CAST(sum(coalesce(n1, 0)) OVER r AS BIGINT) AS nbr1, CAST(sum(coalesce(n2, 0)) OVER r AS BIGINT) AS nbr2 FROM featured f LEFT JOIN near s ON s.hex_id = f.hex_id AND s.period = f.period AND s.turno = f.turno
WINDOW r AS (PARTITION BY f.hex_id, f.turno ORDER BY f.period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)"""


@query("w03_weekly_panel", _panel_sql("week") + _LINEAR)
def w03_weekly_panel(spark: SparkSession, d: str) -> DataFrame:
    return panel.lag_features(dense(spark, d, "week", near=True), "week")


@query("w01_daily_panel", _panel_sql("day") + ", whole AS (" + _NEIGHBOURS + ") SELECT hex_id, turno, count(*) AS rows_n, sum(y) AS y, sum(lag_7) AS lag_7, sum(lag_30) AS lag_30, sum(lag_365) AS lag_365, sum(roll_7) AS roll_7, sum(roll_30) AS roll_30, sum(nbr1) AS nbr1, sum(nbr2) AS nbr2 FROM whole GROUP BY 1, 2")
def w01_daily_panel(spark: SparkSession, d: str) -> DataFrame:
    """Column sums of the daily panel (its rows are checked at the weekly grain)."""
    return series.feature_sums(b.cells(spark, d), b.incidents(spark, d), b.ring(spark, d), "day").select("hex_id", "turno", "rows_n", "y", "lag_7", "lag_30", "lag_365", "roll_7", "roll_30", "nbr1", "nbr2")


@query("f08_calendar_panel", _panel_sql("week") + "SELECT hex_id, turno, period, y, CAST((dayofweek(period) + 6) % 7 AS INT) AS dia_semana, CAST(month(period) AS INT) AS mes, CAST(weekofyear(period) AS INT) AS semana, strftime(period, '%Y-%m-%d') IN ('1999-12-20', '2000-12-25', '1999-05-24') AS es_feriado FROM dense")
def f08_calendar_panel(spark: SparkSession, d: str) -> DataFrame:
    holidays = spark.createDataFrame([("1999-12-25",), ("2000-12-25",), ("1999-05-25",)], "fecha string").select(F.to_date("fecha").alias("fecha"))
    return panel.calendar_features(dense(spark, d, "week"), holidays, "week")


@query("a01_weekly_by_type", "SELECT hex_id, CAST(date_trunc('week', fecha) AS DATE) AS period, turno, count(*) AS y FROM incidents WHERE tipo = 'R' GROUP BY 1, 2, 3")
def a01_weekly_by_type(spark: SparkSession, d: str) -> DataFrame:
    return panel.period_counts(b.incidents(spark, d), "week", "R")


@query("l05_walk_forward", _panel_sql("week") + "SELECT hex_id, turno, period, y AS real, coalesce(lag_1, 0) AS persistence, round(h, 6) AS historical FROM (SELECT *, avg(y) OVER (PARTITION BY hex_id, turno ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM featured) x WHERE period IN (SELECT period FROM periods ORDER BY period DESC LIMIT 26)")
def l05_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.walk_forward(dense(spark, d, "week"), 26))


@query("l02_group_quantiles", _panel_sql("week") + "SELECT hex_id, turno, round(quantile_cont(y, 0.1), 6) AS low, round(quantile_cont(y, 0.5), 6) AS mid, round(quantile_cont(y, 0.9), 6) AS high FROM dense WHERE year(period) <= 1999 GROUP BY 1, 2")
def l02_group_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.group_quantiles(dense(spark, d, "week").where("year(period) <= 1999")))


_INTERVALS = """, q AS (SELECT hex_id, turno, quantile_cont(y, 0.1) AS low, quantile_cont(y, 0.5) AS mid, quantile_cont(y, 0.9) AS high FROM dense WHERE year(period) <= 1999 GROUP BY 1, 2),
test AS (SELECT f.turno, f.hex_id, f.period, f.y AS real, low, mid, high, greatest(low - y, y - high) AS score FROM dense f JOIN q ON q.hex_id = f.hex_id AND q.turno = f.turno WHERE year(f.period) = 2000)
"""


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    x = dense(spark, d, "week")
    return x.where("year(period) = 2000").withColumnRenamed("y", "real").join(models.group_quantiles(x.where("year(period) <= 1999")), ["hex_id", "turno"])


@query("e05_intervals", _panel_sql("week") + _INTERVALS + "SELECT turno, count(*) AS n, round(avg(CASE WHEN real BETWEEN low AND high THEN 1e0 ELSE 0e0 END), 6) AS coverage, round(avg(high - low), 6) AS width, round(avg(CASE WHEN low > mid OR mid > high THEN 1e0 ELSE 0e0 END), 6) AS crossings FROM test GROUP BY turno")
def e05_intervals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.interval_report(_intervals(spark, d), ["turno"]))


@query(
    "e06_conformal",
    _panel_sql("week") + """, q AS (SELECT hex_id, turno, quantile_cont(y, 0.1) AS low, quantile_cont(y, 0.9) AS high FROM dense WHERE year(period) <= 1998 GROUP BY 1, 2),
s AS (SELECT f.turno, year(period) AS yr, greatest(low - y, y - high) AS score FROM dense f JOIN q ON q.hex_id = f.hex_id AND q.turno = f.turno WHERE year(period) IN (1999, 2000)),
o AS (SELECT turno, score, row_number() OVER (PARTITION BY turno ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY turno) AS n FROM s WHERE yr = 1999),
c AS (SELECT turno, n, score AS q FROM o WHERE i = CAST(ceil(round((n - 1) * least(1e0, ceil(round((n + 1) * 0.8e0, 9)) / n), 9)) AS BIGINT))
SELECT c.turno, any_value(n) AS n, round(any_value(q), 6) AS q, round(avg(CASE WHEN score <= q THEN 1e0 ELSE 0e0 END), 6) AS coverage FROM c JOIN s ON s.turno = c.turno AND yr = 2000 GROUP BY c.turno""",
)
def e06_conformal(spark: SparkSession, d: str) -> DataFrame:
    """The correction of each shift, fitted on 1999 to intervals of the years before, and what it covers in 2000."""
    x = dense(spark, d, "week")
    both = x.where("year(period) IN (1999, 2000)").join(models.group_quantiles(x.where("year(period) <= 1998")), ["hex_id", "turno"])
    scored = both.select("turno", F.year("period").alias("yr"), F.greatest(F.col("low") - F.col("y"), F.col("y") - F.col("high")).alias("score"))
    q = metrics.higher_quantile(scored.where("yr = 1999"), "score", 0.8, ["turno"])
    held = scored.where("yr = 2000").join(F.broadcast(q), "turno")  # a row a shift
    return rounded(held.groupBy("turno", "n", "q").agg(F.avg((F.col("score") <= F.col("q")).cast("double")).alias("coverage")))


@query("w09_activity", ", daily AS (SELECT c.hex_id, CAST(t.t AS BIGINT) AS t, coalesce(n, 0) AS y FROM cells c CROSS JOIN range(30) t(t) LEFT JOIN (SELECT hex_id, datediff('day', DATE '2024-01-01', fecha) AS t, count(*) AS n FROM incidents_h GROUP BY 1, 2) k ON k.hex_id = c.hex_id AND k.t = t.t) SELECT x.hex_id, x.t, x.y, round(coalesce((SELECT sum((1 - exp(-1 / 7e0)) * exp(-(x.t - 1 - s.t) / 7e0) * s.y) FROM daily s WHERE s.hex_id = x.hex_id AND s.t < x.t), 0), 6) AS a FROM daily x")
def w09_activity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(models.activity(_daily(spark, d), 7.0))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    counts = b.incidents_h(spark, d).groupBy("hex_id", F.datediff("fecha", F.lit("2024-01-01")).cast("long").alias("t")).agg(F.count("*").alias("n"))
    grid_t = b.cells(spark, d).select("hex_id", F.explode(F.expr("sequence(0L, 29L)")).alias("t"))
    return grid_t.join(counts, ["hex_id", "t"], "left").select("hex_id", "t", F.coalesce("n", F.lit(0)).alias("y"))


@query("l09_hawkes_fit")
def l09_hawkes_fit(spark: SparkSession, d: str) -> DataFrame:
    """Fits for a grid of decays, scored on the last ten of the stream's thirty days."""
    return rounded(models.tune_hawkes(_daily(spark, d), b.ring(spark, d), TAUS, 20))


@query("l09_hawkes_cells")
def l09_hawkes_cells(spark: SparkSession, d: str) -> DataFrame:
    """The whole history, a background for each cell: every decay alone, the best with every other, the last year held out, and which is chosen."""
    x = b.incidents(spark, d).where("fecha IS NOT NULL")
    first, last = x.agg(F.min("fecha"), F.max("fecha")).first()
    days = (last - first).days + 1
    counts = x.groupBy("hex_id", F.datediff("fecha", F.lit(str(first))).cast("long").alias("t")).agg(F.count("*").alias("n"))
    whole = b.cells(spark, d).select("hex_id", F.explode(F.expr(f"sequence(0L, {days - 1}L)")).alias("t"))
    daily = whole.join(counts, ["hex_id", "t"], "left").select("hex_id", "t", F.coalesce("n", F.lit(0)).alias("y"))
    fits, best = hawkes.choose(hawkes.histories(daily, b.ring(spark, d)), [float(t) for t in TAUS], days - 365, 8)
    rows = [(f.taus[0], f.taus[1] if len(f.taus) > 1 else None, list(f.theta), f.branching, f.mu, f.train, f.held, f is best) for f in fits]
    return rounded(spark.createDataFrame(rows, "tau double, tau2 double, theta array<double>, branching double, mu double, nll_train double, nll_held double, chosen boolean"))


@query("l01_tweedie_surface")
def l01_tweedie_surface(spark: SparkSession, d: str) -> DataFrame:
    x = series.weekly_features(b.cells(spark, d), b.incidents(spark, d), b.ring(spark, d), ()).fillna(0)
    x = stored(x.select("hex_id", "turno", "period", "y", "lag_1", "lag_4", "roll_4", "roll_12"))  # each round of the fit reads it
    model = models.risk_pipeline(["lag_1", "lag_4", "roll_4", "roll_12"], ["turno"]).fit(x.where("year(period) <= 1999"))
    return models.risk_surface(model.transform(x.where("year(period) = 2000")))


@query("p24_override", "SELECT hex_id, CASE WHEN hex_id % 3 = 0 THEN weight * 2 ELSE weight END AS weight, comuna_id FROM cells")
def p24_override(spark: SparkSession, d: str) -> DataFrame:
    x = b.cells(spark, d).select("hex_id", "weight", "comuna_id")
    changes = x.where("hex_id % 3 = 0").select("hex_id", F.lit("weight").alias("feature"), (F.col("weight") * 2).alias("value"))
    return panel.override(x, changes, ["weight"])


@query("p21_group_holdout")
def p21_group_holdout(spark: SparkSession, d: str) -> DataFrame:
    return panel.group_holdout(b.incidents(spark, d), "hex_id").groupBy("held").agg(F.count("*").alias("n"), F.count_distinct("hex_id").alias("cells"))


# --- scalars --------------------------------------------------------------------------------------------------------


@query("f01_shift_of_hour", "SELECT event_id, CASE WHEN hour(ts) BETWEEN 6 AND 13 THEN 'Mañana' WHEN hour(ts) BETWEEN 14 AND 21 THEN 'Tarde' WHEN hour(ts) BETWEEN 2 AND 5 THEN 'Madrugada' ELSE 'Noche' END AS turno FROM events")
def f01_shift_of_hour(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "events").select("event_id", shift_of(hour_of(F.date_format("ts", "HH:mm:ss"))).alias("turno"))


@query("f02_folded_names", "SELECT doc_id, upper(trim(regexp_replace(translate(text, 'áéíóúàèìòùäëïöüâêîôûñçÁÉÍÓÚÀÈÌÒÙÄËÏÖÜÂÊÎÔÛÑÇ', 'aeiouaeiouaeiouaeiouncAEIOUAEIOUAEIOUAEIOUNC'), '[^A-Za-z0-9]+', ' ', 'g'))) AS name FROM documents")
def f02_folded_names(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", fold_name(F.col("text")).alias("name"))


@query("f13_rates", "SELECT n_name AS zone, CASE WHEN people > 0 THEN round(n * 100000e0 / people, 6) END AS rate, format('{:t.}', n) AS shown FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS people FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey")
def f13_rates(spark: SparkSession, d: str) -> DataFrame:
    n = b.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    people = b.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("people"))
    x = b.table(spark, d, "nation").join(n, "n_nationkey", "left").join(people, "n_nationkey", "left")
    return rounded(x.select(F.col("n_name").alias("zone"), rate_per_100k(F.col("n"), F.col("people")).alias("rate"), regional_number(F.col("n")).alias("shown")))


@query("f14_one_every", ", c AS (SELECT tipo, count(*) AS n, 30 * 1440e0 / count(*) AS m FROM incidents_h GROUP BY tipo) SELECT tipo, n, CASE WHEN m < 60 THEN 'minutes' WHEN m < 1440 THEN 'hours' ELSE 'days' END AS unit, round(round_even(CASE WHEN m < 60 THEN m WHEN m < 1440 THEN m / 60 ELSE m / 1440 END, 1), 6) AS every FROM c")
def f14_one_every(spark: SparkSession, d: str) -> DataFrame:
    x = b.incidents_h(spark, d).groupBy("tipo").agg(F.count("*").alias("n"))
    unit, every = one_every(F.col("n"), F.lit(30))
    return rounded(x.select("tipo", "n", unit.alias("unit"), every.alias("every")))


@query("j20_fuzzy_names", "SELECT w.p_type AS wanted, min(n.name) AS name FROM (SELECT DISTINCT p_type FROM part) w JOIN (SELECT DISTINCT p_brand || ' ' || p_type AS name FROM part) n ON list_contains(string_split(upper(replace(n.name, '#', ' ')), ' '), upper(w.p_type)) GROUP BY 1")
def j20_fuzzy_names(spark: SparkSession, d: str) -> DataFrame:
    """Each part type with the brand-and-type names that hold all its tokens; the smallest name wins. Joined on a token."""
    parts = b.table(spark, d, "part")
    wanted = parts.select(F.col("p_type").alias("wanted")).distinct().withColumn("t", tokens(F.col("wanted")))
    names = parts.select(F.concat_ws(" ", "p_brand", "p_type").alias("name")).distinct().withColumn("u", tokens(F.col("name")))
    pairs = wanted.withColumn("key", F.element_at("t", 1)).join(names.withColumn("key", F.explode("u")), "key").where(F.size(F.array_except("t", "u")) == 0)
    return pairs.groupBy("wanted").agg(F.min(F.struct(F.size("u").alias("size"), "name")).alias("b")).select("wanted", "b.name")


# --- grid and statistics --------------------------------------------------------------------------------------------

_AXIAL = """, f AS (SELECT poi_id, (sqrt(3e0) / 3 * x - y / 3e0) / 443e0 AS q, (2e0 / 3 * y) / 443e0 AS r FROM pois),
g AS (SELECT poi_id, q, r, -q - r AS s, floor(q + 0.5) AS nq, floor(r + 0.5) AS nr, floor(-q - r + 0.5) AS ns FROM f)
SELECT poi_id, CAST(CASE WHEN abs(nq - q) > abs(nr - r) AND abs(nq - q) > abs(ns - s) THEN -nr - ns ELSE nq END AS BIGINT) AS q,
CAST(CASE WHEN NOT (abs(nq - q) > abs(nr - r) AND abs(nq - q) > abs(ns - s)) AND abs(nr - r) > abs(ns - s) THEN -nq - ns ELSE nr END AS BIGINT) AS r FROM g"""


@query("g01_cell_of_point", _AXIAL)
def g01_cell_of_point(spark: SparkSession, d: str) -> DataFrame:
    q, r = grid.axial_cell(F.col("x"), F.col("y"), b.CELL_SIZE)
    return b.pois(spark, d).select("poi_id", q.cast("long").alias("q"), r.cast("long").alias("r"))


@query("g04_cell_corners", "SELECT hex_id, k AS corner, round(x + 443 * cos(radians(60 * k - 30)), 4) AS x, round(y + 443 * sin(radians(60 * k - 30)), 4) AS y FROM cells, (SELECT CAST(unnest(range(6)) AS INT) AS k) c")
def g04_cell_corners(spark: SparkSession, d: str) -> DataFrame:
    x = b.cells(spark, d).select("hex_id", F.posexplode(grid.cell_corners(F.col("x"), F.col("y"), b.CELL_SIZE)).alias("corner", "p"))
    return rounded(x.select("hex_id", "corner", "p.x", "p.y"), 4)


@query("g05_rings", "SELECT hex_id, nbr, k FROM ring")
def g05_rings(spark: SparkSession, d: str) -> DataFrame:
    return b.ring(spark, d)


@query("g06_contiguity", "SELECT hex_id, nbr, round(1e0 / count(*) OVER (PARTITION BY hex_id), 6) AS w FROM ring WHERE k = 1")
def g06_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grid.contiguity(b.ring(spark, d)))


@query("g07_adjacency", ", e AS (SELECT hex_id AS i, nbr AS j FROM ring WHERE k = 1 UNION ALL SELECT hex_id, hex_id FROM cells), g AS (SELECT i, count(*) AS d FROM e GROUP BY i) SELECT e.i, e.j, round(1 / sqrt(a.d * c.d), 6) AS w FROM e JOIN g a ON a.i = e.i JOIN g c ON c.i = e.j")
def g07_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(grid.normalised_adjacency(b.ring(spark, d), b.cells(spark, d)))


_YEARLY = ", v AS (SELECT c.hex_id, y.anio, coalesce(n, 0) AS v FROM cells c CROSS JOIN (SELECT DISTINCT year(fecha) AS anio FROM incidents) y LEFT JOIN (SELECT hex_id, year(fecha) AS anio, count(*) AS n FROM incidents GROUP BY 1, 2) k ON k.hex_id = c.hex_id AND k.anio = y.anio), w AS (SELECT hex_id, nbr, 1e0 / count(*) OVER (PARTITION BY hex_id) AS w FROM ring WHERE k = 1)"


def _yearly(spark: SparkSession, d: str) -> DataFrame:
    x = b.incidents(spark, d).withColumn("anio", F.year("fecha"))
    years = x.select("anio").distinct()
    dense_years = b.cells(spark, d).select("hex_id").join(F.broadcast(years), how="cross")  # some ten years
    return dense_years.join(x.groupBy("hex_id", "anio").agg(F.count("*").alias("n")), ["hex_id", "anio"], "left").select("hex_id", "anio", F.coalesce("n", F.lit(0)).alias("v"))


@query("m01_moran", _YEARLY + ", z AS (SELECT hex_id, anio, v - avg(v) OVER (PARTITION BY anio) AS z FROM v), l AS (SELECT w.hex_id, z.anio, sum(w.w * z.z) AS lag FROM w JOIN z ON z.hex_id = w.nbr GROUP BY 1, 2) SELECT z.anio, count(*) AS n, round(sum(z.z * coalesce(lag, 0)) / sum(z.z * z.z), 6) AS moran, round(-1e0 / (count(*) - 1), 6) AS expected FROM z LEFT JOIN l ON l.hex_id = z.hex_id AND l.anio = z.anio GROUP BY z.anio")
def m01_moran(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.moran(_yearly(spark, d), grid.contiguity(b.ring(spark, d)), ["anio"]))


@query("m03_local_moran", _YEARLY + ", z AS (SELECT hex_id, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS z FROM v WHERE anio = 2000), l AS (SELECT w.hex_id, sum(w.w * z.z) AS lag FROM w JOIN z ON z.hex_id = w.nbr GROUP BY 1) SELECT z.hex_id, round(z, 6) AS z, round(coalesce(lag, 0), 6) AS lag, round(z * coalesce(lag, 0), 6) AS local, (CASE WHEN z >= 0 THEN 'H' ELSE 'L' END) || (CASE WHEN coalesce(lag, 0) >= 0 THEN 'H' ELSE 'L' END) AS quadrant FROM z LEFT JOIN l ON l.hex_id = z.hex_id")
def m03_local_moran(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.local_moran(_yearly(spark, d).where("anio = 2000"), grid.contiguity(b.ring(spark, d))))


@query("m02_moran_permutations")
def m02_moran_permutations(spark: SparkSession, d: str) -> DataFrame:
    return statistics.moran_permutations(_yearly(spark, d).where("anio = 2000"), grid.contiguity(b.ring(spark, d)))


@query("m09_stability_null")
def m09_stability_null(spark: SparkSession, d: str) -> DataFrame:
    x = _yearly(spark, d).select("hex_id", F.col("anio").alias("year"), F.col("v").cast("double").alias("n"))
    return rounded(statistics.stability_against_null(x))


@query("a26_monthly_evolution", _BASELINE.split("test AS")[0] + """real AS (SELECT month(fecha) AS mes, hex_id, count(*) AS n FROM incidents WHERE year(fecha) = 2000 GROUP BY 1, 2), score AS (SELECT hex_id, round(sum(m), 6) AS p FROM mean GROUP BY hex_id),
x AS (SELECT ms.mes, c.hex_id, coalesce(n, 0) AS n, coalesce(p, 0) AS p FROM cells c CROSS JOIN (SELECT DISTINCT mes FROM real) ms LEFT JOIN real r ON r.hex_id = c.hex_id AND r.mes = ms.mes LEFT JOIN score s ON s.hex_id = c.hex_id),
o AS (SELECT *, row_number() OVER (PARTITION BY mes ORDER BY p DESC, hex_id) AS rn, count(*) OVER (PARTITION BY mes) AS m FROM x)
SELECT mes, round(sum(CASE WHEN rn <= greatest(1, CAST(round_even(m * 0.2e0, 0) AS INT)) THEN n ELSE 0 END) * 1e0 / sum(n), 6) AS recall20 FROM o GROUP BY mes""")
def a26_monthly_evolution(spark: SparkSession, d: str) -> DataFrame:
    x = b.incidents(spark, d)
    past = x.where(F.year("fecha") <= 1999)
    score = past.groupBy("hex_id").agg(F.count("*").alias("c")).join(F.broadcast(past.agg(F.count_distinct("fecha").alias("days"))), how="cross").select("hex_id", F.round(F.col("c") / F.col("days"), 6).alias("p"))
    real = x.where(F.year("fecha") == 2000).groupBy(F.month("fecha").alias("mes"), "hex_id").agg(F.count("*").alias("n"))
    grid_m = b.cells(spark, d).select("hex_id").join(F.broadcast(real.select("mes").distinct()), how="cross")  # twelve months
    dense_m = grid_m.join(real, ["mes", "hex_id"], "left").join(score, "hex_id", "left").select("mes", "hex_id", F.coalesce("n", F.lit(0)).alias("real"), F.coalesce("p", F.lit(0.0)).alias("pred"))
    return rounded(metrics.hotspots(dense_m, [0.2], by=["mes"]).select("mes", F.col("recall").alias("recall20")))


@query("a28_top_in_hot_cells", ", c AS (SELECT hex_id, tipo, count(*) AS n FROM incidents_h GROUP BY 1, 2), h AS (SELECT hex_id FROM c GROUP BY hex_id ORDER BY sum(n) DESC, hex_id LIMIT 40), o AS (SELECT c.*, row_number() OVER (PARTITION BY hex_id ORDER BY n DESC, tipo) AS rn FROM c WHERE hex_id IN (SELECT hex_id FROM h)) SELECT hex_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS units, round(sum(CASE WHEN rn <= 3 THEN n ELSE 0 END) * 1e0 / sum(n), 6) AS top3 FROM o GROUP BY hex_id")
def a28_top_in_hot_cells(spark: SparkSession, d: str) -> DataFrame:
    c = b.incidents_h(spark, d).groupBy("hex_id", "tipo").agg(F.count("*").alias("n"))
    hot = c.groupBy("hex_id").agg(F.sum("n").alias("t")).orderBy(F.desc("t"), "hex_id").limit(40).select("hex_id")
    o = c.join(F.broadcast(hot), "hex_id").withColumn("rn", F.row_number().over(Window.partitionBy("hex_id").orderBy(F.desc("n"), "tipo")))  # 40 rows
    return rounded(o.groupBy("hex_id").agg(F.sum("n").alias("n"), F.count("*").alias("units"), (F.sum(F.when(F.col("rn") <= 3, F.col("n")).otherwise(0)) / F.sum("n")).alias("top3")))


@query("w12_sliding_arrays", _panel_sql("week") + ", k AS (SELECT hex_id, period, CAST(sum(y) AS BIGINT) AS n FROM dense GROUP BY 1, 2) SELECT hex_id, period, list(n) OVER (PARTITION BY hex_id ORDER BY period ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS last12 FROM k")
def w12_sliding_arrays(spark: SparkSession, d: str) -> DataFrame:
    """The last twelve weekly counts of each cell, weeks without incidents included, as an array."""
    k = dense(spark, d, "week").groupBy("hex_id", "period").agg(F.sum("y").alias("n"))
    w = Window.partitionBy("hex_id").orderBy("period").rowsBetween(-11, 0)
    return k.select("hex_id", "period", F.collect_list("n").over(w).alias("last12"))
