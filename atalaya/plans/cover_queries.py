"""Queries of covering plans: optima with proof, K and radius sweeps, a second objective, equity, retention, scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as b
from ..operators import covering
from ..operators.tables import cut
from .panel_queries import _BASELINE, baseline_scores, rounded
from .registry import query
from .spatial_queries import _REACH, reach

#: Plan sizes of the K sweep and of the radius sweep, radii in metres, the size whose plans are compared, and the
#: size of the plan that is published.
SWEEP_K = (5, 10, 15, 20, 30, 40, 50, 60, 75, 90, 110)
RADIUS_K = (10, 15, 20, 25, 30, 35, 40, 50, 60, 75)
RADII = (300, 500, 650, 800, 1000, 1200, 1500)
TITLE_K, PLAN_K, RADIUS = 75, 40, 800


def instance(spark: SparkSession, d: str, radius: float = RADIUS) -> DataFrame:
    """candidate, demand, dist, risk, population, comuna_id: what each cell as a site reaches by road, afternoon risk."""
    risk = baseline_scores(spark, d).where("turno = 'Tarde'").select(F.col("hex_id").alias("demand"), F.col("pred").alias("risk"), "comuna_id")
    people = b.cells(spark, d).select(F.col("hex_id").alias("demand"), F.col("weight").alias("population"))
    return cut(reach(spark, d, float(radius)).select(F.col("source").alias("candidate"), F.col("node").alias("demand"), "dist").join(risk, "demand").join(people, "demand"))


def named(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[p.cast("string") if isinstance(p, Column) else p for p in parts])


def problems(pairs: DataFrame, ks: Sequence[int], weight: str = "risk", floor: Column | None = None, radii: Sequence[float] = ()) -> tuple[DataFrame, DataFrame]:
    """(problem, k) and their pairs: every k, and every radius if given, as a problem 'radius/k'."""
    radius = F.explode(F.array(*[F.lit(float(r)) for r in radii])) if radii else F.lit(0.0)
    x = pairs.withColumn("radius", radius).where((F.col("radius") == 0) | (F.col("dist") <= F.col("radius"))).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    x = x.withColumn("problem", named(F.col("radius").cast("int"), F.col("k")))
    group = F.lit(None) if floor is None else floor
    return x.select("problem", "k").distinct(), x.select("problem", "candidate", "demand", F.col(weight).alias("weight"), group.alias("grp"))


def total(pairs: DataFrame, weight: str = "risk") -> DataFrame:
    return pairs.select("demand", weight).distinct().agg(F.sum(weight).alias("total"))


def shares(solved: DataFrame, pairs: DataFrame, weight: str = "risk") -> DataFrame:
    """solved with covered and bound as shares of all weight that some site reaches."""
    return solved.join(F.broadcast(total(pairs, weight)), how="cross").withColumns({c: F.col(c) / F.col("total") for c in ("covered", "bound")}).drop("total")  # one row


def held(plans: DataFrame, pairs: DataFrame, weight: str) -> DataFrame:
    """plan, share: what each plan (plan, candidate) covers of a weight."""
    hit = plans.join(pairs.select("candidate", "demand", weight), "candidate").select("plan", "demand", weight).distinct()
    return hit.groupBy("plan").agg(F.sum(weight).alias("w")).join(F.broadcast(total(pairs, weight)), how="cross").select("plan", (F.col("w") / F.col("total")).alias("share"))  # one row


def today(pairs: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """candidate: the sites that exist today, one cell in seven."""
    return b.cells(spark, d).where("hex_id % 7 = 0").select(F.col("hex_id").alias("candidate"))


_SMALL = (
    _BASELINE
    + _REACH
    + """, d AS (SELECT hex_id AS demand, pred AS w, CAST(comuna_id % 3 AS INT) AS g FROM scored WHERE turno = 'Tarde'), radii(radius) AS (VALUES (400), (600), (800)),
p AS MATERIALIZED (SELECT radius, source AS c, demand, w, g FROM reach JOIN d ON demand = node, radii WHERE dist <= radius),
need AS (SELECT radius, bit_or(1 << g) AS mask FROM p GROUP BY 1),
s1 AS MATERIALIZED (SELECT radius, c, sum(w) AS w, bit_or(1 << g) AS mask FROM p GROUP BY 1, 2),
s2 AS MATERIALIZED (SELECT x.radius, x.c AS a, y.c AS b, sum(x.w) AS w FROM p x JOIN p y ON y.radius = x.radius AND y.demand = x.demand AND x.c <= y.c GROUP BY 1, 2, 3),
s3 AS MATERIALIZED (SELECT x.radius, x.c AS a, y.c AS b, z.c AS c, sum(x.w) AS w FROM p x JOIN p y ON y.radius = x.radius AND y.demand = x.demand AND x.c <= y.c JOIN p z ON z.radius = x.radius AND z.demand = x.demand AND y.c <= z.c GROUP BY 1, 2, 3, 4),
t AS MATERIALIZED (SELECT x.radius, x.w + y.w + z.w - coalesce(xy.w, 0) - coalesce(yz.w, 0) - coalesce(xz.w, 0) + coalesce(s3.w, 0) AS w, x.mask | y.mask | z.mask AS mask, 1 + CAST(x.c < y.c AS INT) + CAST(y.c < z.c AS INT) AS n
  FROM s1 x JOIN s1 y ON y.radius = x.radius AND x.c <= y.c JOIN s1 z ON z.radius = x.radius AND y.c <= z.c LEFT JOIN s2 xy ON xy.radius = x.radius AND xy.a = x.c AND xy.b = y.c LEFT JOIN s2 yz ON yz.radius = x.radius AND yz.a = y.c AND yz.b = z.c
  LEFT JOIN s2 xz ON xz.radius = x.radius AND xz.a = x.c AND xz.b = z.c LEFT JOIN s3 ON s3.radius = x.radius AND s3.a = x.c AND s3.b = y.c AND s3.c = z.c),
asked AS (SELECT radius, k, floor FROM radii, (VALUES (1), (2), (3)) ks(k), (VALUES (false), (true)) fs(floor)),
best AS (SELECT a.radius, a.k, a.floor, max(t.w) AS w FROM asked a JOIN need USING (radius) LEFT JOIN t ON t.radius = a.radius AND t.n <= a.k AND (NOT a.floor OR t.mask = need.mask) GROUP BY 1, 2, 3)
SELECT radius, k, floor, CASE WHEN w IS NULL THEN 'infeasible' ELSE 'optimal' END AS estado, round(coalesce(w, 0) / (SELECT sum(w) FROM d), 6) AS covered FROM best"""
)


@query("o01_small_plans", _SMALL)
def o01_small_plans(spark: SparkSession, d: str) -> DataFrame:
    """Optima of one to three sites at three radii, with and without a floor of three groups; the SQL tries every triple of sites."""
    pairs, parts = instance(spark, d), []
    for floor in (None, F.col("comuna_id") % 3):
        solved = covering.solve(*problems(pairs, (1, 2, 3), floor=floor, radii=(400, 600, 800)))
        parts.append(shares(solved, pairs).select(F.split("problem", "/")[0].cast("int").alias("radius"), "k", F.lit(floor is not None).alias("floor"), "estado", "covered"))
    return rounded(parts[0].unionByName(parts[1]))


@query("o01_patrol_plan")
def o01_patrol_plan(spark: SparkSession, d: str) -> DataFrame:
    """The sites of the best plan of forty with a floor by district, its state, coverage and bound, and which sites exist today."""
    pairs = instance(spark, d)
    solved = cut(covering.solve(*problems(pairs, (PLAN_K,), floor=F.col("comuna_id"))))
    head = shares(solved, pairs).select("k", "estado", "covered", "bound", F.explode_outer("sites").alias("candidate"))
    cells = b.cells(spark, d).select(F.col("hex_id").alias("candidate"), "comuna_id", "x", "y")
    return rounded(head.join(cells, "candidate", "left").withColumn("existing", F.col("candidate") % 7 == 0))


@query("o02_population_plan")
def o02_population_plan(spark: SparkSession, d: str) -> DataFrame:
    """For each K: risk and population covered by the plan for risk and by the plan for population, and the sites they share."""
    pairs, out = instance(spark, d), None
    for name, weight in (("risk", "risk"), ("population", "population")):
        solved = cut(covering.solve(*problems(pairs, SWEEP_K, weight, F.col("comuna_id"))))
        plans = covering.sites(solved)
        x = solved.select(F.col("problem").alias("plan"), "k", F.col("estado").alias(f"estado_{name}"), F.col("sites").alias(f"sites_{name}"))
        for of in ("risk", "population"):
            x = x.join(held(plans, pairs, of).withColumnRenamed("share", f"{of}_by_{name}_plan"), "plan", "left")
        out = x if out is None else out.join(x.drop("k"), "plan")
    both = F.size(F.array_intersect("sites_risk", "sites_population")) / F.size("sites_risk")
    return rounded(out.withColumn("shared", both).drop("plan", "sites_risk", "sites_population"))


@query("o03_k_sweep")
def o03_k_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Eleven plan sizes on one coverage table, each solved: state, coverage, bound, gain on the size before."""
    from pyspark.sql import Window

    pairs = instance(spark, d)
    solved = shares(covering.solve(*problems(pairs, SWEEP_K, floor=F.col("comuna_id"))), pairs)
    gain = F.col("covered") - F.lag("covered").over(Window.orderBy("k"))  # eleven rows
    return rounded(solved.select("k", "estado", "covered", "bound", "nodes", F.size("sites").alias("n_sites")).withColumn("gain", gain))


@query("o04_radius_sweep")
def o04_radius_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Seven radii by ten sizes, each solved from one reach table: the least size as good as today's sites, the gain at the title size, and the sites shared with the plan at 800 m."""
    pairs = instance(spark, d, max(RADII))
    solved = cut(shares(covering.solve(*problems(pairs, RADIUS_K, floor=F.col("comuna_id"), radii=RADII)), pairs).withColumn("radius", F.split("problem", "/")[0].cast("int")))
    at = pairs.withColumn("radius", F.explode(F.array(*map(F.lit, RADII)))).where("dist <= radius")
    hit = at.join(today(pairs, spark, d), "candidate", "left_semi").select("radius", "demand", "risk").distinct().groupBy("radius").agg(F.sum("risk").alias("w"))
    now = hit.join(F.broadcast(total(pairs)), how="cross").select("radius", (F.col("w") / F.col("total")).alias("today"))  # one row
    x = solved.join(now, "radius").groupBy("radius").agg(
        F.max("today").alias("today"), F.count_if(F.col("estado") == "infeasible").alias("infeasible"), F.min(F.when((F.col("estado") != "infeasible") & (F.col("covered") >= F.col("today")), F.col("k"))).alias("crossover_k"),
        F.max(F.when(F.col("k") == TITLE_K, F.col("covered"))).alias("covered_title"), F.max(F.when(F.col("k") == TITLE_K, F.col("sites"))).alias("sites"), F.max(F.col("bound") - F.col("covered")).alias("largest_gap"),
    )
    base = x.where(F.col("radius") == RADIUS).select(F.col("sites").alias("base"))
    x = x.join(F.broadcast(base), how="cross").withColumn("shared_with_base", F.size(F.array_intersect("sites", "base")) / F.size("base"))  # one row
    return rounded(x.withColumn("gain", F.col("covered_title") - F.col("today")).drop("sites", "base"))


@query("o05_equity")
def o05_equity(spark: SparkSession, d: str) -> DataFrame:
    """For each K: the worst and best district, the gap, the median and the districts under a tenth, each with its own denominator."""
    pairs = instance(spark, d)
    solved = covering.solve(*problems(pairs, SWEEP_K, floor=F.col("comuna_id")))
    hit = covering.sites(solved).join(pairs, "candidate").select("plan", "demand", "risk", "comuna_id").distinct().groupBy("plan", "comuna_id").agg(F.sum("risk").alias("w"))
    own = pairs.select("demand", "risk", "comuna_id").distinct().groupBy("comuna_id").agg(F.sum("risk").alias("own"))
    every = solved.where("estado <> 'infeasible'").select(F.col("problem").alias("plan"), "k").join(F.broadcast(own), how="cross")  # districts
    share = every.join(hit, ["plan", "comuna_id"], "left").withColumn("coverage", F.coalesce("w", F.lit(0.0)) / F.col("own"))
    return rounded(share.groupBy("k").agg(
        F.min_by("comuna_id", F.struct("coverage", "comuna_id")).alias("worst"), F.max_by("comuna_id", F.struct(F.col("coverage"), -F.col("comuna_id"))).alias("best"), (F.max("coverage") - F.min("coverage")).alias("gap"),
        F.median("coverage").alias("median"), F.count_if(F.col("coverage") < 0.1).alias("below"),
    ))


@query("o06_retention")
def o06_retention(spark: SparkSession, d: str) -> DataFrame:
    """The best plan of ten for each type's risk, and what it covers of every other type's risk over what that type's own plan covers."""
    n = b.incidents(spark, d).where(F.year("fecha") == 2000).groupBy(F.col("tipo").alias("surface"), F.col("hex_id").alias("demand")).agg(F.count("*").alias("risk"))
    pairs = cut(reach(spark, d).select(F.col("source").alias("candidate"), F.col("node").alias("demand")).join(n, "demand"))
    solved = cut(covering.solve(pairs.select(F.col("surface").alias("problem"), F.lit(10).alias("k")).distinct(), pairs.select(F.col("surface").alias("problem"), "candidate", "demand", F.col("risk").alias("weight"), F.lit(None).alias("grp"))))
    hit = covering.sites(solved).join(pairs, "candidate").select("plan", "surface", "demand", "risk").distinct().groupBy("plan", "surface").agg(F.sum("risk").alias("held"))
    own = solved.select(F.col("problem").alias("surface"), "estado", "covered")
    return rounded(hit.join(own, "surface").select("plan", "surface", "estado", F.try_divide("held", "covered").alias("retained")))


@query("o12_resources")
def o12_resources(spark: SparkSession, d: str) -> DataFrame:
    """Scenarios of more sites or a wider reach, each solved anew: coverage, gain on the base, and the sites kept from it."""
    pairs = instance(spark, d, 1000)
    asks = spark.createDataFrame([("base", PLAN_K, 800.0), ("more sites", PLAN_K + 6, 800.0), ("wider reach", PLAN_K, 1000.0), ("both", PLAN_K + 6, 1000.0)], "problem string, k int, radius double")
    own = pairs.join(F.broadcast(asks), pairs.dist <= asks.radius)  # four rows
    solved = cut(shares(covering.solve(asks.select("problem", "k"), own.select("problem", "candidate", "demand", F.col("risk").alias("weight"), F.col("comuna_id").alias("grp"))), pairs))
    base = solved.where("problem = 'base'").select(F.col("covered").alias("base"), F.col("sites").alias("base_sites"))
    x = solved.join(F.broadcast(base), how="cross")  # one row
    return rounded(x.select("problem", "k", "estado", "covered", "bound", (F.col("covered") - F.col("base")).alias("gain"), (F.size(F.array_intersect("sites", "base_sites")) / F.size("base_sites")).alias("kept")))
