"""Where to put few resources: covering plans with an equity floor, sweeps, camera and control rankings, scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import percent_rank_average
from .tables import cut

PLAN = "step int, candidate long, gain double, covered double, floor boolean, bound double"


def greedy_cover(coverage: DataFrame, demand: DataFrame, k: int, floor: str | None = None) -> DataFrame:
    """A plan of at most k sites: step, candidate, gain, covered (share of all weight so far), floor, bound.

    coverage (candidate, demand), demand (demand, weight, and the group column of the floor). Each step is one join and
    sum over what is still uncovered, and takes the site of largest gain (ties: lower id). With a floor, groups that some
    site can reach come first: while one has no covered demand, only gains in such groups count. One job a step brings the
    k best sites, at most k rows. bound: no plan of k sites, with or without floor, covers a larger share; the least,
    over the steps so far at which no group is open, of what is covered plus the k largest gains left.
    """
    spark, bound = coverage.sparkSession, 1.0
    total = demand.agg(F.sum("weight")).first()[0] or 0.0
    cols = ["demand", "weight"] + ([floor] if floor else [])
    left, rows, covered = demand.select(*cols).join(coverage.select("demand").distinct(), "demand", "left_semi"), [], 0.0
    open_groups = {r[0] for r in left.select(floor).distinct().toLocalIterator()} if floor else set()
    for step in range(1, k + 1):
        counts = F.col(floor).isin(*open_groups) if open_groups else F.lit(True)
        gains = coverage.select("candidate", "demand").distinct().join(left, "demand").groupBy("candidate")
        gains = gains.agg(F.sum(F.when(counts, F.col("weight")).otherwise(0)).alias("gain"), F.sum("weight").alias("w"), *([F.collect_set(floor).alias("g")] if floor else []))
        ranked = gains.orderBy(F.desc("gain"), "candidate").limit(1 if open_groups else k).collect()
        if not ranked or ranked[0].gain <= 0:
            break
        best = ranked[0]
        if not open_groups:
            bound = min(bound, (covered + sum(r.w for r in ranked)) / total if total else 0.0)
        covered += best.w
        rows.append((step, best.candidate, float(best.w), covered / total if total else 0.0, bool(open_groups), bound))
        if floor:
            open_groups -= set(best.g)
        taken = coverage.where(F.col("candidate") == best.candidate).select("demand").distinct()
        left = left.join(F.broadcast(taken), "demand", "left_anti")  # what one site covers
        if step % 8 == 0:
            left = cut(left)
    return spark.createDataFrame(rows, PLAN)


def plan_state(plan: DataFrame, coverage: DataFrame, demand: DataFrame, floor: str) -> DataFrame:
    """estado: feasible if the plan covers some demand in each group that any site reaches, and the share covered."""
    reach = demand.join(coverage.select("demand").distinct(), "demand", "left_semi")
    held = demand.join(coverage.join(plan.select("candidate"), "candidate", "left_semi").select("demand").distinct(), "demand", "left_semi")
    missing = reach.select(floor).distinct().join(held.select(floor).distinct(), floor, "left_anti").agg(F.count("*").alias("groups_missing"))
    return missing.withColumn("estado", F.when(F.col("groups_missing") == 0, "feasible").otherwise("infeasible"))


def coverage_by_group(plan: DataFrame, coverage: DataFrame, demand: DataFrame, group: str) -> DataFrame:
    """group, coverage: each group's share of its own weight that the plan covers."""
    held = coverage.join(plan.select("candidate").distinct(), "candidate", "left_semi").select("demand").distinct().withColumn("hit", F.lit(1))
    return demand.join(held, "demand", "left").groupBy(group).agg((F.sum(F.when(F.col("hit") == 1, F.col("weight")).otherwise(0)) / F.sum("weight")).alias("coverage"))


def equity_summary(shares: DataFrame, group: str, least: float = 0.1) -> DataFrame:
    """worst, best, gap, median, below (groups under `least`) of coverage by group."""
    return shares.agg(
        F.min_by(group, F.struct("coverage", group)).alias("worst"), F.max_by(group, F.struct(F.col("coverage"), -F.col(group))).alias("best"), (F.max("coverage") - F.min("coverage")).alias("gap"),
        F.median("coverage").alias("median"), F.count_if(F.col("coverage") < least).alias("below"),
    )


def plan_overlap(plans: DataFrame) -> DataFrame:
    """a, b, shared: for each pair of plans (plan, candidate) the share of a's sites that b has too."""
    size = plans.groupBy("plan").agg(F.count("*").alias("k"))
    x, y = plans.select(F.col("plan").alias("a"), "candidate"), plans.select(F.col("plan").alias("b"), "candidate")
    both = x.join(y, "candidate").groupBy("a", "b").agg(F.count("*").alias("n"))
    return both.join(size.select(F.col("plan").alias("a"), "k"), "a").select("a", "b", (F.col("n") / F.col("k")).alias("shared"))


def camera_weights(cells: DataFrame, near_camera: DataFrame, discount: float = 0.3, inner: float = 100.0, outer: float = 150.0) -> DataFrame:
    """hex_id, weight: risk x (1 + (1 - light rank)) x (1 + flow rank), discounted near a camera; none very near.

    cells: hex_id, risk, lights, flow_a, flow_b. near_camera: hex_id, dist (nearest camera).
    """
    light, flow = percent_rank_average(F.col("lights")), (percent_rank_average(F.col("flow_a")) + percent_rank_average(F.col("flow_b"))) / 2
    weighed = cells.select("hex_id", (F.col("risk") * (2 - light) * (1 + flow)).alias("weight"))
    out = weighed.join(near_camera.groupBy("hex_id").agg(F.min("dist").alias("dist")), "hex_id", "left").where(F.col("dist").isNull() | (F.col("dist") > inner))
    return out.select("hex_id", (F.col("weight") * F.when(F.col("dist") <= outer, discount).otherwise(1.0)).alias("weight"))


def control_ranking(corridors: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """access, siniestros_por_km, score, ranking: the mean of two percentile ranks, crashes a km and mean risk."""
    per_km = F.try_divide("siniestros", "km")
    scored = corridors.withColumn("siniestros_por_km", per_km)
    score = (percent_rank_average(F.col("siniestros_por_km"), *by) + percent_rank_average(F.col("risk"), *by)) / 2
    scored = scored.withColumn("score", score)
    return scored.select(*by, "access", "siniestros_por_km", "score", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "access")).alias("ranking"))


def ranked_coverage(ranking: DataFrame, reach: DataFrame, demand: DataFrame, radii: Sequence[float], sizes: Sequence[int]) -> DataFrame:
    """radius, k, covered: the share that the first k sites of ranking (candidate, place) cover at each radius.

    One reach table at the largest radius serves all of it: a demand's first site within a radius decides from which k on
    it is covered.
    """
    first = ranking.join(reach, "candidate").withColumn("radius", F.explode(F.array(*map(F.lit, radii)))).where(F.col("dist") <= F.col("radius"))
    first = first.groupBy("radius", "demand").agg(F.min("place").alias("place")).join(demand.select("demand", "weight"), "demand")
    total = demand.agg(F.sum("weight").alias("total"))
    sums = first.withColumn("k", F.explode(F.array(*map(F.lit, sizes)))).groupBy("radius", "k").agg(F.sum(F.when(F.col("place") <= F.col("k"), F.col("weight")).otherwise(0)).alias("w"))
    return sums.join(F.broadcast(total), how="cross").select("radius", "k", (F.col("w") / F.col("total")).alias("covered"))  # one row


def retention(plans: DataFrame, risks: DataFrame) -> DataFrame:
    """plan, surface, retained: what each plan (plan, candidate) holds of each surface (surface, candidate, risk), over what that surface's own plan holds."""
    held = plans.join(risks, "candidate").groupBy("plan", "surface").agg(F.sum("risk").alias("held"))
    own = held.where("plan = surface").select("surface", F.col("held").alias("own"))
    return held.join(own, "surface").select("plan", "surface", F.try_divide("held", "own").alias("retained"))


def rank_stability(rankings: DataFrame, base: float) -> DataFrame:
    """parameter, spearman, moved: rankings (parameter, access, ranking) against that at base; moved counts changed places."""
    ref = rankings.where(F.col("parameter") == base).select("access", F.col("ranking").alias("ref"))
    return rankings.join(ref, "access").groupBy("parameter").agg(F.corr("ranking", "ref").alias("spearman"), F.count_if(F.col("ranking") != F.col("ref")).alias("moved"))
