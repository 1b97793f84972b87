"""Covering plans with proof: branch and bound whose open nodes are rows of a table, searched by tasks side by side.

A problem asks for at most k sites that cover the largest weight, touching each group that any site reaches (the equity
floor). Covering constraints are relaxed with one multiplier a demand and the floor with one a group; what is left picks the k
sites of largest reduced worth, which bounds every plan of a node from above. Subgradient steps tighten the bound, each pick is
also a plan, greedy and swap search raise the best one, and reduced worths fix sites in or out. A node whose bound is not above
the best plan is closed. No open node left proves the optimum; none left and no plan found proves that k sites cannot touch all
groups; a run that ends before states the gap. Each round gives every task a share of the open nodes and the instance; between
rounds Spark keeps the best plan of each problem and deals the open nodes anew.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .allocation import greedy_cover
from .tables import cut

#: Pairs of an instance that a task may hold (under 200 MB); larger ones are planned greedily by Spark, with a bound.
MOST = 1 << 22
#: Nodes that a task searches in a round, rounds, and shares into which the open nodes of a problem are dealt.
NODES, ROUNDS, SHARES = 32, 3, 16
#: Subgradient steps at the root and below.
STEPS = 400, 60

OPEN = "problem string, chosen array<long>, banned array<long>, bound double, value double, sites array<long>, nodes long"
SOLVED = ["problem", "k", "estado", "covered", "bound", "sites", "nodes"]


class Instance:
    """Pairs of site and demand, weights, and sites by groups (0/1); value() is -1 for a plan that leaves out a group."""

    def __init__(self, pairs: pd.DataFrame):
        self.sites, self.site = np.unique(pairs["candidate"].to_numpy(np.int64), return_inverse=True)
        demands, first, self.demand = np.unique(pairs["demand"].to_numpy(np.int64), return_index=True, return_inverse=True)
        self.weight = pairs["weight"].to_numpy(float)[first]
        groups = pairs["grp"].to_numpy(float)
        named = np.unique(groups[~np.isnan(groups)])
        self.touches = np.zeros((len(self.sites), len(named)))
        for n, group in enumerate(named):
            self.touches[self.site[groups == group], n] = 1
        self.total = float(self.weight.sum())
        self.slack = 1e-9 * max(1.0, self.total)
        self.prize = 2 * self.total + 1  # of touching a group, above all weight

    def worth(self, weights: np.ndarray) -> np.ndarray:
        """Of each site, the sum of a weight over its demands."""
        return np.bincount(self.site, weights[self.demand], len(self.sites))

    def counts(self, inside: np.ndarray) -> np.ndarray:
        """Of each demand, how many of the sites in a mask cover it."""
        return np.bincount(self.demand, inside[self.site], len(self.weight))

    def mask(self, picked: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sites), bool)
        out[picked] = True
        return out

    def value(self, picked: np.ndarray) -> float:
        return float(self.weight[self.counts(self.mask(picked)) > 0].sum()) if self.touches[picked].any(0).all() else -1.0

    def improve(self, picked: list[int], k: int) -> np.ndarray:
        """Greedy completion to k sites, then swaps of one site for another while the plan gets better; groups come before weight."""
        picked, inside = list(picked), self.mask(picked)

        def gains() -> np.ndarray:
            out = self.worth(self.weight * (self.counts(inside) == 0)) + self.touches @ (self.prize * ~self.touches[inside].any(0))
            out[inside] = -1
            return out

        while len(picked) < min(k, len(inside)):
            picked.append(int(gains().argmax()))
            inside[picked[-1]] = True
        better = True
        while better:
            better = False
            for n, old in enumerate(picked):
                inside[old] = False
                gain = gains()
                new = int(gain.argmax())
                if gain[new] > gain[old] + self.slack:
                    picked[n], better = new, True
                inside[picked[n]] = True
        return np.sort(picked)


def relax(inst: Instance, free: np.ndarray, left: np.ndarray, groups: np.ndarray, k: int, floor: float, start: tuple[np.ndarray, np.ndarray], steps: int):
    """The least Lagrangian bound found for k of the free sites on the demands left and the open groups (all masks): bound, multipliers, worths and pick; how often each site was picked; the last improving picks."""
    w, g = inst.weight * left, inst.touches * groups
    base, (lam, mu) = inst.total - w.sum(), start
    lam, mu = np.minimum(lam, w), mu * groups
    best, scale, stall, often, tried = (np.inf, lam, mu, None, None), 1.5, 0, np.zeros(len(free)), []
    for _ in range(steps):
        worth = np.where(free, inst.worth(lam) + g @ mu, -np.inf)
        pick = np.argpartition(-worth, k - 1)[:k]
        upper = base + (w - lam).sum() + worth[pick].sum() - mu.sum()
        often[pick] += 1
        if upper < best[0]:
            stall, best = (stall + 1 if upper > best[0] - 1e-6 * abs(best[0]) else 0), (upper, lam, mu, worth, pick)
            tried = [*tried[-7:], pick]
        else:
            stall += 1
        if best[0] <= floor or scale < 1e-3:
            break
        if stall >= 6:
            scale, stall = scale / 2, 0
        inside = inst.mask(pick)
        down, up = (inst.counts(inside) - (lam < w)) * left, (g[inside].sum(0) - 1) * groups
        norm = (down**2).sum() + (up**2).sum()
        if norm == 0:
            break
        step = scale * (upper - max(floor, base - 1)) / norm
        lam, mu = np.clip(lam - step * down, 0, w), np.maximum(mu - step * up, 0)
    return best, often, tried


def search(inst: Instance, k: int, nodes: list[tuple], value: float, plan: np.ndarray, budget: int):
    """Best-first branch and bound from the given open nodes (bound, chosen, banned); open nodes left, best value, plan, nodes seen."""
    heap, seen, m = [(-bound, n, chosen, banned, None) for n, (bound, chosen, banned) in enumerate(nodes)], 0, len(inst.sites)
    heapq.heapify(heap)
    serial, root = len(heap), (inst.weight / 2, np.zeros(inst.touches.shape[1]))
    if all(len(c) + len(b) for _, c, b in nodes):  # multipliers of the root serve the nodes below it
        root = relax(inst, np.ones(m, bool), np.ones(len(inst.weight), bool), np.ones(inst.touches.shape[1], bool), min(k, m), value, root, STEPS[0])[0][1:3]
    while heap and seen < budget:
        bound, _, chosen, banned, start = heapq.heappop(heap)
        if -bound <= value + inst.slack:
            continue
        seen += 1
        taken = inst.mask(chosen)
        free = ~taken & ~inst.mask(banned)
        left, groups, rest = inst.counts(taken) == 0, ~inst.touches[taken].any(0), k - len(chosen)
        if rest == 0 or not free.any():
            if (mine := inst.value(chosen)) > value:
                value, plan = mine, np.sort(chosen)
            continue
        if not inst.touches[free].any(0)[groups].all():
            continue  # a group that no site left can touch
        (upper, lam, mu, worth, pick), often, tried = relax(inst, free, left, groups, min(rest, int(free.sum())), value + inst.slack if value >= 0 else -1.0, start or root, STEPS[bool(len(chosen) + len(banned))])
        upper = min(upper, -bound, inst.total)
        mine = [np.sort(np.concatenate([chosen, t])) for t in tried]
        if seen == 1 or seen % 16 == 0:
            mine += [inst.improve(np.concatenate([chosen, pick]).tolist(), k), inst.improve(chosen.tolist(), k)]
        for candidate in mine:
            if (v := inst.value(candidate)) > value:
                value, plan = v, candidate
        if upper <= (value + inst.slack if value >= 0 else -inst.slack):
            continue
        inside, floor = inst.mask(pick), max(value, 0) + inst.slack
        out = free & ~inside & (upper - worth[pick].min() + worth <= floor) & (value >= 0)
        sure = inside & (upper - worth + worth[free & ~inside].max(initial=0.0) <= floor) & (value >= 0)
        chosen, banned = np.concatenate([chosen, np.flatnonzero(sure)]), np.concatenate([banned, np.flatnonzero(out)])
        undecided = np.flatnonzero(free & ~out & ~sure)
        if not len(undecided) or len(chosen) == k:
            if (v := inst.value(chosen)) > value:
                value, plan = v, np.sort(chosen)
            continue
        split = min(undecided, key=lambda j: (abs(often[j] / often.max() - 0.5), -worth[j]))
        for child in ((np.append(chosen, split), banned), (chosen, np.append(banned, split))):
            heapq.heappush(heap, (-upper, serial := serial + 1, *child, (lam, mu)))
    return [(-b, c, n) for b, _, c, n, _ in heap if -b > value + inst.slack], value, plan, seen


def _task(budget: int):
    def task(key: tuple, nodes: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        inst, k = Instance(pairs), int(nodes["k"].iloc[0])
        place = lambda ids: np.searchsorted(inst.sites, np.asarray(ids, np.int64)).astype(np.int64)
        start = [(float(n.bound), place(n.chosen), place(n.banned)) for n in nodes.itertuples()]
        value, plan = float(nodes["value"].iloc[0]), place(nodes["sites"].iloc[0])
        left, value, plan, seen = search(inst, k, start, value, plan, budget)
        rows = [(key[0], inst.sites[c].tolist(), inst.sites[b].tolist(), bound, None, None, 0) for bound, c, b in left]
        rows.append((key[0], None, None, None, value, inst.sites[plan].tolist(), seen))
        return pd.DataFrame(rows, columns=["problem", "chosen", "banned", "bound", "value", "sites", "nodes"])

    return task


def solve(problems: DataFrame, pairs: DataFrame, *, nodes: int = NODES, rounds: int = ROUNDS, most: int = MOST) -> DataFrame:
    """problem, k, estado, covered, bound, sites, nodes for each row of problems (problem string, k).

    pairs: problem, candidate, demand, weight, grp (null: no floor), one row for each demand that a site covers. estado is optimal,
    infeasible (proved), gap (covered to bound is what is not proved) or greedy (more than `most` pairs). k < 1 has the empty plan.
    """
    spark, none = problems.sparkSession, F.array().cast("array<long>")
    pairs = cut(pairs.select(F.col("problem").cast("string"), F.col("candidate").cast("long"), F.col("demand").cast("long"), F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"), F.col("grp").cast("double")).where("candidate IS NOT NULL AND demand IS NOT NULL AND weight IS NOT NULL").distinct())
    size = pairs.groupBy("problem").agg(F.count("*").alias("size"), F.count_distinct("grp").alias("groups"))
    asked = cut(problems.select(F.col("problem").cast("string"), F.col("k").cast("int")).join(size, "problem", "left"))
    empty = asked.where("size IS NULL OR k < 1").select("problem", "k", F.when(F.coalesce("groups", F.lit(0)) == 0, "optimal").otherwise("infeasible").alias("estado"), F.lit(0.0).alias("covered"), F.lit(0.0).alias("bound"), none.alias("sites"), F.lit(0).cast("long").alias("nodes"))
    fits = asked.where(F.col("k") >= 1).where(F.col("size") <= most).select("problem", "k")
    now = fits.select("problem", none.alias("chosen"), none.alias("banned"), F.lit(float("inf")).alias("bound"))
    best, seen = fits.select("problem", F.lit(-1.0).alias("value"), none.alias("sites")), []
    for _ in range(rounds):
        dealt = now.join(fits, "problem").join(best, "problem").withColumn("share", F.pmod(F.xxhash64("chosen", "banned"), F.lit(SHARES)).cast("int"))
        given = dealt.select(F.col("problem").alias("p"), F.col("share").alias("s")).distinct().join(pairs, F.col("p") == F.col("problem")).select(F.col("p").alias("problem"), F.col("s").alias("share"), "candidate", "demand", "weight", "grp")
        out = cut(dealt.groupBy("problem", "share").cogroup(given.groupBy("problem", "share")).applyInPandas(_task(nodes), OPEN))
        plans = out.where("value IS NOT NULL")
        best = cut(plans.groupBy("problem").agg(F.max(F.struct("value", "sites")).alias("b")).select("problem", "b.*").unionByName(best).groupBy("problem").agg(F.max(F.struct("value", "sites")).alias("b")).select("problem", "b.*"))
        seen.append(plans.groupBy("problem").agg(F.sum("nodes").alias("nodes")))
        slack = F.greatest(F.abs("value"), F.lit(1.0)) * 1e-9
        now = cut(out.where("chosen IS NOT NULL").select("problem", "chosen", "banned", "bound").join(best.select("problem", "value"), "problem").where(F.col("bound") > F.col("value") + slack).drop("value"))
        if now.isEmpty():
            break
    still = now.groupBy("problem").agg(F.max("bound").alias("open"))
    counted = reduce(DataFrame.unionAll, seen).groupBy("problem").agg(F.sum("nodes").alias("nodes"))
    state = F.when(F.col("open").isNotNull(), "gap").when(F.col("value") < 0, "infeasible").otherwise("optimal")
    solved = fits.join(best, "problem").join(counted, "problem").join(still, "problem", "left").select("problem", "k", state.alias("estado"), F.greatest("value", F.lit(0.0)).alias("covered"), F.coalesce("open", F.greatest("value", F.lit(0.0))).alias("bound"), "sites", "nodes")
    solved = solved.unionByName(empty)
    for row in asked.where(F.col("k") >= 1).where(F.col("size") > most).select("problem", "k", "groups").toLocalIterator():
        own = pairs.where(F.col("problem") == row.problem)
        demand = own.select("demand", "weight", "grp").distinct()
        plan = greedy_cover(own.select("candidate", "demand"), demand, row.k, "grp" if row.groups else None)
        total = demand.agg(F.sum("weight").alias("total"))
        one = plan.agg(F.max("covered").alias("c"), F.min("bound").alias("b"), F.array_sort(F.collect_list("candidate")).alias("sites")).join(F.broadcast(total), how="cross")  # k sites, one row
        solved = solved.unionByName(one.select(F.lit(row.problem).alias("problem"), F.lit(row.k).alias("k"), F.lit("greedy").alias("estado"), (F.col("c") * F.col("total")).alias("covered"), (F.col("b") * F.col("total")).alias("bound"), "sites", F.lit(0).cast("long").alias("nodes")))
    return solved.select(*SOLVED)


def sites(solved: DataFrame) -> DataFrame:
    """plan, candidate: the plans of solve() as rows."""
    return solved.where("estado <> 'infeasible'").select(F.col("problem").alias("plan"), F.explode("sites").alias("candidate"))
