"""Covering plans against the enumeration of all plans."""

import itertools

import numpy as np

from atalaya.operators import covering

PAIR = "problem string, candidate long, demand long, weight double, grp long"


def cases(seed, count):
    """problem -> (k, pairs) with and without groups; ids far apart."""
    random, out = np.random.default_rng(seed), {}
    for n in range(count):
        sites, demands, groups = int(random.integers(4, 11)), int(random.integers(3, 20)), int(random.integers(0, 6))
        weight = random.uniform(0, 5, demands).round(1).tolist()
        pairs = [(f"p{n}", 1000 + 7 * j, 50 + 3 * i, weight[i], i % groups if groups else None) for j in range(sites) for i in range(demands) if random.random() < 0.3]
        out[f"p{n}"] = int(random.integers(1, 4)), pairs or [(f"p{n}", 1, 1, 1.0, None)]
    return out


def brute(k, pairs):
    sites, groups, best = sorted({p[1] for p in pairs}), {p[4] for p in pairs} - {None}, None
    for size in range(1, k + 1):
        for plan in itertools.combinations(sites, size):
            hit = {(p[2], p[3], p[4]) for p in pairs if p[1] in plan}
            if groups <= {h[2] for h in hit}:
                best = max(best or 0, sum(h[1] for h in hit))
    return best


def test_optima_and_infeasible_sizes_are_proved(spark):
    want = cases(4, 14)
    got = covering.solve(spark.createDataFrame([(p, k) for p, (k, _) in want.items()], "problem string, k int"), spark.createDataFrame([r for _, rows in want.values() for r in rows], PAIR)).collect()
    assert len(got) == len(want) and {r.estado for r in got} == {"optimal", "infeasible"}
    for r in got:
        best = brute(*want[r.problem])
        assert (r.estado == "infeasible") == (best is None)
        if best is not None:
            assert abs(r.covered - best) < 1e-9 and r.bound == r.covered and len(r.sites) <= r.k
            hit = {(p[2], p[3]) for p in want[r.problem][1] if p[1] in r.sites}
            assert abs(sum(w for _, w in hit) - best) < 1e-9


def test_a_run_that_ends_early_states_its_gap(spark):
    random = np.random.default_rng(8)
    pairs = [("a", j, i, float(1 + i % 3), None) for j in range(60) for i in range(90) if random.random() < 0.12]
    asks = spark.createDataFrame([("a", 9)], "problem string, k int")
    rough = covering.solve(asks, spark.createDataFrame(pairs, PAIR), nodes=1, rounds=1).first()
    better = covering.solve(asks, spark.createDataFrame(pairs, PAIR), nodes=20, rounds=3).first()
    assert rough.estado == "gap" and rough.covered <= better.covered <= better.bound <= rough.bound
    loose = covering.solve(asks, spark.createDataFrame(pairs, PAIR), most=10).first()
    assert loose.estado == "greedy" and loose.covered <= better.bound + 1e-9 and loose.bound >= better.covered - 1e-9


def test_empty_nulls_and_repeats(spark):
    rows = [("a", 1, 1, 2.0, None), ("a", 1, 1, 2.0, None), ("a", None, 1, 9.0, None), ("a", 2, None, 9.0, None), ("a", 2, 3, None, None), ("a", 2, 4, -1.0, None)]
    asks = spark.createDataFrame([("a", 5), ("b", 2), ("a0", 0)], "problem string, k int")
    got = {r.problem: (r.estado, r.covered, r.bound) for r in covering.solve(asks, spark.createDataFrame(rows, PAIR)).collect()}
    assert got == {"a": ("optimal", 2.0, 2.0), "b": ("optimal", 0.0, 0.0), "a0": ("optimal", 0.0, 0.0)}


def test_own_plan_keeps_most(spark, sf_dir):
    from atalaya.plans import QUERIES

    got = {(r.plan, r.surface): (r.estado, r.retained) for r in QUERIES["o06_retention"](spark, sf_dir).collect()}
    assert all(s == "optimal" and v <= 1 + 1e-9 and (v == 1 if a == c else True) for (a, c), (s, v) in got.items())
