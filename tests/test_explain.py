"""Shapley values of trees against the enumeration of all feature subsets."""

from itertools import combinations
from math import factorial

import numpy as np

from atalaya.operators import boosting, explain
from atalaya.operators.boosting import Model, Tree
from tests.test_boosting import SCHEMA, table


def expected(tree, cover, row, known, node=0):
    """The score of a row of which only some features are known."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    if f in known:
        return expected(tree, cover, row, known, 2 * node + 1 if tree.left[node][row[f]] else 2 * node + 2)
    parts = [cover[c] / cover[node] * expected(tree, cover, row, known, c) if cover[c] else 0.0 for c in (2 * node + 1, 2 * node + 2)]
    return sum(parts)


def test_values_equal_enumeration():
    random = np.random.default_rng(6)
    for _ in range(8):
        x = random.integers(0, 5, (200, 4)).astype(np.uint16)
        left = [random.random(5) < 0.5 if n < 7 else None for n in range(15)]
        tree = Tree(np.array([int(random.integers(0, 4)) if n < 7 else -1 for n in range(15)]), left, random.normal(size=15))
        cover = np.bincount(boosting.leaf_of(tree, x), minlength=15).astype(float)
        for node in range(14, 0, -1):
            cover[(node - 1) // 2] += cover[node]
        got, base = explain.tree_values(tree, cover, x[:5])
        for i in range(5):
            assert abs(base - expected(tree, cover, x[i], set())) < 1e-12
            for f in range(4):
                others, want = [g for g in range(4) if g != f], 0.0
                for size in range(4):
                    for some in combinations(others, size):
                        gain = expected(tree, cover, x[i], {*some, f}) - expected(tree, cover, x[i], set(some))
                        want += factorial(size) * factorial(3 - size) / factorial(4) * gain
                assert abs(got[i, f] - want) < 1e-12


def test_values_add_up_and_find_what_matters(spark):
    df = spark.createDataFrame(table(), SCHEMA)
    bins = boosting.fit_bins(df, ["a", "noise"], ["c"])
    rows = boosting.binned(df, bins).cache()
    forest = boosting.boost(rows, bins, [Model("m", "y", "part", ("a", "noise", "c"))], trees=8, depth=3, rate=0.3)["m"]
    cover = explain.covers(rows.where("part = 0"), bins, forest)
    got = {r.feature: r for r in explain.importance(explain.attributions(rows, bins, forest, cover), forest.model.features).collect()}
    assert all(r.gap < 1e-9 for r in got.values()) and got["noise"].mean_abs < 0.2 * min(got["a"].mean_abs, got["c"].mean_abs)
