"""What a boosted model's score is made of: exact Shapley values of its trees, row by row, and their means.

A feature that is unknown lets a row go both ways at a node, in the shares in which training rows went. The score then is a sum
over leaves, and for one leaf each feature of its path is a factor: 1 or 0 if known (the row goes there or not), the product of
shares if not. Shapley values of such a product are a sum over the subsets of the other features of the path, at most
2^(depth - 1), taken for all rows at once. Values of all features and the base add up to the row's raw score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Bins, Forest, Tree, codes, leaf_of


def covers(rows: DataFrame, bins: Bins, forest: Forest) -> list[np.ndarray]:
    """For each tree the number of rows that pass each node: one pass counts leaves, which Spark adds up."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(len(t.value), np.int64) for t in forest.trees]
        for batch in batches:
            x = codes(batch["bins"], len(bins.names))
            for n, tree in enumerate(forest.trees):
                held[n] += np.bincount(leaf_of(tree, x), minlength=len(tree.value))
        for n, counts in enumerate(held):
            yield pa.RecordBatch.from_pydict({"tree": np.full(len(counts), n, np.int32), "node": np.arange(len(counts)), "n": counts})

    out = [np.zeros(len(t.value)) for t in forest.trees]
    for r in rows.select("bins").mapInArrow(count, "tree int, node long, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).collect():  # nodes of a model
        out[r.tree][r.node] = r.n
    for n in out:
        for node in range(len(n) - 1, 0, -1):
            n[(node - 1) // 2] += n[node]
    return out


def leaf_paths(tree: Tree, cover: np.ndarray) -> Iterator[tuple[float, dict[int, tuple[np.ndarray, float]]]]:
    """The value of each leaf that rows reached, and for each feature on its path the bins that lead there and the share that goes there."""
    for leaf in np.flatnonzero((tree.feature < 0) & (cover > 0)):
        path, node = {}, int(leaf)
        while node:
            up = (node - 1) // 2
            side = tree.left[up] if node == 2 * up + 1 else ~tree.left[up]
            known, share = path.get(int(tree.feature[up]), (True, 1.0))
            path[int(tree.feature[up])] = (known & side, share * cover[node] / cover[up])
            node = up
        yield float(tree.value[leaf]), path


def tree_values(tree: Tree, cover: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Shapley values (rows by features) of one tree, and its base: the score with no feature known."""
    out, base = np.zeros(x.shape), 0.0
    for value, path in leaf_paths(tree, cover):
        known = {f: bins[x[:, f]].astype(float) for f, (bins, _) in path.items()}
        base += value * np.prod([share for _, share in path.values()])
        for f, (_, share) in path.items():
            others, total = [g for g in path if g != f], np.zeros(len(x))
            for size in range(len(others) + 1):
                weight = 1 / ((len(others) + 1) * comb(len(others), size))
                for some in combinations(others, size):
                    part = np.full(len(x), weight)
                    for g in others:
                        part *= known[g] if g in some else path[g][1]
                    total += part
            out[:, f] += value * (known[f] - share) * total
    return out, base


def attributions(rows: DataFrame, bins: Bins, forest: Forest, cover: list[np.ndarray]) -> DataFrame:
    """rows with base, raw and one column phi_<feature> for each feature of the model: base and all phi add up to raw."""
    used = [bins.names.index(f) for f in forest.model.features]

    def explain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = codes(batch["bins"], len(bins.names))
            phi, base, raw = np.zeros(x.shape), forest.start, np.full(len(x), forest.start)
            for tree, counts in zip(forest.trees, cover, strict=True):
                own, start = tree_values(tree, counts, x)
                phi, base, raw = phi + own, base + start, raw + tree.value[leaf_of(tree, x)]
            out = batch.append_column("base", pa.array(np.full(len(x), base))).append_column("raw", pa.array(raw))
            for f in used:
                out = out.append_column(f"phi_{bins.names[f]}", pa.array(phi[:, f]))
            yield out

    return rows.mapInArrow(explain, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", base double, raw double" + "".join(f", `phi_{bins.names[f]}` double" for f in used))


def importance(explained: DataFrame, features: Iterable[str]) -> DataFrame:
    """feature, mean_abs (mean size of its values), mean, gap (largest difference of base and values from the raw score)."""
    features = list(features)
    gap = F.max(F.abs(F.col("base") + sum(F.col(f"phi_{f}") for f in features) - F.col("raw")))
    one = explained.agg(gap.alias("gap"), *[f(x).alias(n) for c in features for f, x, n in ((F.avg, F.abs(f"phi_{c}"), f"a_{c}"), (F.avg, F.col(f"phi_{c}"), f"m_{c}"))])
    return one.select("gap", F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"a_{c}").alias("mean_abs"), F.col(f"m_{c}").alias("mean")) for c in features])).alias("x")).select("x.*", "gap")
