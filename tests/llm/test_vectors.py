"""The vector operators against brute force over all rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from atalaya.llm import centroid_clusters, hard_negatives, nearest_neighbours
from atalaya.llm._vectors import VISITS, by_bin, pack

SCHEMA = "vec_id long, embedding array<float>, label int, bin int, unit string"


def rows_of(n, dim=8, seed=1, hot=0.3, copies=20):
    """n vectors: some around a hot place, the last `copies` all equal; a third has label 0. bin and unit clash with inner names."""
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, dim))
    x[: int(n * hot)] = x[0] + 0.02 * random.normal(size=(int(n * hot), dim))
    x[n - copies :] = x[n - 1]
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    return [(i, x[i].tolist(), int(0 if i % 3 == 0 else i % 7), 5, "u") for i in range(n)]


def odd(dim=8):
    nan, inf = float("nan"), float("inf")
    return [(None, [1.0] * dim, 1, 0, ""), (10_000, None, 1, 0, ""), (10_020, [nan] * dim, 1, 0, ""), (10_040, [inf] + [0.0] * (dim - 1), 1, 0, ""), (10_060, [None] + [1.0] * (dim - 1), 1, 0, ""), (10_080, [], 1, 0, ""), (10_100, [1.0] * (dim - 1), 1, 0, ""), (10_200, [0.0] * dim, 1, 0, ""), (10_300, [0.5] * dim, None, 0, "")]


def good(rows, dim=8):
    return [r for r in rows if r[0] is not None and r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]


def brute_nearest(rows, k):
    rows = [r for r in good(rows) if any(r[1])]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[ids[i]] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_nearest_all_leaves_is_exact(spark):
    rows = rows_of(900) + odd()
    got = found(nearest_neighbours.nearest(spark.createDataFrame(rows, SCHEMA), 20, target=1.0, sample_rows=300, leaf_rows=10))
    want = brute_nearest(rows, 20)
    assert got.keys() == want.keys()
    hits = sum([v for v, _ in got[q]] == [v for v, _ in want[q]] for q in want)
    assert hits >= 0.97 * len(want)  # calibration covers all 45 queries, so that every neighbour's leaf is visited
    assert all(math.isclose(a[1], b[1], abs_tol=1e-12) for q in want for a, b in zip(got[q], want[q], strict=True))


def test_nearest_unequal_norms_and_recall(spark):
    random = np.random.default_rng(3)
    rows = [(i, (np.array(v) * random.uniform(0.2, 3)).tolist(), *rest) for i, v, *rest in rows_of(2000, hot=0.1, copies=3)]
    df = nearest_neighbours.nearest(spark.createDataFrame(rows, SCHEMA), 20, sample_rows=1000, leaf_rows=12)
    got, want = found(df), brute_nearest(rows, 20)
    recall = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want])
    first = df.first()
    assert recall >= 0.93 and first.leaves_visited < first.leaves / 2


def test_nearest_recall_on_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [tuple(r) for r in table.collect()]
    x = np.array([r[1] for r in rows], np.float64)
    got = found(nearest_neighbours.nearest(table))
    hits = total = 0
    for i, r in enumerate(rows):
        if r[0] % 20 == 0:
            s = x @ x[i]
            s[i] = -np.inf
            true = {rows[j][0] for j in np.argsort(-s)[:20]}
            hits, total = hits + len(true & {v for v, _ in got[r[0]]}), total + 20
    assert hits / total >= 0.9


def test_nearest_few_repeated_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 0, ""), (20, [0.5, 0.5], 1, 0, ""), (20, [0.5, 0.5], 1, 0, ""), (7, [1.0, 0.0], 1, 0, ""), (3, [1.0, 0.0], 1, 0, "")], SCHEMA)
    assert found(nearest_neighbours.nearest(few)) == {0: [(3, 1.0), (7, 1.0), (20, 0.5)], 20: [(0, 0.5), (3, 0.5), (7, 0.5)]}
    assert nearest_neighbours.nearest(few.limit(0)).count() == 0
    assert nearest_neighbours.nearest(spark.createDataFrame(odd(), SCHEMA).where("vec_id = 10200")).count() == 0


def test_bins_hold_all_units():
    sizes = np.array([5, 0, 40, 3, 2, 7, 100, 1])
    first, blocks = pack(sizes, (10, 10))
    held = by_bin(range(len(sizes)), first, blocks)
    assert sorted(u for units in held.values() for u in set(units)) == sorted(np.repeat(np.arange(len(sizes)), blocks))
    assert all(len(units) == 1 or sum(sizes[u] for u in units) <= 10 for units in held.values()) and blocks[6] == 10


def test_hot_bin_is_copied(spark):
    import pyarrow as pa

    from atalaya.llm._vectors import meet

    rows, asks = spark.range(6).select((F.col("id") % 2).cast("int").alias("bin"), F.col("id").alias("vec_id")), spark.range(1000).select(F.lit(1).alias("bin"), F.col("id").alias("query_id"))

    def match(key, left, right):
        assert len(left) == 3 and len(right) < 250
        return pa.table({"q": right["query_id"], "n": pa.array([len(left)] * len(right))})

    out = meet(rows, asks, match, "q long, n long", most=100)
    assert out.count() == out.select("q").distinct().count() == 1000 and VISITS == 65_536


def brute_clusters(rows, k, dim, rounds):
    kept = [r for r in rows if r[1] is not None and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])]
    x = [[math.floor(256 * v) for v in np.array(r[1], np.float32).astype(float).tolist()] for r in kept]
    order = sorted((i for i in range(len(x)) if kept[i][0] is not None), key=lambda i: (hashlib.sha256(f"2:{kept[i][0]}".encode()).hexdigest(), x[i]))
    centres = [x[i] for i in order[:k]]
    for n in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres] for v in x]
        of = [row.index(min(row)) for row in d]
        if n < rounds:
            centres = [[sum(c) // len(c) for c in zip(*own, strict=True)] if (own := [v for v, o in zip(x, of, strict=True) if o == j]) else centres[j] for j in range(len(centres))]
    inertia = [sum(min(row) for row, o in zip(d, of, strict=True) if o == j) for j in range(len(centres))]
    return sorted((str(r[0]), o, min(row), inertia[o], sum(inertia), hashlib.sha256(",".join(map(str, centres[o])).encode()).hexdigest()) for r, o, row in zip(kept, of, d, strict=True))


@pytest.mark.parametrize("k", [1, 12])
def test_clusters(spark, k):
    rows = rows_of(700, copies=60) + odd() + [(4, [0.1] * 8, 1, 0, ""), (4, [0.1] * 8, 1, 0, "")]
    df = centroid_clusters.cluster(spark.createDataFrame(rows, SCHEMA), k, 8, 5)
    got = df.collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == brute_clusters(rows, k, 8, 5)
    assert sum(r.scanned for r in got) < (1 if k == 1 else 0.6 * len(got))


def test_clusters_large_components_few_and_empty(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i).integers(-200_000, 200_000, 8)], 0, 0, "") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    for part, k in ((df, 4), (df.limit(3), 40)):
        got = sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroid_clusters.cluster(part, k, 8, 3).collect())
        assert got == brute_clusters([tuple(r) for r in part.collect()], k, 8, 3)
    assert centroid_clusters.cluster(df.limit(0)).count() == 0


def test_drops_hold_and_are_tighter_than_the_drift():
    random = np.random.default_rng(5)
    saved = []
    for _ in range(60):
        dim = int(random.integers(2, 9))
        centres, old = random.normal(size=(2, 5, dim))
        new, radii = old + random.normal(size=(5, dim)) * random.choice([0.01, 0.3, 2]), random.uniform(0, 1.5, 5)
        bound, drift = centroid_clusters.drops(centres, radii, old, new), np.linalg.norm(new - old, axis=1)
        p = random.normal(size=(4000, dim))
        p *= (random.uniform(0.6, 1, 4000) / np.linalg.norm(p, axis=1))[:, None]
        for i in range(5):
            at = centres[i] + radii[i] * p
            real = (np.linalg.norm(at[:, None] - old, axis=2) - np.linalg.norm(at[:, None] - new, axis=2)).max(0)
            assert (real <= bound[i] + 1e-9).all() and (bound[i] <= drift + 1e-12).all()
        saved.append((bound / drift).mean())
    assert np.mean(saved) < 0.7


def brute_negatives(rows, dim=8):
    rows = [r for r in good(rows, dim) if r[2] is not None]
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    x = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(float)).astype(np.int64)
    out = set()
    for i in np.flatnonzero(ids % 100 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i]
        for p in [j for j in order if labels[j] == labels[i]][:5]:
            fits = [j for j in order if labels[j] != labels[i] and 30 * s[p] <= 100 * s[j] <= 90 * s[p]][:10]
            out |= {(int(ids[i]), int(ids[p]), n + 1, int(ids[j]), int(s[p]), int(s[j])) for n, j in enumerate(fits)}
    return out


@pytest.mark.parametrize("first", [1, 24])
def test_negatives(spark, first):
    rows = rows_of(1500) + odd()
    df = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), sample_rows=400, codes=8, first=first)
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows)


def test_negatives_few_large_and_empty(spark):
    random = np.random.default_rng(9)
    rows = [(i * 50, [float(v) for v in random.integers(-200_000, 200_000, 8)], i % 2, 0, "") for i in range(24)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in hard_negatives.mine(df).collect()} == brute_negatives(rows)
    assert hard_negatives.mine(df.limit(0)).count() == 0 and hard_negatives.mine(df.limit(1)).count() == 0


def test_heap_gives_cells_by_falling_bound():
    a, b = np.array([1.0, 5.0, 3.0]), np.array([2.0, 2.5])
    got = list(hard_negatives.cells((a, b)))
    assert sorted(c for _, c in got) == list(range(6)) and [s for s, _ in got] == sorted((x + y for x in a for y in b), reverse=True)
    assert all(s == a[c // 2] + b[c % 2] for s, c in got)
