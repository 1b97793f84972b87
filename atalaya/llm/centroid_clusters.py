"""Exact k-means over integer vectors with geometric drift bounds.

Each vector carries its cluster and a lower bound of its distance to all other centroids. When centroids move, the lower bound
of the vectors of a cluster is loosened by the largest drop that any point of the cluster's sphere can see: in the plane of a
centroid's old place, its new place and the sphere's centre the drop is largest on the circle, and is found there over ARCS arcs,
each with the slack that its length allows. This is never more than the full drift and mostly far less, since a centroid that
moves sideways or away comes no nearer. A vector whose distance to its own centroid, computed exactly, stays below the bound or
below half the way to the next centroid keeps its cluster; the others are ambiguous and compared with every centroid, exactly.
Sums are taken by Spark, a row a cluster comes back, and each round's state is written to the shared folder.

Defined results: vectors null, of another length than dim, or with a null or non-finite component are left out; a null vec_id is
a vector like others but never a start; rows that share a vec_id are vectors of their own, and as starts go by their components;
with fewer vectors than k there are fewer centroids; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize
from ._vectors import integers, matrix, sound

K, DIM, ROUNDS = 40, 64, 5
#: Arcs of the circle over which a drop is maximised.
ARCS = 256

STATE = "vec_id long, v array<int>, cluster int, distance long, lower double, scanned boolean"


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors (rows) to integer centroids (columns), as 64-bit integers."""
    largest = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if 4 * largest**2 * x.shape[1] < 2**52:  # doubles are exact, and their product is fast
        return np.rint((x**2).sum(1)[:, None] - 2 * (x @ centroids.T) + (centroids**2).sum(1)).astype(np.int64)
    a, b = x.astype(np.int64), centroids.astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1)


def drops(centres: np.ndarray, radii: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """For each sphere (row) and each centroid that goes from old to new (column): the most by which it nears a point of the sphere."""
    move = new - old
    drift = np.sqrt((move**2).sum(1))
    axis = move / np.where(drift > 0, drift, 1)[:, None]
    along = centres @ axis.T - (old * axis).sum(1)  # sphere centres in the plane: along the move from its start, and off its line
    off = np.sqrt(np.maximum(((centres[:, None] - old) ** 2).sum(2) - along**2, 0))
    angle = 2 * np.pi * np.arange(ARCS) / ARCS
    t, p = along[..., None] + radii[:, None, None] * np.cos(angle), off[..., None] + radii[:, None, None] * np.sin(angle)
    drop = np.hypot(t, p) - np.hypot(t - drift[:, None], p)
    half = radii[:, None, None] * np.pi / ARCS  # half an arc
    away = np.hypot(t - np.clip(t, 0, drift[:, None]), p) - half  # of the arc to the way that the centroid takes
    slope = np.where(away > 0, np.minimum(2, drift[:, None] / np.where(away > 0, away, 1)), 2)
    return np.minimum((drop + half * slope).max(2), drift)


def loosened(centroids: np.ndarray, moved: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """By how much the lower bound of each cluster's vectors falls: the largest drop among the other centroids."""
    fall = drops(centroids, radii, centroids, moved)
    np.fill_diagonal(fall, -np.inf)
    return np.maximum(fall.max(1, initial=-np.inf), -1e300)


def assign(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """cluster, squared distance, lower bound, scanned: ambiguous vectors (cluster -1 among them) are compared with every centroid."""
    far = np.sqrt(squared(centroids, centroids).astype(float)) + np.where(np.eye(len(centroids)) > 0, np.inf, 0)
    distance = np.zeros(len(x), np.int64)
    for c in np.unique(cluster[cluster >= 0]):
        distance[cluster == c] = squared(x[cluster == c], centroids[c : c + 1])[:, 0]
    safe = np.maximum(lower, far.min(1)[np.maximum(cluster, 0)] / 2)
    scan = (cluster < 0) | ~(np.sqrt(distance) < safe * (1 - 1e-9) - 1e-6)
    cluster, lower, rows = cluster.copy(), lower.copy(), np.flatnonzero(scan)
    for at in range(0, len(rows), 8192):
        some = rows[at : at + 8192]
        d = squared(x[some], centroids)
        cluster[some] = d.argmin(1)  # the smaller number of equals
        distance[some] = d.min(1)
        d[np.arange(len(some)), cluster[some]] = np.iinfo(np.int64).max
        lower[some] = np.sqrt(d.min(1).astype(float))
    return cluster, distance, lower, scan


def starts(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of 2:<vec_id>."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    return matrix(vectors.where("vec_id IS NOT NULL").select(key.alias("h"), "v").orderBy("h", "v").limit(k).toArrow()["v"])


def cluster(embeddings: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scanned (whether the last round had to compare it)."""
    spark = embeddings.sparkSession
    kept = embeddings.where(sound(F.col(column)) & (F.size(column) == dim))
    vectors = kept.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col(column)).alias("v"))
    state = materialize(vectors.select("*", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0.0).alias("lower"), F.lit(False).alias("scanned")), "clusters")
    centroids = starts(state, k)
    fall = np.zeros(len(centroids))
    if not len(centroids):  # nothing to start from
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scanned boolean")
    for last in [*[False] * rounds, True]:
        new = materialize(state.mapInArrow(_step(centroids, fall), STATE), "clusters")
        discard(state)
        state = new
        if not last:
            sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), F.array(*[F.sum(F.col("v")[i].cast("long")) for i in range(dim)]).alias("v")).collect()  # k rows
            moved, radii = centroids.copy(), np.zeros(len(centroids))
            for row in sums:
                moved[row.cluster] = [s // row.n for s in row.v]
                radii[row.cluster] = np.sqrt(float(row.far)) * (1 + 1e-9)
            centroids, fall = moved, loosened(centroids, moved, radii) + 1e-6
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    named = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    totals = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    totals = totals.join(F.broadcast(named), "cluster").join(F.broadcast(totals.agg(F.sum("cluster_inertia").alias("inertia"))), how="cross")  # one row
    return state.join(F.broadcast(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scanned")  # k rows


def _step(centroids: np.ndarray, fall: np.ndarray):
    """The pass over the state that gives each vector its cluster among the centroids, after bounds fell by `fall`."""

    def step(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                before = batch["cluster"].to_numpy()
                lower = batch["lower"].to_numpy() - np.where(before >= 0, fall[np.maximum(before, 0)], 0)
                now = assign(matrix(batch["v"]), centroids, before, lower)
                kinds = (pa.int32(), pa.int64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], *map(pa.array, now, kinds)], ["vec_id", "v", "cluster", "distance", "lower", "scanned"])

    return step


def oracle_sql(k: int = K, dim: int = DIM, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, every vector compared with every centroid in every round."""
    near = "SELECT vec_id, v, arg_min(cluster, struct_pack(d := d, c := cluster)) AS cluster, min(d) AS distance FROM (SELECT p.vec_id, p.v, c.cluster, CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM points p, c{n} c) GROUP BY vec_id, v"
    mean = "SELECT c.cluster, CASE WHEN m.v IS NULL THEN c.v ELSE m.v END AS v FROM c{n} c LEFT JOIN (SELECT cluster, list(s ORDER BY i) AS v FROM (SELECT cluster, i, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS s FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = c.cluster"
    parts = [
        f"points AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INT) AS cluster, v FROM points ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for n in range(rounds + 1):
        parts.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        if n < rounds:
            parts.append(f"c{n + 1} AS MATERIALIZED ({mean.format(n=n)})")
    return f"WITH {', '.join(parts)} SELECT a.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"
