"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

A bounded sample (SAMPLE rows) fits the tree; every row is then dropped down it to its leaf. For the largest inner product
vectors get one more component that brings all to the norm of the longest, so that near in the tree is large in product. A
query keeps the branches not taken in a priority queue and visits leaf after leaf from the nearest branch. How many leaves it
visits is calibrated: CALIBRATION queries are answered exactly over all rows, and visits widen until the leaves seen hold
TARGET of their neighbours (all leaves, if need be). Leaves are packed into bins of bounded size, a leaf that is too large for
one is split, and queries are sent once to each bin that has a leaf for them. The sample's own k-th score in the visited leaves goes
with a query as its floor: k rows at least are found at or above it, so bins send nothing below.

Defined results: vectors null, empty, zero, with a null or non-finite component, or not of the usual length take no part, nor
do rows without vec_id; rows that share a vec_id count as one, with the least vector; ties go to the smaller vec_id, and equal
vectors score alike to the last bit; a query with fewer candidates than k gets all; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize
from ._vectors import binned, by_bin, closest, k_means, matrix, meet, one_per_id, pack, sample, scores, sound, usual_length, widened

#: Neighbours of a query.
K = 20
#: Rows that fit the tree, children of a node, rows of the sample in a leaf at most.
SAMPLE, BRANCHES, LEAF = 16_384, 8, 48
#: Queries answered exactly to calibrate, and the share of their neighbours that the visited leaves must hold.
CALIBRATION, TARGET = 256, 0.95

FOUND = "query_id long, vec_id long, score double"


class Tree(NamedTuple):
    """Nodes in the order of a depth-first walk; a leaf has its number, other nodes -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    norm2: float


def lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    """Rows with one more component, which brings each to squared norm norm2."""
    return np.hstack([x, np.sqrt(np.maximum(norm2 - (x**2).sum(1), 0))[:, None]])


def grow(points: np.ndarray, norm2: float, branches: int = BRANCHES, leaf_rows: int = LEAF) -> Tree:
    """The tree over lifted sample points; a node whose points are few or all equal is a leaf."""
    tree, leaves = Tree([points.mean(0)], [[]], [-1], norm2), 0
    walk = [(0, points)]
    while walk:
        node, own = walk.pop()
        centres = k_means(own, branches) if len(own) > leaf_rows else own[:1]
        if len(centres) < 2:
            tree.leaf[node], leaves = leaves, leaves + 1
            continue
        of = closest(own, centres)
        for c, centre in enumerate(centres):
            tree.children[node].append(len(tree.centres))
            tree.centres.append(centre)
            tree.children.append([])
            tree.leaf.append(-1)
            walk.append((len(tree.centres) - 1, own[of == c]))
    return tree._replace(centres=np.array(tree.centres))


def leaf_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf to which each lifted point drops."""
    out, walk = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
    while walk:
        node, rows = walk.pop()
        if tree.leaf[node] >= 0:
            out[rows] = tree.leaf[node]
        elif len(rows):
            down = closest(points[rows], tree.centres[tree.children[node]])
            walk += [(child, rows[down == c]) for c, child in enumerate(tree.children[node])]
    return out


def visits(tree: Tree, away: list[float]) -> Iterator[int]:
    """Leaves in best-bin-first order; away: squared distance of the query to each node."""
    queue = [(0.0, 0)]
    while queue:
        node = heapq.heappop(queue)[1]
        while tree.leaf[node] < 0:
            first, *rest = sorted((away[c], c) for c in tree.children[node])
            for branch in rest:
                heapq.heappush(queue, branch)
            node = first[1]
        yield tree.leaf[node]


def distances(tree: Tree, queries: np.ndarray) -> list[list[float]]:
    """Squared distance, less that of the query, to every node; a query lies in the plane of the lifted component 0."""
    return ((tree.centres**2).sum(1) - 2 * queries @ tree.centres[:, :-1].T).tolist()


def best(ids: np.ndarray, x: np.ndarray, row: np.ndarray, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of the k best rows with entries from floor up; products are summed anew, row by row, so that equal vectors tie."""
    slack = 1e-12 * float(np.sqrt((query**2).sum() * (x**2).sum(1).max()))
    near = np.flatnonzero(np.isfinite(row) & (row >= floor - slack))
    if len(near) > k:
        near = near[row[near] >= np.partition(row[near], len(near) - k)[len(near) - k] - slack]
    exact = (x[near] * query).sum(1)
    order = np.lexsort((ids[near], -exact))[:k]
    return ids[near][order], exact[order]


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ranked; each task has sent k a query at most."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def exact(rows: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, unit): the k best of all rows for a bounded number of queries; one scan, k rows a query and task."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(ids[:0], np.zeros((0, queries.shape[1])), np.zeros(0, np.int32))] * len(queries)
        for batch in batches:
            x, own, unit = matrix(batch["v"]), batch["vec_id"].to_numpy(), batch["unit"].to_numpy()
            s = queries @ x.T
            for q in range(len(queries)):
                keep = np.argpartition(-s[q], min(k, len(x) - 1))[: k + 1]
                vec_id, v, u = (np.concatenate(z) for z in zip(held[q], (own[keep], x[keep], unit[keep]), strict=True))
                chosen = np.lexsort((vec_id, -(v @ queries[q])))[: k + 1]
                held[q] = vec_id[chosen], v[chosen], u[chosen]
        for q, (vec_id, v, u) in enumerate(held):
            other = vec_id != ids[q]
            if other.any():
                yield pa.RecordBatch.from_pydict({"query_id": np.full(other.sum(), ids[q]), "vec_id": vec_id[other], "score": (v[other] * queries[q]).sum(1), "unit": u[other]})

    return top(rows.mapInArrow(scan, FOUND + ", unit int"), k)


def nearest(embeddings: DataFrame, k: int = K, asks: Column | None = None, *, column: str = "embedding", target: float = TARGET, sample_rows: int = SAMPLE, leaf_rows: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score, leaves, leaves_visited: the nearest rows found for the rows where asks holds."""
    asks = F.col("vec_id") % 20 == 0 if asks is None else asks
    rows = embeddings.where(sound(F.col(column))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("v"))
    rows = rows.where(F.exists("v", lambda x: x != 0))
    rows = materialize(one_per_id(rows.where(F.size("v") == usual_length(rows, "v"))), "vectors")
    drawn = sample(rows, sample_rows)
    if not len(drawn):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, leaves int, leaves_visited int")
    norm2 = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]
    tree = grow(lifted(drawn, norm2), norm2, leaf_rows=leaf_rows)

    def drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("unit", pa.array(leaf_of(tree, lifted(matrix(batch["v"]), norm2)), pa.int32()))

    rows = materialize(rows.mapInArrow(drop, widened(rows, "unit int")), "leaves")
    sizes = np.zeros(max(tree.leaf) + 1, np.int64)
    for leaf, count in rows.groupBy("unit").count().collect():  # one row for each leaf
        sizes[leaf] = count
    width = calibrated(rows, tree, k, asks, target)
    first, blocks = pack(sizes)
    drawn_leaf = leaf_of(tree, lifted(drawn, norm2))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"bin": [], "row": [], "units": [], "floor": []}
            q = matrix(batch["v"])
            for i, away in enumerate(distances(tree, q)):
                chosen, seen = [], 0
                for n, leaf in enumerate(visits(tree, away)):
                    if n >= width and seen > k:  # enough leaves, and enough rows besides its own
                        break
                    chosen.append(leaf)
                    seen += sizes[leaf]
                own = drawn[np.isin(drawn_leaf, chosen)] @ q[i]
                floor = float(np.partition(own, len(own) - k - 1)[len(own) - k - 1]) if len(own) > k else -np.inf  # one more than k: it may be in the sample
                for at, units in by_bin(chosen, first, blocks).items():
                    out["bin"].append(at), out["row"].append(i), out["units"].append(units), out["floor"].append(floor)
            sent = batch.take(pa.array(out["row"], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(out["bin"], pa.int32()), sent["vec_id"], sent["v"], pa.array(out["units"], pa.list_(pa.int32())), pa.array(out["floor"], pa.float64())], ["bin", "query_id", "v", "units", "floor"])

    kind = dict(rows.dtypes)["v"]
    sent = materialize(rows.where(asks).select("vec_id", "v").mapInArrow(send, f"bin int, query_id long, v {kind}, units array<int>, floor double"), "visits")

    def match(_: tuple, bin_rows: pa.Table, asked: pa.Table) -> pa.Table:
        bin_rows = bin_rows.sort_by([("unit", "ascending"), ("vec_id", "ascending")])
        x, ids, unit = matrix(bin_rows["v"]), bin_rows["vec_id"].to_numpy(), bin_rows["unit"].to_numpy()
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(asked), 512):
            block = asked.slice(at, 512).combine_chunks()
            q, own, floor = matrix(block["v"]), block["query_id"].to_numpy(), block["floor"].to_numpy()
            for i, row in enumerate(scores(x, unit, q, block["units"].combine_chunks())):
                row[ids == own[i]] = -np.inf
                vec_id, score = best(ids, x, row, q[i], k, floor[i])
                parts.append((np.full(len(vec_id), own[i]), vec_id, score))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    found = top(meet(binned(rows, first, blocks), sent, match, FOUND), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", F.lit(len(sizes)).alias("leaves"), F.lit(width).alias("leaves_visited"))


def calibrated(rows: DataFrame, tree: Tree, k: int, asks: Column, target: float) -> int:
    """The fewest leaves whose rows hold the target share of the true neighbours of the calibration queries."""
    few = rows.where(asks).orderBy(F.xxhash64(F.lit(12), "vec_id"), "vec_id").limit(CALIBRATION).select("vec_id", "v").toArrow()
    if not len(few):
        return 1
    queries, ids = matrix(few["v"]), few["vec_id"].to_numpy()
    places = {int(i): {leaf: n for n, leaf in enumerate(visits(tree, away))} for i, away in zip(ids, distances(tree, queries), strict=True)}
    truth = exact(rows, queries, ids, k).select("query_id", "unit").collect()  # k rows for each calibration query
    needed = np.array([places[t.query_id][t.unit] for t in truth])
    width = 1
    while len(needed) and (needed < width).mean() < target:
        width += 1
    return width
