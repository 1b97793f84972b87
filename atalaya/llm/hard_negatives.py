"""Hard negatives over an inverted multi-index: exact windows of scores below those of the positives.

Two codebooks, one for each half of the vectors, are fitted to a bounded sample (SAMPLE rows); each pair of codes is a cell, and
every row lies in one. For an anchor the score of a half is at most its product with the code plus its norm times the code's
radius, and the bound of a cell is the sum of two of these. A heap over the two sorted half lists (multi-sequence) gives cells by
falling bound. A search goes in two waves. The first visits FIRST cells; what it finds sets a floor: the last score of a full
list, or the lower end of the window. The second goes on until the bound falls below the floor, which certifies that no cell left
can hold a better row. Positives are searched first, then the windows of all positives of an anchor at once, where cells whose
least score lies above every window are passed over.

Defined results: rows with a null vec_id, label or vector, a null or non-finite component, or not of the usual length take no
part; rows that share a vec_id count as one, the least by vector and label; ties go to the smaller vec_id; an anchor without
another row of its label has no positive and no rows; a positive with a negative score has no window; fewer than the asked
number are returned where there are fewer; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize
from ._vectors import binned, by_bin, closest, integers, k_means, matrix, meet, one_per_id, pack, sample, scores, sound, usual_length, widened

#: Positives of an anchor, negatives of a positive, and the window in hundredths of the positive's score.
POSITIVES, NEGATIVES, WINDOW = 5, 10, (30, 90)
#: Rows that fit the codebooks, codes of a half, cells of the first wave.
SAMPLE, CODES, FIRST = 16_384, 32, 24

VISIT = "bin int, query_id long, label int, v array<int>, pos array<struct<id:long,score:long>>, units array<int>"
FOUND = "query_id long, pos_id long, pos_score long, vec_id long, score long"


class Index(NamedTuple):
    """Codebooks of both halves, the radius of each code, the rows of each cell, and the bins that hold them."""

    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    sizes: np.ndarray
    first: np.ndarray
    blocks: np.ndarray


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :]


def cells(upper: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[float, int]]:
    """(bound, cell) by falling sum of two half bounds: a heap over both sorted lists, each pair entered once."""
    (a, b), width = upper, len(upper[1])
    i_of, j_of = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap = [(-(a[i_of[0]] + b[j_of[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(i_of[i]) * width + int(j_of[j])
        if j + 1 < width:
            heapq.heappush(heap, (-(a[i_of[i]] + b[j_of[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i_of[i + 1]] + b[j_of[0]]), i + 1, 0))


def plan(index: Index, anchor: np.ndarray, lo: float, hi: float, skip: int, most: int) -> list[int]:
    """Cells to visit: by falling bound while it is lo or more, those with rows and a least score of hi or less; the first `skip` were visited."""
    middle, spread = [], []
    for half, codes, radii in zip(halves(anchor[None]), index.codes, index.radii, strict=True):
        middle.append(codes @ half[0])
        spread.append(np.sqrt((half**2).sum()) * radii)
    width, out = len(index.codes[1]), []
    for bound, cell in cells((middle[0] + spread[0], middle[1] + spread[1])):
        if bound < lo or len(out) >= skip + most:
            break
        i, j = divmod(cell, width)
        if index.sizes[cell] and middle[0][i] - spread[0][i] + middle[1][j] - spread[1][j] <= hi:
            out.append(cell)
    return out[skip:]


def build(rows: DataFrame, sample_rows: int, codes: int) -> tuple[DataFrame, Index] | None:
    """rows with their cell as unit and its bin, and the index; None for an empty table."""
    drawn = sample(rows, sample_rows)
    if not len(drawn):
        return None
    books = tuple(k_means(half, codes) for half in halves(drawn))
    width = len(books[1])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                two = halves(matrix(batch["v"]))
                at = [closest(half, book) for half, book in zip(two, books, strict=True)]
                away = [np.sqrt(((half - book[c]) ** 2).sum(1)) for half, book, c in zip(two, books, at, strict=True)]
                cell = (at[0] * width + at[1]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (cell, *away))], [*batch.schema.names, "unit", "r0", "r1"])

    placed = materialize(rows.mapInArrow(place, widened(rows, "unit int, r0 double, r1 double")), "cells")
    sizes, radii = np.zeros(len(books[0]) * width, np.int64), (np.zeros(len(books[0])), np.zeros(width))
    for cell, n, r0, r1 in placed.groupBy("unit").agg(F.count("*"), F.max("r0"), F.max("r1")).collect():  # one row for each cell
        sizes[cell] = n
        for radius, code, r in ((radii[0], cell // width, r0), (radii[1], cell % width, r1)):
            radius[code] = max(radius[code], r * (1 + 1e-9) + 1e-6)
    index = Index(books, radii, sizes, *pack(sizes))
    return binned(placed.drop("r0", "r1"), index.first, index.blocks), index


def search(rows: DataFrame, index: Index, asks: DataFrame, same: bool, k: int, window: tuple[int, int]) -> DataFrame:
    """One wave: asks (query_id, label, v, pos, lo, hi, skip, most) against the cells of their plans; FOUND, k a list and bin at most."""
    low, high, whole = (n // math.gcd(*window, 100) for n in (*window, 100))

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"bin": [], "row": [], "units": []}
            limits = [batch[c].to_numpy() for c in ("lo", "hi", "skip", "most")]
            for i, anchor in enumerate(matrix(batch["v"])):
                for at, units in by_bin(plan(index, anchor, *(x[i] for x in limits)), index.first, index.blocks).items():
                    out["bin"].append(at), out["row"].append(i), out["units"].append(units)
            sent = batch.take(pa.array(out["row"], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(out["bin"], pa.int32()), *(sent[c] for c in ("query_id", "label", "v", "pos")), pa.array(out["units"], pa.list_(pa.int32()))], ["bin", "query_id", "label", "v", "pos", "units"])

    def match(_: tuple, bin_rows: pa.Table, asked: pa.Table) -> pa.Table:
        bin_rows = bin_rows.sort_by([("unit", "ascending"), ("vec_id", "ascending")])
        x, ids, unit, labels = matrix(bin_rows["v"]), *(bin_rows[c].to_numpy() for c in ("vec_id", "unit", "label"))
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 5]
        for at in range(0, len(asked), 512):
            block = asked.slice(at, 512).combine_chunks()
            own, label, lists = block["query_id"].to_numpy(), block["label"].to_numpy(), block["pos"].to_pylist()
            q = matrix(block["v"])
            for i, (seen, row) in enumerate(zip(*products(x, unit, q, block["units"].combine_chunks()), strict=True)):
                near = np.flatnonzero(seen & (ids != own[i]) & ((labels == label[i]) == same))
                score = row[near]
                order = np.lexsort((ids[near], -score))
                near, score = near[order], score[order]
                if same:
                    keep = slice(0, k)
                    found.append((np.full(len(score[keep]), own[i]), np.zeros(len(score[keep]), np.int64), np.zeros(len(score[keep]), np.int64), ids[near[keep]], score[keep]))
                    continue
                for positive in lists[i]:
                    p = positive["score"]
                    keep = np.flatnonzero((low * p <= whole * score) & (whole * score <= high * p))[:k]
                    found.append((np.full(len(keep), own[i]), np.full(len(keep), positive["id"]), np.full(len(keep), p), ids[near[keep]], score[keep]))
        return pa.table(dict(zip(("query_id", "pos_id", "pos_score", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    sent = materialize(asks.select("query_id", "label", "v", "pos", "lo", "hi", "skip", "most").mapInArrow(send, VISIT), "visits")
    return materialize(meet(rows, sent, match, FOUND), "found")


def products(x: np.ndarray, unit: np.ndarray, queries: np.ndarray, wanted: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each query visits (queries by rows), and the exact integer products; too large for exact doubles, they are taken as integers."""
    table = scores(x, unit, queries, wanted)
    seen, largest = np.isfinite(table), max(np.abs(x).max(initial=0), np.abs(queries).max(initial=0))
    if largest**2 * x.shape[1] < 2**52:
        return seen, np.rint(np.where(seen, table, 0)).astype(np.int64)
    return seen, queries.astype(np.int64) @ x.astype(np.int64).T


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id", "pos_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(embeddings: DataFrame, anchors: Column | None = None, *, column: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, sample_rows: int = SAMPLE, codes: int = CODES, first: int = FIRST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, label, vector) where anchors holds."""
    anchors = F.col("vec_id") % 100 == 0 if anchors is None else anchors
    rows = embeddings.where(sound(F.col(column)) & F.col("label").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col(column)).alias("v"), F.col("label").cast("int").alias("label"))
    rows = materialize(one_per_id(rows.where(F.size("v") == usual_length(rows, "v"))), "vectors")
    built = build(rows, sample_rows, codes)
    if built is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows, index = built
    asks = rows.where(anchors).select(F.col("vec_id").alias("query_id"), "label", "v")

    def limits(df: DataFrame, lo: Column, hi: Column, skip: int, most: int) -> DataFrame:
        return df.withColumns({"lo": lo.cast("double"), "hi": hi.cast("double"), "skip": F.lit(skip), "most": F.lit(most)})

    lowest, highest, every = F.lit(float("-inf")), F.lit(float("inf")), len(index.sizes)
    none = F.array().cast("array<struct<id:long,score:long>>")
    wave = search(rows, index, limits(asks.withColumn("pos", none), lowest, highest, 0, first), True, positives, window)
    full = _top(wave, positives).groupBy("query_id").agg(F.when(F.count("*") == positives, F.min("score")).alias("floor"))
    again = limits(asks.join(full, "query_id", "left").withColumn("pos", none), F.coalesce("floor", lowest), highest, first, every)
    best = _top(wave.unionAll(search(rows, index, again, True, positives, window)), positives)

    lists = best.where("score >= 0").groupBy("query_id").agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "score")).alias("pos"))  # `positives` at most
    asks = materialize(asks.join(lists, "query_id"), "positives")
    least, most = F.array_min(F.transform("pos", lambda p: p.score)), F.array_max(F.transform("pos", lambda p: p.score))
    bottom, roof = least * window[0] / 100 - 1e-6, most * window[1] / 100 + 1e-6
    wave = search(rows, index, limits(asks, bottom, roof, 0, first), False, negatives, window)
    full = _top(wave, negatives).groupBy("query_id", "pos_id").agg(F.when(F.count("*") == negatives, F.min("score")).alias("floor"))
    wanted = asks.select("query_id", F.explode("pos").alias("p")).select("query_id", F.col("p.id").alias("pos_id"), (F.col("p.score") * window[0] / 100 - 1e-6).alias("bottom"))
    floors = wanted.join(full, ["query_id", "pos_id"], "left").groupBy("query_id").agg(F.min(F.coalesce("floor", "bottom")).alias("floor"))
    again = limits(asks.join(floors, "query_id"), F.col("floor"), roof, first, every)
    out = _top(wave.unionAll(search(rows, index, again, False, negatives, window)), negatives)
    return out.select(F.col("query_id").alias("anchor_id"), F.col("pos_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("pos_score").alias("positive_score"), F.col("score").alias("negative_score"))


#: Every anchor compared with every row.
ORACLE_SQL = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND {WINDOW[0]} * p.positive_score <= 100 * s.score AND 100 * s.score <= {WINDOW[1]} * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= {NEGATIVES}
"""
