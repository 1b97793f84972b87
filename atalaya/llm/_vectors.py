"""Helpers of the vector operators: sound vectors, bounded samples, bins of index units, and where queries meet bins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Visits of one bin that one task gets at most, about; more of them are dealt to copies of the bin.
VISITS = 1 << 16
#: Rows of a bin: a 64th of all within these bounds. They set the grain of the work and have no effect on results.
BIN_ROWS = (1 << 11, 1 << 15)
#: Largest integer component: ten sums of 64 products of these stay below 2^62.
LARGEST = 1 << 26


def sound(column: Column) -> Column:
    """Whether an array of numbers is there, and none of its components is null, NaN or infinite; false for an empty one."""
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(column.isNotNull() & (F.size(column) > 0) & fine, F.lit(False))


def integers(column: Column) -> Column:
    """floor(256 * x) of each component x as double; a component beyond LARGEST has no sum in 64 bits and ends the job."""
    whole = F.transform(column, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    wide = F.exists(column, lambda x: F.abs(x.cast("double")) * 256.0 > float(LARGEST))
    return F.when(wide, F.raise_error(F.lit(f"a component is beyond {LARGEST >> 8}"))).otherwise(whole).cast("array<int>")


def usual_length(rows: DataFrame, column: str) -> int:
    """The most frequent length of an array column, the smaller one of equals; 0 for an empty table."""
    top = rows.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return top.n if top else 0


def one_per_id(rows: DataFrame) -> DataFrame:
    """rows (vec_id, v, ...) with the least of the rows that share a vec_id; a null vec_id goes."""
    rest = [c for c in rows.columns if c != "vec_id"]
    return rows.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct(*rest)).alias("_row")).select("vec_id", "_row.*")


def widened(rows: DataFrame, more: str) -> str:
    """The schema of rows with more columns after them."""
    return ", ".join(f"{c} {kind}" for c, kind in rows.dtypes) + ", " + more


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix of doubles."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), len(flat) // max(len(column), 1))


def sample(rows: DataFrame, size: int) -> np.ndarray:
    """At most size vectors v, those whose vec_id hashes lowest: a set that does not depend on the order of rows."""
    drawn = rows.select("v", F.xxhash64(F.lit(11), "vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(size)
    return matrix(drawn.toArrow().column("v"))


def k_means(points: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most k distinct centres of points, by seeded k-means++ and Lloyd rounds; fewer where fewer points differ."""
    random = np.random.default_rng(len(points))
    centres = points[random.integers(len(points))][None]
    nearest = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < k and nearest.max() > 1e-12 * max(1.0, (points**2).sum(1).max()):
        centres = np.vstack([centres, points[random.choice(len(points), p=nearest / nearest.sum())]])
        nearest = np.minimum(nearest, ((points - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        of = closest(points, centres)
        counts = np.bincount(of, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, of, points)
        centres = sums[counts > 0] / counts[counts > 0, None]
    return centres


def closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each point."""
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


def pack(sizes: np.ndarray, bins: tuple[int, int] = BIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """first, blocks of each unit: units in order share a bin while they fit; a larger unit is split into bins of its own."""
    room = int(np.clip(sizes.sum() // 64, *bins))
    first, blocks, now, full = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), -1, room
    for unit, size in enumerate(sizes):
        blocks[unit] = max(1, -(-int(size) // room))
        if full + size > room:
            now, full = now + 1, 0
        first[unit] = now
        now, full = now + int(blocks[unit]) - 1, full + size if blocks[unit] == 1 else room
    return first, blocks


def binned(rows: DataFrame, first: np.ndarray, blocks: np.ndarray) -> DataFrame:
    """rows (unit, vec_id, ...) with their bin; the table of units is as short as the index, whose size is a parameter."""
    units = rows.sparkSession.createDataFrame([(i, int(f), int(b)) for i, (f, b) in enumerate(zip(first, blocks, strict=True))], "unit int, first int, blocks int")
    at = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
    return rows.join(F.broadcast(units), "unit").withColumn("bin", at).drop("first", "blocks")


def by_bin(units: list[int], first: np.ndarray, blocks: np.ndarray) -> dict[int, list[int]]:
    """The units to visit in each bin."""
    out: dict[int, list[int]] = {}
    for unit in units:
        for at in range(first[unit], first[unit] + blocks[unit]):
            out.setdefault(int(at), []).append(int(unit))
    return out


def meet(rows: DataFrame, visits: DataFrame, match: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: StructType | str, most: int = VISITS) -> DataFrame:
    """match(key, rows of a bin, visits of it) for every bin that has visits (bin, query_id, ...).

    A task holds one bin and about `most` of its visits: a bin with more of them is copied, and its visits are dealt to the copies.
    """
    copies = visits.groupBy("bin").agg(F.ceil(F.count("*") / most).cast("int").alias("copies"))
    left = rows.join(copies, "bin").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    right = visits.join(copies, "bin").withColumn("copy", F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int")).drop("copies")
    return left.groupBy("bin", "copy").cogroup(right.groupBy("bin", "copy")).applyInArrow(match, schema)


def scores(x: np.ndarray, unit: np.ndarray, queries: np.ndarray, wanted: pa.ListArray) -> np.ndarray:
    """Inner products (queries by rows) in the units that each query visits, -inf elsewhere; x is sorted by unit."""
    out = np.full((len(queries), len(x)), -np.inf)
    flat, lengths = wanted.flatten().to_numpy(), np.diff(wanted.offsets.to_numpy())
    asks = np.repeat(np.arange(len(queries)), lengths)
    for u in np.unique(unit):
        who, a, b = asks[flat == u], *np.searchsorted(unit, [u, u + 1])
        if len(who):
            out[who, a:b] = queries[who] @ x[a:b].T
    return out
