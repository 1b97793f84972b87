"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

A window is as many words as an item has. Windows without any word shingle of the benchmark have similarity 0 to all
items, so only those that hold one are fingerprinted: each shared shingle, at the place it has in an item, fixes a window.
The 64-bit SimHash of a window's words is looked up among items of its length: fingerprints within RADIUS differ in at
most RADIUS bits, so of RADIUS + 1 blocks at least one is equal, and the block tables miss none. Candidates are verified
by the exact weighted Jaccard similarity of their five-word shingles (items of fewer words: the whole sequence), where a
shingle of the item weighs the more, the fewer items hold it, and one that only the window has weighs most; 0.75 or more
is a match. Items that share no shingle with a text have
similarity 0 and are not verified for it.

The benchmark is cut into blocks of about ITEMS items by a hash; each block is collected, broadcast and searched for in a
pass of its own, so what a task holds is bounded. In how many items a shingle is, is counted by Spark over all of them, so a
pair's similarity is the same however the benchmark is cut.

Defined results: null and empty texts, and items without words, match nothing; a text shorter than an item is one window;
repeated rows are searched alike; equal items all match; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import DOC_COLUMNS, batches, materialize, row_key
from ._words import U, shingles, words

SHINGLE = 5
LEAST = 0.75
#: Twice the distance expected of an item without a seventh of its words, and over four deviations beyond it.
RADIUS = 24
#: Items of one pass at most.
ITEMS = 20_000
_FILTER = 1 << 22
#: Pairs of fingerprints compared at once, per block.
_PAIRS = 1 << 20


def simhash(rows: np.ndarray) -> np.ndarray:
    """64-bit SimHash of each row of word hashes: each bit is that of the majority of words."""
    out = np.empty(len(rows), U)
    step = max(1, (1 << 20) // max(1, rows.shape[1]))
    for i in range(0, len(rows), step):
        part = np.ascontiguousarray(rows[i : i + step])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1, 8), axis=2)
        out[i : i + step] = np.packbits(2 * bits.sum(1, dtype=np.int32) > rows.shape[1], axis=1).view(U)[:, 0]
    return out


def block_values(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    """The radius + 1 blocks of bits of fingerprints; two within the radius agree in one at least."""
    edges = np.linspace(0, 64, radius + 2).astype(int)
    return [(prints >> U(a)) & U((1 << (b - a)) - 1) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


class HammingIndex:
    """Fingerprints in block tables; near() finds all within the radius."""

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius = prints, radius
        self.tables = []
        for values in block_values(prints, radius):
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], order))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in prints, place in the index) within the radius, each once."""
        step = max(1, _PAIRS // max(1, len(self.prints)))
        parts = [self._near(prints[i : i + step], i) for i in range(0, len(prints), step)]
        pairs = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))

    def _near(self, prints: np.ndarray, start: int) -> np.ndarray:
        found = []
        for (values, order), wanted in zip(self.tables, block_values(prints, self.radius), strict=True):
            lo, hi = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
            n = hi - lo
            left = np.repeat(np.arange(len(prints)), n)
            right = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)]
            close = np.bitwise_count(prints[left] ^ self.prints[right]) <= self.radius
            found.append((left[close] + start) * len(self.prints) + right[close])
        return np.unique(np.concatenate(found))


def _item_words(items: list[tuple[int, str]]) -> list[tuple[int, np.ndarray]]:
    """(item_id, hashes of its words) of the items that have words."""
    raw = [x.encode() for _, x in items]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    w = words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    spans = [(int(a), int(b)) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    return [(items[k][0], w.hashes[a:b]) for k, (a, b) in enumerate(spans) if b > a]


class Benchmark:
    """Items' shingles with their places and weights, and fingerprints by number of words.

    held: in how many of all total items each shingle is; one that is not named is in one.
    """

    def __init__(self, items: list[tuple[int, str]], held: dict[int, int], total: int) -> None:
        kept = _item_words(items)
        self.top = float(np.log1p(total)) or 1.0
        self.ids = [i for i, _ in kept]
        self.hashes = [x for _, x in kept]
        self.sizes = np.array([len(x) for x in self.hashes], np.int64)
        runs = [shingles(x, min(SHINGLE, len(x))) for x in self.hashes]
        self.sets = [np.unique(x) for x in runs]
        self.weights = [np.log1p(total / np.array([held.get(k, 1) for k in x.view(np.int64).tolist()])) for x in self.sets]
        self.widths = sorted({min(SHINGLE, int(n)) for n in self.sizes})
        owner = np.repeat(np.arange(len(runs)), [len(x) for x in runs])
        place = np.concatenate([np.arange(len(x)) for x in runs]) if runs else np.zeros(0, np.int64)
        flat = np.concatenate(runs) if runs else np.zeros(0, U)
        order = np.argsort(flat, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.last = np.append(self.first[1:], len(flat))
        self.maybe = np.zeros(_FILTER, bool)
        self.maybe[self.keys & U(_FILTER - 1)] = True
        self.by_size = {}
        for n in np.unique(self.sizes).tolist():
            own = np.flatnonzero(self.sizes == n)
            self.by_size[n] = (own, HammingIndex(simhash(np.stack([self.hashes[k] for k in own])), RADIUS))

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window of words and an item; shingles that the item lacks weigh most."""
        a, b, weights = np.unique(shingles(window, min(SHINGLE, len(window), int(self.sizes[item])))), self.sets[item], self.weights[item]
        both = np.isin(b, a, assume_unique=True)
        return float(weights[both].sum() / (weights.sum() + self.top * (len(a) - np.count_nonzero(both))))

    def windows(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, words, text) of the windows that a shared shingle fixes, each once; text * items + item that share one."""
        out, shared = [], []
        for width in self.widths:
            runs = shingles(hashes, width)
            at = np.flatnonzero(self.maybe[runs & U(_FILTER - 1)])
            key = np.minimum(np.searchsorted(self.keys, runs[at]), len(self.keys) - 1)
            at, key = at[self.keys[key] == runs[at]], key[self.keys[key] == runs[at]]
            n = self.last[key] - self.first[key]
            post = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[key], n)
            at = np.repeat(at, n)
            size = self.sizes[self.owner[post]]
            right = np.minimum(size, SHINGLE) == width
            at, post, size = at[right], post[right], size[right]
            text = np.searchsorted(bounds, at, "right") - 1
            lo, hi = bounds[text], bounds[text + 1]
            whole = at + width <= hi  # the shingle does not reach into the next text
            first = np.clip(at - self.place[post], lo, np.maximum(lo, hi - size))
            out.append(np.stack([first, size, text], 1)[whole])
            shared.append((text * len(self.ids) + self.owner[post])[whole])
        return np.unique(np.concatenate(out), axis=0), np.unique(np.concatenate(shared))

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[dict[int, float]]:
        """For each text the items that match and their best similarity."""
        found: list[dict[int, float]] = [{} for _ in range(len(offsets) - 1)]
        if not self.ids:
            return found
        w = words(data, offsets)
        windows, shared = self.windows(w.hashes, w.bounds)
        for n in np.unique(windows[:, 1]).tolist():
            own, index = self.by_size[n]
            part = windows[windows[:, 1] == n]
            room = w.bounds[part[:, 2] + 1] - part[:, 0]
            for size in np.unique(np.minimum(room, n)).tolist():  # less than n only where the text is shorter
                rows = part[np.minimum(room, n) == size]
                prints = simhash(w.hashes[rows[:, 0][:, None] + np.arange(size)])
                near, items = index.near(prints)
                sharing = np.isin(rows[near, 2] * len(self.ids) + own[items], shared)
                for k, item in zip(near[sharing], items[sharing], strict=True):
                    first, _, text = rows[k].tolist()
                    got = self.similarity(w.hashes[first : first + size], int(own[item]))
                    if got >= LEAST - 1e-9:  # sums of weights may round an exact 0.75 down
                        name = self.ids[own[item]]
                        found[text][name] = max(got, found[text].get(name, 0.0))
        return found


def _weighed(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text, block, held: the counts of its shingles that several items hold) of all items; the number of items with words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    items = items.withColumn("__item", row_key(F.col("item_id"), F.col("text"), F.monotonically_increasing_id()))

    def split(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in batches(rows):
            w = words(data, offsets)
            sets = [np.unique(shingles(w.hashes[a:b], min(SHINGLE, b - a))).view(np.int64) if b > a else np.zeros(0, np.int64) for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("item_id"), part.column("text"), part.column("__item"), pa.array(sets, pa.list_(pa.int64()))], names=["item_id", "text", "__item", "sets"])

    sets = materialize(items.mapInArrow(split, "item_id long, text string, __item long, sets array<long>").where("size(sets) > 0"), "items")
    total = sets.count()
    rows = sets.select("__item", F.explode("sets").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    held = rows.join(shared, "shingle").groupBy("__item").agg(F.collect_list(F.struct("shingle", "n")).alias("held"))  # of one item
    block = F.pmod(F.xxhash64("__item"), F.lit(max(1, -(-total // ITEMS)))).cast("int")
    return materialize(sets.join(held, "__item", "left").select("item_id", "text", block.alias("block"), "held"), "items"), total


def _benchmarks(benchmark: DataFrame) -> Iterator[tuple[Benchmark, bool]]:
    """The benchmark's blocks of about ITEMS items, one after the other, and whether it is the last."""
    items, total = _weighed(benchmark)
    n = max(1, -(-total // ITEMS))
    for block in range(n):
        rows = items.where(F.col("block") == block).collect()
        yield Benchmark([(r.item_id, r.text) for r in rows], {x.shingle: x.n for r in rows for x in r.held or ()}, total), block == n - 1


def find_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, items (sorted item_ids that match), similarity (the best; 0 without) of each document."""
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    now = flat.select("*", F.lit(None).cast("array<long>").alias("items"), F.lit(0.0).alias("similarity"))
    for block, last in _benchmarks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in batches(rows):
                found = shared.value.search(data, offsets)
                items = [sorted({*(old or ()), *new}) for old, new in zip(part.column("items").to_pylist(), found, strict=True)]
                best = [max([old, *new.values()]) for old, new in zip(part.column("similarity").to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(items, pa.list_(pa.int64())), pa.array(best, pa.float64())], names=["doc_id", "text", "items", "similarity"])

        now = now.mapInArrow(run, "doc_id long, text string, items array<long>, similarity double")
        if not last:  # a pass over all documents for each block
            now = materialize(now, "searched")
            shared.unpersist()
    return now.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that match no item."""
    now = docs.select(*DOC_COLUMNS)
    schema = now.schema
    for block, last in _benchmarks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in batches(rows):
                yield part.filter(pa.array([not x for x in shared.value.search(data, offsets)], pa.bool_()))

        now = now.mapInArrow(run, schema)
        if not last:
            now = materialize(now, "searched")
            shared.unpersist()
    return now
