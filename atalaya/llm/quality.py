"""Quality by nearest-neighbour voting in a latent-semantic space.

Terms are hashed: words, character-class grams (how a text is typed, whatever its language), runs of punctuation,
repeated words and bands of simple ratios. Document frequencies come from one pass over all documents. A bounded sample of labelled
training rows (SAMPLE, taken by a hash of doc_id) gives the space (the top eigenvectors of its weighted terms) and the
labelled vectors, at most SAMPLE x DIMS numbers, which bounds the broadcast. Every document's cosines with all labelled
vectors are exact products of blocks; the K nearest vote with their similarity as weight.

Defined results: null and empty texts have no terms and score the sample's mean label; without labelled rows every score
is 0.5; among neighbours of equal similarity (to five decimals) those with the lower hash order count; rows with a null label or doc_id are
not learned from, and a doc_id labelled twice counts with its mean; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import batches, held_out
from ._words import U, words

#: Labelled rows in the sample at most.
SAMPLE = 4096
DIMS = 48
K = 25
CUT = 0.3
_GRAMS, _BANDS, _WORDS = 1024, 16, 1024
TERMS = _GRAMS + 8 * _BANDS + _WORDS
#: A word's weight beside a gram's.
_WORD_WEIGHT = 0.5

#: Classes of bytes: letters by case, digits, space, line ends; other bytes stand for themselves.
_CLASS = np.arange(256, dtype=np.uint32)
_CLASS[97:123], _CLASS[128:], _CLASS[65:91], _CLASS[48:58] = 97, 97, 65, 48
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Weights of the terms of each text (texts x TERMS), with logarithmic counts."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), np.float32)
    classes = _CLASS[data]
    w = words(data, offsets)
    same = np.zeros(len(w.hashes) + 1, np.int64)
    same[1:-1] = np.cumsum(w.hashes[1:] == w.hashes[:-1]) if len(w.hashes) else 0
    same[-1] = same[-2] if len(same) > 1 else 0
    word, grams = ((w.hashes >> U(20)) % U(_WORDS)).astype(np.int64), []
    for size in (2, 4):
        h = np.zeros(max(0, len(classes) - size + 1), np.uint32)
        for k in range(size):
            h += classes[k : k + len(h)] * _FACTORS[k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D + 2 * size)
        grams.append(((h >> np.uint32(12)) % np.uint32(_GRAMS)).astype(np.int64))
    kinds = [np.concatenate([[0], np.cumsum(classes == c)]) for c in (65, 97, 48, 32, 10)]
    for i in range(n):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if b == a:
            continue
        for size, g in zip((2, 4), grams, strict=True):
            if b - a >= size:
                out[i, :_GRAMS] += np.bincount(g[a : b - size + 1], minlength=_GRAMS)
        out[i, :_GRAMS] = np.log1p(out[i, :_GRAMS] * (1000 / (b - a)))
        first, end = w.bounds[i], w.bounds[i + 1]
        m = max(1, end - first)
        out[i, -_WORDS:] = _WORD_WEIGHT * np.log1p(np.bincount(word[first:end], minlength=_WORDS) * (1000 / (b - a)))
        upper, lower, digit, space, line = ((k[b] - k[a]) / (b - a) for k in kinds)
        ratios = (
            upper, digit, max(0.0, 1 - upper - lower - digit - space - line), len(np.unique(w.hashes[first:end])) / m,
            (same[max(first, end - 1)] - same[first]) / m, min(1.0, line * 20), min(1.0, (b - a) / m / 20), min(1.0, np.log1p(m) / 12),
        )
        for k, x in enumerate(ratios):
            out[i, _GRAMS + k * _BANDS + min(_BANDS - 1, int(x * _BANDS))] = 4.0
    return out


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each term stands, and the number of documents, over all of them."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(TERMS + 1, np.int64)
        for part, data, offsets in batches(rows, 1 << 20):
            sums[:-1] += (term_counts(data, offsets) > 0).sum(0)
            sums[-1] += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1, dtype=np.int32)), pa.array(sums)], names=["term", "n"])

    got = _text(docs).select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(TERMS + 1, np.int64)
    sums[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return sums[:-1], int(sums[-1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def top_axes(x: np.ndarray, k: int, rounds: int = 40) -> np.ndarray:
    """The k directions in which the rows of x vary most, by subspace iteration from a fixed start."""
    square = (x.T @ x).astype(np.float64)
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(x.shape[1], k + 16)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(square @ q)[0]
    values, turn = np.linalg.eigh(q.T @ square @ q)
    return (q @ turn[:, ::-1][:, :k]).astype(np.float32)


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Where the k largest values of each row are; of equal ones the first."""
    n = near.shape[1]
    if n <= k:
        return np.ones_like(near, bool)
    least = np.partition(near, n - k, axis=1)[:, n - k : n - k + 1]
    above, equal = near > least, near == least
    return above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)))


class Voters:
    """Term weights, the latent space and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, df: np.ndarray, n: int) -> None:
        self.idf = np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.1)
        self.mean = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        x = _unit(counts * self.idf)
        self.centre = x.mean(0) if len(x) else np.zeros(TERMS, np.float32)
        self.axes = top_axes(x - self.centre, DIMS)
        self.vectors = _unit((x - self.centre) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Votes of the K nearest for each text; the mean label for texts without terms."""
        out = np.full(len(counts), self.mean)
        some = np.flatnonzero(counts.any(1))
        if not len(self.vectors) or not len(some):
            return out
        for rows in np.array_split(some, max(1, len(some) // 512)):
            near = np.round(_unit((_unit(counts[rows] * self.idf) - self.centre) @ self.axes) @ self.vectors.T, 5)
            weight = np.where(nearest(near, K), np.maximum(near, 1e-6) ** 4, 0).astype(np.float64)
            out[rows] = weight @ self.labels / weight.sum(1)
        return out


def train(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Voters:
    """Voters from at most SAMPLE labelled training rows and the frequencies of all documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("double").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(SAMPLE)

    def counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in batches(rows, 1 << 20):
            found = term_counts(data, offsets).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "label", "terms"])

    # SAMPLE rows bound the broadcast; a doc_id that several documents share is learned from once.
    joined = _text(docs).join(F.broadcast(chosen), "doc_id").mapInArrow(counts, "doc_id long, label double, terms binary")
    got = joined.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("terms").alias("terms")).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").toArrow()
    df, n = document_frequencies(docs)
    terms = np.frombuffer(b"".join(got.column("terms").to_pylist()), np.float16).reshape(-1, TERMS).astype(np.float32)
    return Voters(terms, got.column("label").to_numpy(), df, n)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= CUT) of each document; see the module."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in batches(rows, 1 << 20):
            score = np.clip(shared.value.score(term_counts(data, offsets)), 0, 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return _text(docs).withColumn("held_out", held_out(F.col("doc_id"))).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
