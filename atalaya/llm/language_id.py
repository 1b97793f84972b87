"""Language ID by mixture inference: expectation-maximisation over words, language sets by penalised likelihood.

Training counts hashed 4-byte grams of letters and word borders for each language, in one pass over all training rows;
the model is BUCKETS numbers a language, which bounds what is collected and broadcast. A word's likelihood under a
language is that of its grams. For each document EM estimates the proportions of all languages; then the nested sets of
its most likely languages (one, two, ...) are fitted again, and the set with the best likelihood less half a log of the
number of words for each further language gives the result.

Defined results: a null text, or one without a letter, is `und` with score 0, as is everything where no training row has
a language; ties go to the language first by name; repeated rows are judged alike; very long texts are read in whole.
lang is read from training rows only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import DOC_COLUMNS, batches, held_out

BUCKETS = 1 << 16
GRAM = 4
ROUNDS = 12
#: Bytes of text in hand at once: the arrays by byte and language stay at some dozens of MB a task.
PIECE = 1 << 20

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[[b for b in range(128) if not chr(b).isalpha()]] = 32
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the gram at each letter or word border of the texts, the first gram of each word, words before each text.

    Each text is led by a border, and a gram belongs to the word that it starts in; grams reach over the next border.
    """
    n = len(offsets) - 1
    flat = np.full(len(data) + n + GRAM, 32, np.uint8)
    starts = offsets[:-1] + np.arange(n)
    if len(data):
        flat[np.arange(1, len(data) + 1) + np.repeat(np.arange(n), np.diff(offsets))] = _CLASS[data]
    letter = flat != 32
    size = len(flat) - GRAM
    used = letter[:size] | letter[1 : size + 1]  # a border counts where a word follows it
    h = np.zeros(size, np.uint32)
    for k in range(GRAM):
        h += flat[k : k + size] * _FACTORS[k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    buckets = (h >> np.uint32(16))[used]
    border = (~letter[:size])[used]
    firsts = np.flatnonzero(border)
    at = np.append(np.flatnonzero(used)[firsts], size)
    return buckets, firsts, np.searchsorted(at[:-1], np.append(starts, size))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities of buckets (languages x BUCKETS), from rows that are not held out."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part, data, offsets in batches(rows, PIECE):
            buckets, firsts, words = _grams(data, offsets)
            ends = np.append(firsts, len(buckets))[words]
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                own = np.concatenate([buckets[ends[i] : ends[i + 1]] for i in np.flatnonzero(langs == lang)])
                sums[lang] = sums.get(lang, 0) + np.bincount(own, minlength=BUCKETS)
        for lang, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(x[at].astype(np.int64))], names=["lang", "bucket", "n"])

    used = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    used = used.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    got = used.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS))
    if langs:
        counts[np.searchsorted(langs, got.column("lang").to_pylist()), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    counts += 0.5
    return langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def _fit(like: np.ndarray, starts: np.ndarray, owner: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the allowed languages (texts x languages) and each text's log likelihood, up to a constant."""
    sizes = np.diff(np.append(starts, len(like)))[:, None]
    share = allowed / allowed.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        x = like * share[owner]
        x /= np.maximum(x.sum(1, keepdims=True), 1e-30)
        share = np.add.reduceat(x, starts) / sizes
    return share, np.add.reduceat(np.log(np.maximum((like * share[owner]).sum(1), 1e-30)), starts)


def infer(model: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the selected languages (texts x languages; zero without words) and a confidence 0 to 1."""
    n, k = len(offsets) - 1, len(model)
    shares, sure = np.zeros((n, k)), np.zeros(n)
    buckets, firsts, words = _grams(data, offsets)
    full = np.flatnonzero(np.diff(words) > 0)
    if not len(full) or not k:
        return shares, sure
    logs = np.add.reduceat(model[:, buckets], firsts, axis=1).T.astype(np.float64)
    logs -= logs.max(1, keepdims=True)
    like = np.maximum(np.exp(logs), 1e-12)
    starts = words[full]
    sizes = np.diff(words)[full]
    owner = np.repeat(np.arange(len(full)), sizes)
    share, _ = _fit(like, starts, owner, np.ones((len(full), k)))
    total = np.add.reduceat(np.log(like), starts)
    best = total.argmax(1)
    chosen, score = np.eye(k)[best], total.max(1)
    post = np.exp(total - total.max(1, keepdims=True))
    certain = 1 / post.sum(1)
    order = np.argsort(-share, axis=1, kind="stable")
    mixed = np.flatnonzero(np.sort(share, axis=1)[:, -2] > 0.01) if k > 1 else np.zeros(0, int)
    if len(mixed):
        inside = np.isin(owner, mixed)
        sub, sub_sizes = like[inside], sizes[mixed]
        sub_starts = np.cumsum(sub_sizes) - sub_sizes
        sub_owner = np.repeat(np.arange(len(mixed)), sub_sizes)
        for m in range(2, k + 1):
            allowed = np.zeros((len(mixed), k))
            np.put_along_axis(allowed, order[mixed, :m], 1, 1)
            got, ll = _fit(sub, sub_starts, sub_owner, allowed)
            ll -= (m - 1) * 0.5 * np.log(sub_sizes + 1)
            better = ll > score[mixed]
            score[mixed[better]], chosen[mixed[better]] = ll[better], got[better]
            certain[mixed[better]] = 1
    shares[full], sure[full] = chosen, certain
    return shares, sure


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture of each document; see the module.

    score: the share of lang_pred, times its posterior where one language is selected. mixture: shares above 0.5 percent.
    """
    langs, logs = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    flat = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in batches(rows, PIECE):
            shares, sure = infer(shared.value, data, offsets)
            known = (shares.sum(1) > 0) & np.array(part.column("has_letter").to_pylist(), bool) if langs else np.zeros(part.num_rows, bool)
            top = shares.argmax(1) if langs else np.zeros(part.num_rows, int)
            score = np.where(known, (shares.max(1) if langs else 0) * sure, 0.0)
            mixture = [",".join(f"{langs[j]}:{row[j]:.3f}" for j in np.argsort(-row, kind="stable") if row[j] > 0.005) if ok else "" for row, ok in zip(shares, known, strict=True)]
            pred = [langs[t] if ok else "und" for t, ok in zip(top.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(mixture, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "mixture"])

    with_letter = flat.withColumn("has_letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return with_letter.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, mixture string")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose languages are found, one or several: all but those that identify() calls und."""
    langs, logs = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    flat = docs.select(*DOC_COLUMNS)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in batches(rows, PIECE):
            shares, _ = infer(shared.value, data, offsets)
            yield part.filter(pa.array(shares.sum(1) > 0 if langs else np.zeros(part.num_rows, bool)))

    return flat.where(F.col("text").rlike(r"\p{L}")).mapInArrow(run, flat.schema)
