"""Language ID, quality voting and decontamination: held-out accuracy and brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from atalaya.llm import decontamination, language_id, quality
from tests.llm.test_dedup import shingle_set, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    by = {x: " ".join(r.text for r in docs.where(f"lang = '{x}'").limit(5).collect())[:6000] for x in ("en", "de")}
    rows = [(1, by["en"] + " " + by["de"]), (2, None), (3, ""), (4, "### 123 !!"), (5, by["de"])]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    shares = dict(x.split(":") for x in got[1].mixture.split(","))
    assert set(shares) >= {"en", "de"}
    assert 0.3 < float(shares["en"]) < 0.7
    assert [got[i].lang_pred for i in (2, 3, 4, 5)] == ["und", "und", "und", "de"]
    assert got[2].score == 0


def test_language_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert language_id.identify(empty).count() == 0
    untaught = spark.createDataFrame([(1, "some words", None, "s", 10), (None, "x", None, None, None)], DOCS)
    assert {r.lang_pred for r in language_id.identify(untaught).collect()} == {"und"}
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(["some english words", "", None, "123"] * 5)], DOCS)
    assert {r.text for r in language_id.keep_identified(docs).collect()} == {"some english words"}


def test_language_keeps_even_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    langs = sorted(r.lang for r in docs.select("lang").distinct().collect() if r.lang)
    by = {x: " ".join(r.text for r in docs.where(f"lang = '{x}' AND n_chars > 500").limit(5).collect())[:3000] for x in langs}
    mixed = [(900_001, " ".join(by[x] for x in langs[:3]), None, "s", 9000), (900_002, " ".join(by[x] for x in langs[:4]), None, "s", 12000), (900_003, "123 !", None, "s", 5)]
    kept = language_id.keep_identified(docs.unionAll(spark.createDataFrame(mixed, docs.schema))).where("doc_id > 900000").collect()
    assert sorted(r.doc_id for r in kept) == [900_001, 900_002]


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.score_quality(spark.read.parquet(f"{d}/documents.parquet"), labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 1000
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    good, bad = ([r.score for r in held if truth[r.doc_id] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, None, "z"), (3, "", "w"), (4, "x" * 100_000, "v")], "doc_id long, text string, label string")
    assert quality.score_quality(docs, labels).count() == 5
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs.limit(0), labels).count() == 0


def test_votes_against_brute_force():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 3, (60, quality.TERMS)).astype(np.float32)
    counts[10:40] = counts[10]  # thirty ties
    labels = rng.integers(0, 2, 60).astype(float)
    voters = quality.Voters(counts, labels, (counts > 0).sum(0), 60)
    got = voters.score(counts[:20])
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    for i in range(20):
        v = unit((unit(counts[i] * voters.idf) - voters.centre) @ voters.axes)
        near = np.round((v[None].astype(np.float32) @ voters.vectors.T)[0], 5)
        first = sorted(range(60), key=lambda j: (-near[j], j))[: quality.K]
        w = np.array([max(near[j], 1e-6) ** 4 for j in first])
        assert abs(got[i] - (w * labels[first]).sum() / w.sum()) < 1e-3
    tied = quality.nearest(np.array([[0.5] * 8 + [0.9, 0.1]]), 4)
    assert tied.tolist() == [[True, True, True, False, False, False, False, False, True, False]]
    top = quality.top_axes(counts - counts.mean(0), 5)
    exact = np.linalg.svd(counts - counts.mean(0), full_matrices=False)[2][:5]
    assert np.abs(np.linalg.svd(top.T @ exact.T)[1] - 1).max() < 1e-3


def test_mixture_against_plain_em():
    rng = np.random.default_rng(4)
    like = rng.random((40, 3)) + 0.05
    starts, owner = np.array([0, 15]), np.repeat([0, 1], [15, 25])
    got, ll = language_id._fit(like, starts, owner, np.ones((2, 3)))
    for k, rows in enumerate((like[:15], like[15:])):
        share = np.full(3, 1 / 3)
        for _ in range(language_id.ROUNDS):
            share = np.mean([share * x / (share * x).sum() for x in rows], axis=0)
        assert np.allclose(got[k], share)
        assert np.isclose(ll[k], np.log(rows @ share).sum())


def brute_items(text, items):
    """Items that some window of their size matches by weighted shingles."""
    held = {}
    for x in items.values():
        for s in shingle_set(x):
            held[s] = held.get(s, 0) + 1
    weight = lambda xs: sum(np.log1p(len(items) / held[s]) if s in held else np.log1p(len(items)) for s in xs)
    out, w = [], words_of(text)
    for i, x in items.items():
        n = len(words_of(x))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            a, b = shingle_set(" ".join(w[k : k + n])), shingle_set(x)
            if a and b and weight(a & b) >= (0.75 - 1e-9) * (weight(b) + np.log1p(len(items)) * len(a - b)):
                out.append(i)
                break
    return sorted(out)


@pytest.mark.parametrize("block", [20_000, 7])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "ITEMS", block)
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(500)]
    make = lambda k: " ".join(rng.choices(vocabulary, k=k))
    items = {i: make(rng.randint(14, 50)) for i in range(30)} | {30: "two words", 31: make(5), 32: make(40)}
    items[33] = items[32]
    texts = [None, "", " ", "x two  Words y", items[31], " ".join(items[5].split()[:-2])]
    for _ in range(120):
        w = items[rng.randrange(34)].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.choice([0, 1, -1, rng.randrange(len(w))])] = rng.choice(vocabulary)
        texts.append(make(rng.randint(0, 60)) + "\n" + " ".join(w) + " " + make(rng.randint(0, 60)))
        texts.append(make(80))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    benchmark = spark.createDataFrame([*items.items(), (None, "x"), (99, None), (98, "  ")], "item_id long, text string")
    got = {r.doc_id: r for r in decontamination.find_contaminated(docs, benchmark).collect()}
    want = {i: brute_items(t or "", items) for i, t in enumerate(texts)}
    assert {i: list(r.items) for i, r in got.items()} == want
    assert all(r.contaminated == bool(r.items) for r in got.values())
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, benchmark).collect()) == [i for i in want if not want[i]]
    assert decontamination.find_contaminated(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert decontamination.find_contaminated(docs.limit(0), benchmark).count() == 0


def test_edge_cuts_stay_within_the_radius():
    rng = np.random.default_rng(6)
    for size in (18, 25, 39, 60, 102):
        cut = (size - 4) // 7  # of size - 4 shingles 6/7 are left: a similarity of 0.75
        item = rng.integers(0, 1 << 64, (4000, size), np.uint64)
        window = np.concatenate([item[:, cut:], rng.integers(0, 1 << 64, (4000, cut), np.uint64)], 1)
        far = np.bitwise_count(decontamination.simhash(item) ^ decontamination.simhash(window))
        assert far.max() <= decontamination.RADIUS, size


def test_blocks_of_items_change_nothing(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
    common = " ".join(rng.choices(vocabulary, k=9))
    items = [(i, f"{common} {' '.join(rng.choices(vocabulary, k=24))}") for i in range(20)]
    texts = [(i, " ".join([*t.split()[: 33 - i % 4], "x y z"])) for i, t in items]
    docs, benchmark = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = []
    for size in (20_000, 3):
        monkeypatch.setattr(decontamination, "ITEMS", size)
        got.append(sorted((r.doc_id, list(r["items"]), round(r.similarity, 9)) for r in decontamination.find_contaminated(docs, benchmark).collect()))
    assert got[0] == got[1]
    assert any(x[1] for x in got[0])


def test_hamming_index_misses_none():
    prints = np.random.default_rng(1).integers(0, 1 << 63, 60, np.uint64)
    noise = np.array([sum(1 << int(b) for b in np.random.default_rng(i).choice(64, i % 24, replace=False)) for i in range(200)], np.uint64)
    wanted = prints[np.arange(200) % 60] ^ noise
    index = decontamination.HammingIndex(prints, 16)
    got = set(zip(*(x.tolist() for x in index.near(wanted)), strict=True))
    assert got == {(i, j) for i in range(200) for j in range(60) if (int(wanted[i]) ^ int(prints[j])).bit_count() <= 16}


@pytest.mark.parametrize("kind", [T.StringType()])
def test_types(spark, kind):
    assert language_id.identify(spark.createDataFrame([(1, None)], T.StructType([T.StructField("doc_id", T.IntegerType()), T.StructField("text", kind)])).selectExpr("doc_id", "text", "cast(null AS string) AS lang")).count() == 1
