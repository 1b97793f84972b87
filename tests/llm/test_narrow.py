"""BPE, telephony audio and URL filters: against the library, scalar coding and brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from atalaya.llm import bpe, queries, telephony, url_filters

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
WORD_BPE = queries.tokenizer("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t", "Hello World's  don't<|endoftext|>é ΑΣ 123<|startoftext|><|endoftext", "a" * 500, "İx ſ'S ́é ｆｕｌｌ ５ ²³ x\x1fy\x85z\u200b 日本語テスト 🎉🎉👍🏽 naïve ñ",
    "'s't''re I'LL we'Ve", "ΑΣ'ΣΣ", "K", "#" * 1000, "x" * 100_000, "e\u0301 e\u0301", "<|endoftext|>", "a<|endoftext|>b",
]


def random_texts(n):
    rng = random.Random(11)
    abc = "abcdeth  \n'sΣéñ0129<|>#.\u0301ﬁ日🎉"
    return ["".join(rng.choices(abc, k=rng.randint(0, 60))) for _ in range(n)]


def test_bpe_equals_library(spark, sf_dir):
    given = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts = TEXTS + random_texts(500) + given
    lib = Tokenizer.from_file(WORD_BPE)
    got = {r.doc_id: r for r in bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), SCHEMA), WORD_BPE, texts=True).collect()}
    for i, text in enumerate(texts):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids, text
        assert got[i].decoded == decoded
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_media_round_trip(spark):
    texts = TEXTS + random_texts(50) + ["x" * 192, "y" * 193]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "Twice"), (5000, "Twice")]
    got = telephony.decode_media(telephony.encode_media(spark.createDataFrame(rows, SCHEMA))).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = by_id[i]
        assert bytes(r.payload) == padded
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        samples = np.frombuffer(r.mulaw_pcm, np.int16)
        assert (samples[::2] == telephony.MULAW[np.frombuffer(padded, np.uint8)]).all()
        assert [len(r[f"{k}_pcm"]) for k in telephony.KINDS] == [4 * len(padded), 4 * len(padded), 4 * telephony.PER * (len(padded) // telephony.BLOCK)]
        assert r.feature.split(";")[0].endswith(f":{zlib.crc32(r.mulaw_pcm)}")
    assert by_id[None].feature == by_id[5000].feature


def test_adpcm_equals_scalar():
    blocks = np.random.default_rng(5).integers(0, 256, (7, telephony.BLOCK), np.uint8)
    for row, got in zip(blocks, telephony.adpcm(blocks), strict=True):
        level, index = int.from_bytes(row[:2].tobytes(), "little", signed=True), min(88, int(row[2]))
        want = [level]
        for byte in row[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = telephony.STEPS[index]
                size = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                level = max(-32768, min(32767, level - size if code & 8 else level + size))
                index = max(0, min(88, index + telephony.INDEX_CHANGE[code & 7]))
                want.append(level)
        assert got.tolist() == want


def test_companding_tables():
    # The known ends of both curves, and their symmetry.
    assert (telephony.MULAW[0], telephony.MULAW[255], telephony.MULAW[128]) == (-32124, 0, 32124)
    assert (telephony.ALAW[0x55], telephony.ALAW[0xD5], telephony.ALAW[0xAA], telephony.ALAW[0x2A]) == (-8, 8, 32256, -32256)
    assert (telephony.MULAW[:128] == -telephony.MULAW[128:]).all()


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest[: min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for a, h, p in rules if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


@pytest.mark.parametrize("rules", [url_filters.RULES, (*url_filters.RULES, ("block", "", "/x"), ("allow", "a.example.com", ""), ("block", "m", "/"), ("block", "com", "/en/5"))])
def test_url_filters(spark, sf_dir, rules):
    rng = random.Random(2)
    urls = [None, "", "no scheme", "http://", "https://COM", "http://ÉX.com/en/", "http://xcom/", "http://com", "http://example.com/en/?a://b", "a://b://c/d", "http://example.com./en/", "http://.com/", "http://a..com/en/", "http://x.example.com" + "/en/" * 5000]
    urls += ["http://" + ".".join(rng.choices(["a", "com", "net", "example", "www", "m", ""], k=rng.randint(1, 4))) + rng.choice(["", "/", "/en/", "/en/5", "/es/", "/fr/x", "?q", "#f", "/x"]) for _ in range(800)]
    rows = list(enumerate(urls)) + [(3, urls[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'z' AS host", "1 AS rule", "2 AS __key")
    got = sorted(map(tuple, url_filters.filter_urls(pages, rules).collect()), key=str)
    assert got == sorted(((i, *judged(u, rules)) for i, u in rows), key=str)
    assert url_filters.filter_urls(pages.limit(0)).count() == 0
    assert url_filters.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).count() == 50


def test_url_rules_by_blocks_and_many_paths(spark, monkeypatch):
    rules = [("block", "example.com", f"/p{i}/") for i in range(2000)] + [("allow", "example.com", f"/p{i}/a") for i in range(0, 2000, 7)] + [*url_filters.RULES]
    rows = [(i, f"http://{h}/p{i}/{t}") for i, (h, t) in enumerate(itertools.product(("www.example.com", "example.com", "a.net"), ("a", "b", "")))] + [(100 + i, f"http://example.com/p{i}/ab") for i in range(0, 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    want = sorted(((i, *judged(u, rules)) for i, u in rows), key=str)
    assert sorted(map(tuple, url_filters.filter_urls(pages, rules).collect()), key=str) == want
    monkeypatch.setattr(url_filters, "BLOCK", 700)
    assert sorted(map(tuple, url_filters.filter_urls(pages, rules).collect()), key=str) == want


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.encode_decode(empty, WORD_BPE).count() == 0
    assert telephony.decode_media(telephony.encode_media(empty)).count() == 0
    wide = spark.createDataFrame([(1, "a b")], SCHEMA).selectExpr("*", "1 AS n_tokens", "'x' AS media", "2 AS n_bytes", "'y' AS ids")
    assert bpe.encode_decode(wide, WORD_BPE).first().n_tokens == 2
    assert telephony.decode_media(telephony.encode_media(wide)).first().n_bytes == 3


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_WORDS", 40)
    monkeypatch.setattr(bpe, "KEEP_PAIRS", 30)
    enc, lib = bpe.TrieEncoder(WORD_BPE), Tokenizer.from_file(WORD_BPE)
    texts = random_texts(200)
    for i in range(0, 200, 20):
        runs = [enc.chunks(t) for t in texts[i : i + 20]]
        enc.learn(runs)
        for t, run in zip(texts[i : i + 20], runs, strict=True):
            assert " ".join(x for x in (enc.known[c][1] for c in run) if x) == " ".join(map(str, lib.encode(t, add_special_tokens=False).ids))
    enc.forget()
    assert not enc.known and not enc.words and not enc.apart


def test_resampled_pcm_by_plain_loops(spark):
    def held(x, i):
        return int(x[min(max(i, 0), len(x) - 1)])

    texts = ["", "The quick brown fox\n" * 40, "ñandú €" * 100, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stored = {r.doc_id: r for r in telephony.stored_media(docs).collect()}
    full = {r.doc_id: r for r in telephony.decode_media(telephony.encode_media(docs)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        raw += b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        x = [int(telephony.MULAW[b]) for b in raw]
        clip = lambda v: min(max(v, -32768), 32767)
        twice = [v for k in range(len(x)) for v in (x[k], clip((3 * (held(x, k - 2) + held(x, k + 3)) - 25 * (held(x, k - 1) + held(x, k + 2)) + 150 * (x[k] + held(x, k + 1)) + 128) >> 8))]
        assert np.frombuffer(full[i].mulaw_pcm, np.int16).tolist() == twice
        half = bytes((clip((256 * x[k] + 150 * (held(x, k - 1) + held(x, k + 1)) - 25 * (held(x, k - 3) + held(x, k + 3)) + 3 * (held(x, k - 5) + held(x, k + 5)) + 256) >> 9) >> 8) + 128 for k in range(0, len(x), 2))
        assert (stored[i].pcm_bytes, stored[i].pcm_sha256) == (len(x) // 2, hashlib.sha256(half).hexdigest())
        assert stored[i].feature == full[i].feature and stored[i].payload_sha256 == hashlib.sha256(raw).hexdigest()


def test_stored_media_has_the_whole_pcm_of_all_expansions(spark):
    def doubled(x):
        held = lambda i: x[min(max(i, 0), len(x) - 1)]
        mid = lambda k: (3 * (held(k - 2) + held(k + 3)) - 25 * (held(k - 1) + held(k + 2)) + 150 * (x[k] + held(k + 1)) + 128) >> 8
        return [v for k in range(len(x)) for v in (x[k], min(max(mid(k), -32768), 32767))]

    texts = ["", "The quick brown fox\n" * 40, "ñandú €" * 100, None]
    got = {r.doc_id: r for r in telephony.stored_media(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        raw += b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        expanded = {"mulaw": [int(telephony.MULAW[b]) for b in raw], "alaw": [int(telephony.ALAW[b]) for b in raw], "adpcm": telephony.adpcm(np.frombuffer(raw, np.uint8).reshape(-1, 192)).ravel().tolist()}
        for (name, x), said in zip(expanded.items(), got[i].feature.split(";"), strict=True):
            pcm = got[i][f"{name}_pcm"]
            assert np.frombuffer(pcm, np.int16).tolist() == doubled(x)
            assert said.startswith(f"{name}=") and said.endswith(f":{zlib.crc32(pcm)}")
