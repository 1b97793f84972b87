"""Secrets and personal data against brute force with Python's regular expressions."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atalaya.llm import pii, secrets
from atalaya.llm._spans import spans

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)).encode()).hexdigest()


def base_secrets(text):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return out + [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 // 10 + d * 2 % 10 for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_pii(text):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]


ODD = [
    None, "", " ", "token=secret: abcdefghijklmnop", "TOKEN = 'abcdefghijkl' 🎉 api-key=x apikey:\"0123456789abcdef0\"", "AKIAKIA12345678901 AKIA123456789012345",
    "a@b.c_d@e.f 🎉 x@y..z q@w.e.r.t@u.i", "1.2.3.4.5 256.1.1.1 0000000001.2.3.4 1.2.3 99999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111", "+1 (903) 555-7405 +49 30 1234567890 +12",
    "é" * 50 + "password=hunter2hunter2" + "ñ" * 3, "f" * 20000, "9" * 5000, "a.b" * 3000 + "@x.y", "GB82WEST12345698765432 iban GB82WEST12345698765431",
]


def rows():
    rng = random.Random(7)
    parts = ["token", "=", ": ", '"', "secret", "api_key", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", " ", ".", "@", "mail.example", "+", "4", "12", "-", "255", "300", "é", "🎉", "(", ")"]
    texts = ODD + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(300)]
    return [(i if i % 50 else None, x) for i, x in enumerate(texts)] + [(5000, ODD[4])] * 2


@pytest.mark.parametrize(("query", "base", "kinds"), [(secrets.secret_digest, base_secrets, ("assign", "access", "hex")), (pii.pii_digest, base_pii, ("email", "ip", "card", "phone"))])
def test_base_spans(spark, query, base, kinds):
    data = rows()
    got = query(spark.createDataFrame(data, SCHEMA)).collect()
    want = sorted((str(i), *[sum(x[3] == k for x in base(t or "")) for k in kinds], digest(base(t or ""))) for i, t in data)
    assert sorted((str(r.doc_id), *[r[f"n_{k}"] for k in kinds], r.base_sha256) for r in got) == want
    for r in got:
        text = dict(data).get(r.doc_id) if r.doc_id is not None else None
        if text:
            spans = {tuple(x.split(":")) for x in r.spans.split(",") if x}
            assert {(k, str(s), str(e)) for s, _, e, k in base(text)} <= spans


def test_iban(spark):
    r = pii.pii_digest(spark.createDataFrame([(1, ODD[-1])], SCHEMA)).first()
    assert r.n_iban == 1
    assert "iban:0:22" in r.spans


def test_iban_in_groups_and_context(spark):
    texts = ["GB82 WEST 1234 5698 7654 32 BANK", "hotel 10.0.0.1 shipping", "10.0.0.1 is the host", "the host is 10.0.0.1"]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).orderBy("doc_id").collect()
    assert [(x.s, x.v) for x in got[0].iban] == [(0, "GB82 WEST 1234 5698 7654 32")]
    assert [r.ip[0].score for r in got[1:]] == [0.5, 0.7, 0.7]


def test_one_text_of_very_many_matches(spark):
    n = 100_000
    text = "12 a " * n
    began = time.time()
    frame = spark.createDataFrame([(1, text)], SCHEMA)
    r = frame.select(F.expr(spans("text", "[0-9]+")).alias("m")).selectExpr("size(m) AS n", "m[0].s AS first", "m[99999].s AS last", "m[5].before AS b", "m[99999].after AS z").first()
    assert tuple(r) == (n, 0, 5 * (n - 1), " a ", " a ")
    assert pii.pii_digest(frame).first().n_card == 0
    assert secrets.secret_digest(frame).first().n_hex == 0
    assert time.time() - began < 90


def test_planted_keys_are_found_and_words_are_not(spark):
    rng = random.Random(13)
    abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["ba", "de", "ki", "lo", "mu", "na", "pe", "ri", "so", "tu"]
    rows = [(i, "see " + "".join(rng.choices(abc, k=48)) + " here") for i in range(300)]
    rows += [(1000 + i, "see " + "".join(rng.choices(syllables, k=12)) + str(rng.randint(1, 9)) + " here") for i in range(300)]
    got = {r.doc_id: r.n_random for r in secrets.secret_digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[i] for i in range(300)) >= 270
    assert sum(got[1000 + i] for i in range(300)) <= 15


def test_battery_separates_random_from_words(spark):
    rng = random.Random(3)
    abc = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(abc, k=40)) for _ in range(200)]
    dull = [f"section{i}thatisrepeatedandrepeatedhere" for i in range(200)]
    data = [(i, f"x {k} y") for i, k in enumerate(keys)] + [(1000 + i, f"x {k} y") for i, k in enumerate(dull)]
    got = {r.doc_id: r.n_random for r in secrets.secret_digest(spark.createDataFrame(data, SCHEMA)).collect()}
    assert sum(got[i] for i in range(200)) >= 180
    assert sum(got[1000 + i] for i in range(200)) <= 10


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    wide = spark.createDataFrame([(1, "token = abcdefghijklmnop", "x", "y")], "doc_id long, text string, spans string, random string")
    for query in (secrets.secret_digest, pii.pii_digest):
        assert query(empty).count() == 0
        assert query(wide).count() == 1
