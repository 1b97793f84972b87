"""Line dedup, near-duplicate join and components against brute force."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import types as T

from atalaya.llm import _words, components, line_dedup, near_dedup

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_near(rows):
    sets, u = [shingle_set(t) for _, t in rows], Union()
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                u.join(i, j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(u.find(k), []).append(i)
    return sorted((i, len(sets[k]), min(x for x in least[u.find(k)])) for k, (i, _) in enumerate(rows))


def near_rows(n=60, variants=40):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(400)]
    make = lambda k: rng.choices(vocabulary, k=k)
    texts = [None, "", " \t", "One two", "one  TWO", "a b c d", "A b c\nd e", "x" * 3000]
    for _ in range(n):
        w = make(rng.randint(3, 60))
        texts.append(" ".join(w))
        for _ in range(rng.randint(0, 3)):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            texts.append(" ".join(v))
    base = make(200)
    for _ in range(variants):  # one large group of near copies, and a line that many share
        v = list(base)
        v[rng.randrange(200)] = rng.choice(vocabulary)
        texts.append(" ".join(v))
        texts.append(" ".join(base[:12]) + "\n" + " ".join(make(30)))
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(3, texts[3])]


@pytest.mark.parametrize("small", [4096, 6])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "FREE", 1 if small == 6 else 4)
    monkeypatch.setattr(near_dedup, "LEVELS", 3)
    rows = near_rows()
    got = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_edges(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0
    docs = frame(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (8, None)]).selectExpr("*", "1 AS cls", "2 AS root", "3 AS node")
    assert sorted(map(str, (tuple(r) for r in near_dedup.near_duplicates(docs).collect()))) == sorted(map(str, [(None, 2, 7, True), (7, 2, 7, True), (8, 0, 8, True)]))
    kept = near_dedup.drop_near_duplicates(frame(spark, [(1, "a b"), (2, "A b"), (3, "c"), (3, "a  b")]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b"), (3, "c")]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)] + [(5, 5), (-3, 9000)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    want = {(x, u.find(x)) for a, b in edges if a != b for x in (a, b)}
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == want
    assert len(got) == len(want)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def normal(line):
    return " ".join(regex.findall(r"[\p{L}\p{N}]+", line.lower()))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    """By words, or by letters where few words differ; the bags of words give a lower bound first."""
    v, w = a.split(" "), b.split(" ")
    most = max(len(v), len(w)) // 5
    bags = Counter(v), Counter(w)
    if max(sum((bags[0] - bags[1]).values()), sum((bags[1] - bags[0]).values())) > max(most, line_dedup.FEW):
        return False
    d = distance(v, w)
    return d <= most or d <= line_dedup.FEW and distance(a, b) <= max(len(a), len(b)) // 5


def brute_lines(rows):
    nodes = sorted({normal(x) for _, t in rows if t for x in t.split("\n")} - {""})
    u, sizes = Union(), [x.count(" ") for x in nodes]
    for i, a in enumerate(nodes):
        for j in range(i):
            if abs(sizes[i] - sizes[j]) <= max(line_dedup.FEW, max(sizes[i], sizes[j]) // 5 + 1) and similar(a, nodes[j]):
                u.join(a, nodes[j])
    first, at = {}, {}
    for i, t in rows:
        for k, x in enumerate(t.split("\n") if t else []):
            if normal(x):
                at[i, t, k] = u.find(normal(x))
                order = (i is not None, i or 0, k)
                first[at[i, t, k]] = min(order, first.get(at[i, t, k], order))
    out = []
    for i, t in rows:
        gone = [k for k in range(len(t.split("\n")) if t else 0) if (i, t, k) in at and first[at[i, t, k]] != (i is not None, i or 0, k)]
        out.append((i, 0 if t is None else len(t.split("\n")), gone, t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("large", [32, 2])
def test_line_dedup(spark, monkeypatch, large):
    monkeypatch.setattr(line_dedup, "LARGE", large)
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghé", k=rng.randint(2, 8))) for _ in range(300)]
    lines = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) for _ in range(50)] + ["", "###", "One!", "one", " ".join(rng.choices(vocabulary, k=400))]
    base = rng.choices(vocabulary, k=90)
    for _ in range(40):
        v = list(base)
        v[rng.randrange(90)] = rng.choice(vocabulary)
        lines.append(" ".join(v).capitalize() + rng.choice(["", ".", " !"]))
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 6)))) for i in range(60)] + [(100, None), (101, ""), (None, lines[0]), (102, "\n\n")]
    rows += [rows[5], (103, " ".join(vocabulary * 2)), (104, " ".join(["new", *vocabulary[1:], *vocabulary]))]
    got = sorted(((r.doc_id, r.n_lines, list(r.dropped), r.text) for r in line_dedup.line_report(frame(spark, rows)).collect()), key=str)
    assert got == brute_lines(rows)
    assert any(x[2] for x in got)


def test_line_dedup_edges(spark):
    assert line_dedup.line_report(frame(spark, [])).count() == 0
    docs = frame(spark, [(1, "Same line\nown words here"), (2, "same, LINE")]).selectExpr("*", "1 AS key", "2 AS at", "3 AS line_no", "4 AS top")
    kept = line_dedup.drop_repeated_lines(docs).collect()
    assert [(r.doc_id, r.text, r.n_chars) for r in kept] == [(1, "Same line\nown words here", 24)]


def test_line_dedup_finds_one_word_and_one_typo(spark):
    rng = random.Random(17)
    vocabulary = ["".join(rng.choices("abcdefghijklmnoprstu", k=rng.choice([2, 3, 3, 4, 5, 6, 7, 8, 9, 11]))) for _ in range(3000)]
    rows, classes = [], {}
    for low, high in ((1, 3), (6, 10), (11, 20), (21, 50), (51, 100), (101, 160)):
        for _ in range(25):
            w = rng.choices(vocabulary, k=rng.randint(low, high))
            word, typo = list(w), list(" ".join(w))
            word[rng.randrange(len(w))] = rng.choice(vocabulary)
            typo[rng.choice([i for i, x in enumerate(typo) if x != " "])] = "z"
            for variant in (" ".join(word), "".join(typo)):
                if variant != " ".join(w) and similar(" ".join(w), variant):
                    classes.setdefault(low, []).append(len(rows) + 1)
                    rows += [(len(rows), " ".join(w)), (len(rows) + 1, variant)]
    got = {r.doc_id: r.n_kept for r in line_dedup.line_report(frame(spark, rows)).collect()}
    for low, ids in classes.items():
        assert len(ids) >= 15, low
        assert sum(got[i] == 0 for i in ids) >= 0.95 * len(ids), low


def test_lines_around_a_common_passage_meet(spark):
    """Pairs of lines that share a passage with all others: 24 common and 10 own words, 4 of them changed in the copy; those with more than two changes meet by chance."""
    random = np.random.default_rng(17)
    vocabulary = ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), int(random.integers(3, 9)))) for _ in range(1500)]
    passage, lines, pairs = [vocabulary[i] for i in random.integers(0, 1500, 24)], [], []
    for common, own, changed in ((24, 10, 4), (12, 8, 3)):
        for _ in range(150):
            words = passage[:common] + [vocabulary[i] for i in random.integers(0, 1500, own)]
            copy = list(words)
            for i in random.choice(np.arange(common, common + own), changed, replace=False):
                copy[i] = vocabulary[int(random.integers(0, 1500))]
            pairs.append((len(lines), len(lines) + 1))
            lines += [" ".join(words), " ".join(copy)]
    docs = spark.createDataFrame([(i, line, None, None, len(line)) for i, line in enumerate(lines)], "doc_id long, text string, lang string, source string, n_chars long")
    stay = {r.doc_id for r in line_dedup.line_report(docs).where("n_kept > 0").collect()}
    assert sum(b not in stay for _, b in pairs) >= 0.97 * len(pairs) and all(a in stay for a, _ in pairs)


def test_words_of_many_texts_in_little_memory(monkeypatch):
    """4 MB of texts took over 200 MB with the tables kept; cut into pieces, words are the same and stand at the same places."""
    random = np.random.default_rng(3)
    texts = [random.choice(np.frombuffer(b"abcdefghABC \n", np.uint8), n) for n in (*random.integers(0, 4000, 2200), 0, 1, 5000, 0)]
    data, offsets = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    assert len(data) > 4_000_000
    monkeypatch.setattr(_words, "_powers", (np.ones(1, np.uint64), np.ones(1, np.uint64)))
    tracemalloc.start()
    got = _words.words(data, offsets)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 120e6
    monkeypatch.setattr(_words, "PIECE", 1 << 30)
    whole = _words.words(data, offsets)
    for name in ("hashes", "first", "end", "bounds"):
        assert (getattr(got, name) == getattr(whole, name)).all() and len(getattr(got, name)) == len(getattr(whole, name))
    k = int(np.searchsorted(got.bounds, len(got.hashes) // 2, "right")) - 1
    spans = [m.span() for m in re.finditer(rb"[^ \n]+", texts[k].tobytes())]
    a, b = got.bounds[k], got.bounds[k + 1]
    assert [(int(x - offsets[k]), int(y - offsets[k])) for x, y in zip(got.first[a:b], got.end[a:b], strict=True)] == spans
    assert _words.words(data[:0], offsets[:1]).bounds.tolist() == [0]


def test_crowds_under_a_rare_word_make_links_only(spark):
    """Lines that share words with all others, each in a component of its own: exactly the similar pairs come out, no candidates."""
    rng = random.Random(31)
    vocabulary = ["".join(rng.choices("abcdefghijkl", k=5)) for _ in range(200)]
    lines = []
    for _ in range(40):
        w = vocabulary[:6] + rng.choices(vocabulary, k=8)
        lines += [" ".join(w), " ".join([*w[:-3], *rng.choices(vocabulary, k=3)])]
    docs = frame(spark, list(enumerate(lines)))
    nodes = line_dedup.occurrences(docs).selectExpr("key", "at").dropDuplicates(["key"]).localCheckpoint()
    texts = line_dedup._texts(nodes.select("key"), nodes, docs)
    names = {r.key: r.line for r in texts.collect()}
    got = [(names[r.a], names[r.b]) for r in line_dedup._by_rare_words(nodes.selectExpr("key", "key AS top"), texts).collect()]
    want = {tuple(sorted((a, b))) for a in names.values() for b in names.values() if a < b and similar(a, b)}
    assert {tuple(sorted(x)) for x in got} == want and len(got) == len(want) and want


@pytest.mark.parametrize("crowd", [None, 4])
def test_crowds_of_one_component_are_not_split(spark, monkeypatch, crowd):
    """600 near copies, one component so far, and 40 other lines with their words: each line has a row for each of its rarest words, once; split by two words, the pairs are the same."""
    rng = random.Random(37)
    vocabulary = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(300)]
    lines, base = set(), vocabulary[:12]
    while len(lines) < 600:
        w = list(base)
        w[rng.randrange(12)], w[rng.randrange(12)] = rng.choice(vocabulary[12:]), rng.choice(vocabulary[12:])
        lines.add(" ".join(w))
    while len(lines) < 640:
        lines.add(" ".join(base[:9] + rng.choices(vocabulary, k=rng.choice([2, 3]))))
    docs = frame(spark, list(enumerate(sorted(lines))))
    nodes = line_dedup.occurrences(docs).selectExpr("key", "at").dropDuplicates(["key"]).localCheckpoint()
    texts = line_dedup._texts(nodes.select("key"), nodes, docs)
    names, n_base = {r.key: r.line for r in texts.collect()}, lambda x: len(set(base) & set(x.split(" ")))
    one = [k for k, x in names.items() if n_base(x) >= 10]
    tops = {k: min(one) if k in one else k for k in names}
    made, write = [], line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: (out := write(df, name), made.append((name, out.count())))[0])
    if crowd is not None:
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
    got = line_dedup._by_rare_words(spark.createDataFrame(list(tops.items()), "key long, top long"), texts).collect()
    want = {(a, b) for a in names for b in names if a < b and tops[a] != tops[b] and similar(names[a], names[b])}
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) and want
    if crowd is None:
        crowded = [n for name, n in made if name == "line-crowded"]
        assert len(crowded) == 1 and 600 < crowded[0] <= 5 * len(lines)


def test_words_of_a_line_are_made_once(spark, monkeypatch):
    """One regular expression for the words in each plan, and the hashes of most lines alone in the table of all lines."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    docs = frame(spark, [(0, "one two three four five six seven eight\n##"), (1, "One two three four five six seven nine"), (2, "ab"), (3, "ac ab")])
    assert plan(line_dedup.occurrences(docs)).count("regexp_extract_all") == 1
    made, write = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: made.setdefault(name, []).append((df, plan(df))) or write(df, name))
    gone = {r.doc_id: list(r.dropped) for r in line_dedup.line_report(docs).collect()}
    assert gone == {0: [], 1: [0], 2: [], 3: []}
    assert made["line-texts"][0][1].count("regexp_extract_all") == 1
    assert made["lines"][0][0].columns == ["key", "n", "at", "size", *[f"w{i}" for i in range(8)]]


def test_keys_are_compiled_and_only_wanted_lines_read_again(spark, monkeypatch):
    """No interpreted filter in the keys; lines that are read again are put in lower case alone; repeated words give the same smallest hashes."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    table = lambda names, some: spark.range(4).selectExpr("id AS key", "9 AS size", *[f"IF({i} < {some}, id DIV 2 * 100 + {i}, NULL) AS {x}" for i, x in enumerate(names)])
    keys = line_dedup._buckets(table(line_dedup.PRINTS, 8), table(line_dedup.OTHERS, 0))
    assert "lambda" not in plan(keys)
    assert keys.count() == 4 * 10 and keys.select("bucket").distinct().count() == 2 * 10 and keys.where("bucket IS NULL").count() == 0
    words = ["somewhat"] * 40 + ["longest"] * 30 + [f"word{i}" for i in range(20)] + ["a"] * 9
    docs = frame(spark, [(0, " ".join(words)), (1, " ".join(words[:69])), (2, " ".join([*words[:-1], "B"]))])
    got = {r.doc_id: r for r in line_dedup.occurrences(docs).selectExpr("cast(at div 2147483648 AS long) AS doc_id", *line_dedup.PRINTS).collect()}
    want = docs.selectExpr("doc_id", "sort_array(array_distinct(transform(split(lower(text), ' '), w -> shiftrightunsigned(xxhash64(w), 8 + least(length(w), 8))))) AS h").collect()
    assert all([got[r.doc_id][x] for x in line_dedup.PRINTS] == [*r.h, *[None] * 8][:8] for r in want)
    made, write = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: made.setdefault(name, plan(df)) and write(df, name))
    assert {r.doc_id: list(r.dropped) for r in line_dedup.line_report(docs).collect()} == {0: [], 1: [], 2: [0]}
    assert "lower(text" not in made["line-texts"] and "lower(" in made["line-texts"]
