"""Secret scans: patterns for known forms, and a battery of randomness tests for the rest.

Tokens of 20 characters or more with letters and digits get an encoding (the smallest alphabet that holds them) and three
tests against "each symbol is drawn alike and alone": chi-squared uniformity of the alphabet, runs above and below its
middle, and lag-1 serial correlation. Fisher's rule joins their p-values. For random tokens the joint p is uniform; for
words and codes it piles up near 0. So for each encoding and length class the number of random tokens is estimated from
the upper half of the p-values, and the class accepts p above the lowest level at which the estimated share of false
discoveries stays within `fdr`. That holds only where the upper half is flat: a class with significantly more p-values
from 0.5 to 0.75 than above (two standard errors) is one of words that happen to pass, and accepts none.

The level table has one row for an encoding, length class (powers of 2^(1/2)) and p-value bin: at most a few thousand
rows whatever the input, which is the bound of its broadcast.

Defined results: a null or empty text has no spans; very long texts and tokens are read whole; repeated rows count as
rows; with no candidates no random spans are found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, materialize
from ._spans import listed, marked, spans

PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "random": r"[A-Za-z0-9+/_-]{20,}={0,2}",
}
BASE = ("assign", "access", "hex")
HINTS = {"assign": None, "access": "contains(__text, 'AKIA')", "hex": None, "random": None}
#: Encodings by the characters they allow; the first that fits is taken. The alphabet gives each symbol its number.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    "HEX": ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    "base32": ("^[A-Z2-7]+$", _UPPER + "234567"),
    "lower36": ("^[0-9a-z]+$", _DIGITS + _LOWER),
    "upper36": ("^[0-9A-Z]+$", _DIGITS + _UPPER),
    "base62": ("^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    "base64": ("^[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    "base64url": ("^[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    "mixed": (".", _UPPER + _LOWER + _DIGITS + "+/-_"),
}
LEVELS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5)
#: Halves the p-values above the last level.
TOP = 0.75


def _tail(z: str) -> str:
    """Two-sided normal tail of z by the logistic approximation of the normal distribution (error below 0.0002)."""
    return f"least(1.0D, greatest(1e-15D, 2.0D / (1.0D + exp(least(700.0D, 1.5976D * abs({z}) + 0.07056D * pow(abs({z}), 3))))))"


def battery(token: str) -> tuple[str, str, str]:
    """SQL of (encoding, length, joint p-value) of a token; padding signs don't count."""
    body = f"rtrim('=', {token})"
    names, alphabets = "CASE", "CASE"
    for name, (pattern, alphabet) in ENCODINGS.items():
        names += f" WHEN {body} RLIKE '{pattern}' THEN '{name}'"
        alphabets += f" WHEN {body} RLIKE '{pattern}' THEN '{alphabet}'"
    fold = f"""aggregate(array({body}), cast(null AS double), (unused, t) -> aggregate(array({alphabets} END), cast(null AS double), (unused2, abc) ->
      aggregate(array(transform(split(t, ''), c -> instr(abc, c) - 1)), cast(null AS double), (unused3, x) -> {{}})))"""
    n, k = "cast(size(x) AS double)", "cast(length(abc) AS double)"
    squares = "aggregate(array_distinct(x), 0.0D, (a, s) -> a + pow(size(filter(x, v -> v = s)), 2))"
    chi = f"(({k} / {n} * {squares} - {n}) - ({k} - 1)) / sqrt(2.0D * ({k} - 1) * ({n} - 1) / {n})"
    high = f"cast(size(filter(x, v -> 2 * v >= {k})) AS double)"
    runs = f"(1.0D + size(filter(sequence(1, size(x) - 1), i -> (2 * x[i] >= {k}) != (2 * x[i - 1] >= {k}))))"
    expected = f"(2.0D * {high} * ({n} - {high}) / {n} + 1)"
    run_z = f"IF({high} IN (0, {n}), 30.0D, ({runs} - {expected}) / sqrt(greatest(1e-9D, ({expected} - 1) * ({expected} - 2) / ({n} - 1))))"
    mean = f"(aggregate(x, 0.0D, (a, v) -> a + v) / {n})"
    cross = f"aggregate(array({mean}), 0.0D, (u, m) -> aggregate(sequence(1, size(x) - 1), 0.0D, (a, i) -> a + (x[i] - m) * (x[i - 1] - m)))"
    spread = f"aggregate(array({mean}), 0.0D, (u, m) -> aggregate(x, 0.0D, (a, v) -> a + pow(v - m, 2)))"
    serial = f"IF({spread} = 0, 30.0D, ({cross} / {spread} + 1.0D / {n}) * sqrt({n}))"
    ln = f"-(ln({_tail(chi)}) + ln({_tail(run_z)}) + ln({_tail(serial)}))"
    p = f"aggregate(array({ln}), 0.0D, (u, h) -> exp(-h) * (1.0D + h + h * h / 2.0D))"
    return f"{names} END", f"length({body})", fold.replace("{}", p)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans by kind, and random: array<struct<s, v, encoding, band, p>> of tested tokens."""
    found = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    found = found.select("doc_id", *[F.expr(spans("__text", PATTERNS[k], HINTS[k])).alias(k) for k in PATTERNS])
    group = "regexp_extract(x.v, r'" + PATTERNS["assign"].replace("'", r"\x27") + "', 2)"
    encoding, n, p = battery("x.v")
    tested = f"""transform(filter(random, x -> x.v RLIKE '[0-9]' AND x.v RLIKE '[A-Za-z]'),
        x -> named_struct('s', x.s, 'v', x.v, 'encoding', {encoding}, 'band', cast(floor(2 * log2({n})) AS int), 'p', {p}))"""
    return found.select("doc_id", F.expr(f"filter(assign, x -> length({group}) >= 12)").alias("assign"), F.expr("filter(access, x -> length(x.v) >= 18)").alias("access"), "hex", F.expr(tested).alias("random"))


def accepted_levels(found: DataFrame, fdr: float) -> DataFrame:
    """encoding, band, level: the lowest p-value level whose estimated share of false discoveries is within fdr."""
    bins = found.select(F.explode("random").alias("t")).select("t.encoding", "t.band", F.expr(f"size(filter(array{(*LEVELS, TOP)}, l -> t.p > l))").alias("above"))
    bins = bins.groupBy("encoding", "band", "above").agg(F.count("*").alias("n"))
    # above = how many levels p exceeds; the last level is 0.5, whose upper half estimates the random tokens.
    sums = [F.sum(F.when(F.col("above") > i, F.col("n")).otherwise(0)).alias(f"r{i}") for i in range(len(LEVELS) + 1)]
    wide = bins.groupBy("encoding", "band").agg(*sums).where(f"r{len(LEVELS) - 1} - 2 * r{len(LEVELS)} <= 2 * sqrt(r{len(LEVELS) - 1})")
    last, level = f"r{len(LEVELS) - 1}", "CASE"
    for i, l in enumerate(LEVELS):
        level += f" WHEN r{i} > 0 AND greatest(0.0D, r{i} - 2.0D * {last} * {1 - l}D) <= {fdr}D * r{i} THEN {l}D"
    return wide.select("encoding", "band", F.expr(level + " END").alias("level")).where("level IS NOT NULL")


def scan_secrets(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """doc_id, assign, access, hex, random: the spans of each kind; random ones passed the battery at their class's level."""
    found = materialize(candidates(docs), "secrets")
    levels = accepted_levels(found, fdr).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "encoding", "band"), "level"))).alias("__levels"))
    passed = "filter(random, x -> x.p > coalesce(try_element_at(__levels, concat(x.encoding, ':', x.band)), 1.0D))"
    joined = found.join(F.broadcast(levels), how="cross")  # one row of at most a few thousand classes
    return joined.select("doc_id", *BASE, F.expr(passed).alias("random"))


def secret_digest(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_random."""
    found = scan_secrets(docs, fdr)
    lists = {k: marked(k, k, i) for i, k in enumerate(PATTERNS)}
    base = F.expr(listed(f"concat({', '.join(lists[k] for k in BASE)})"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(base, 256).alias("base_sha256"),
        F.expr(listed(f"concat({', '.join(lists.values())})")).alias("spans"), F.size("random").cast("long").alias("n_random"),
    )
