"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds: email, ip, card (Luhn), phone, and iban (mod 97; also in groups of four). A span's score starts from its kind,
gains where a checksum holds and where one of the kind's context words stands within 48 characters before or after it,
with no other span of the kind between. Base kinds are reported whatever their score;
an IBAN must pass its checksum.

Defined results: a null or empty text has no spans; very long digit runs, addresses and texts are matched in linear time
(possessive patterns, starts fixed by a look behind); repeated rows are scanned alike; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents
from ._spans import listed, marked, spans

_LOCAL = "A-Za-z0-9._%+-"
#: A start inside a run is only open to what follows another match, so a run is read once.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|\x20[A-Z0-9]{4}\x20[A-Z0-9]{4}(?:\x20(?=[A-Z]{0,3}[0-9])[A-Z0-9]{4}){1,5}(?:\x20(?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
}
HINTS = {"email": "contains(__text, '@')", "phone": "contains(__text, '+')", "ip": None, "card": None, "iban": None}
BASE = ("email", "ip", "card", "phone")
_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"


def luhn(digits: str) -> str:
    """Whether a string of digits passes the Luhn check: from the right, every second digit is doubled."""
    doubled = "(try_cast(c AS bigint) * 2) div 10 + (try_cast(c AS bigint) * 2) % 10"
    return f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> IF(i % 2 = 1, {doubled}, try_cast(c AS bigint))), 0L, (a, d) -> a + d) % 10 = 0"


def mod97(text: str) -> str:
    """Whether a string of digits and capital letters, its first four moved to the end, is 1 mod 97 with A = 10."""
    step = "IF(c BETWEEN '0' AND '9', (a * 10 + try_cast(c AS int)) % 97, (a * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(split(concat(substring({text}, 5), left({text}, 4)), ''), 0, (a, c) -> {step}) = 1"


CHECKS = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), p -> length(ltrim('0', p)) <= 3 AND coalesce(try_cast(right(p, 4) AS int), 0) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
    "iban": mod97("replace(x.v, ' ', '')"),
}
#: Score of the kind alone, and with its checksum.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.9}
#: Context words of each kind, whole words only, in any case.
CONTEXT = {
    "email": "e-?mails?|mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|hosts?|servers?|address(?:es)?|serveur|servidor",
    "card": "cards?|visa|credit|debit|karte|kreditkarte|carte|tarjeta",
    "phone": "tel|telephone|telefon|phone|call|mobile|fax|anruf|appel|llame|llamar",
    "iban": "iban|account|bank|konto|compte|cuenta",
}


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and one array<struct<s, v, score>> column for each kind: start (code points), matched text, score 0 to 1."""
    found = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("__text"))
    found = found.select("doc_id", *[F.expr(spans("__text", PATTERNS[k], HINTS[k])).alias(f"__{k}") for k in PATTERNS])
    scored = []
    for k in PATTERNS:
        score = rf"least(1.0D, {SCORES[k]}D + IF(concat_ws(' | ', x.before, x.after) RLIKE r'(?i)\b(?:{CONTEXT[k]})\b', 0.2D, 0.0D))"
        scored.append(F.expr(f"transform(filter(__{k}, x -> {CHECKS[k]}), x -> named_struct('s', x.s, 'v', x.v, 'score', {score}))").alias(k))
    return found.select("doc_id", *scored)


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_iban, max_score (0 without spans)."""
    found = find_pii(docs)
    lists = {k: marked(k, k, i) for i, k in enumerate(PATTERNS)}
    out = found.select("*", F.expr(listed(f"concat({', '.join(lists[k] for k in BASE)})")).alias("__base"), F.expr(listed(f"concat({', '.join(lists.values())})")).alias("spans"))
    scores = ", ".join(f"transform({k}, x -> x.score)" for k in PATTERNS)
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2("__base", 256).alias("base_sha256"), "spans",
        F.size("iban").cast("long").alias("n_iban"), F.expr(f"coalesce(array_max(concat({scores})), 0.0D)").alias("max_score"),
    )
