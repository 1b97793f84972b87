"""Spans of a pattern in a text with DataFrame functions only: positions come from the gaps between matches.

All expressions are SQL text over a column name, so that lambda variables stay readable. Positions are code points, from
0, end exclusive. Matches are numbered in blocks of about the root of their number: a fold lists the matches of a block,
one more the starts of the blocks. Lists grow within a block only, so a text of n matches costs n^1.5 small copies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters of the gaps around a match that are kept.
CONTEXT = 48


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def spans(text: str, pattern: str, hint: str | None = None) -> str:
    """array<struct<s int, v string, before string, after string>> of the leftmost non-overlapping matches in column text.

    before, after: the ends of the gaps around the match, up to CONTEXT characters. hint: a cheap condition without which
    nothing matches.
    """
    p = _quoted(pattern)
    kind = "array<struct<s:int,v:string,before:string,after:string>>"
    found = f"""transform(array(split({text}, {p}, -1)), g -> zip_with(
        regexp_extract_all({text}, {p}, 0), zip_with(slice(g, 1, size(g) - 1), slice(g, 2, size(g) - 1), (b, a) -> named_struct('b', b, 'a', a)),
        (m, x) -> named_struct('v', m, 'skip', length(x.b), 'n', length(x.b) + length(m), 'before', right(x.b, {CONTEXT}), 'after', left(x.a, {CONTEXT}))))[0]"""
    blocks = "transform(array(greatest(32, cast(ceil(sqrt(size(z))) AS int))), k -> transform(sequence(0, (size(z) - 1) div k), i -> slice(z, i * k + 1, k)))[0]"
    # In a block, places count from its start.
    placed = f"""aggregate(b, named_struct('at', 0, 'found', cast(array() AS {kind})), (o, x) -> named_struct(
        'at', o.at + x.n, 'found', array_append(o.found, named_struct('s', o.at + x.skip, 'v', x.v, 'before', x.before, 'after', x.after))))"""
    starts = "aggregate(w, named_struct('at', 0, 'all', cast(array() AS array<int>)), (o, x) -> named_struct('at', o.at + x.at, 'all', array_append(o.all, o.at))).all"
    shifted = "transform(x.found, y -> named_struct('s', y.s + t, 'v', y.v, 'before', y.before, 'after', y.after))"
    whole = f"""transform(array({found}), z -> transform(array(transform({blocks}, b -> {placed})), w -> flatten(zip_with(w, {starts}, (x, t) -> {shifted})))[0])[0]"""
    return f"CASE WHEN {hint or f'{text} RLIKE {p}'} THEN {whole} ELSE cast(array() AS {kind}) END"


def listed(column: str) -> str:
    """kind:start:end of array<struct<s, rank, e, kind>>, by start, then rank, joined by commas."""
    return f"array_join(transform(array_sort({column}), x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def marked(column: str, kind: str, rank: int) -> str:
    """The matches of a column of spans() as array<struct<s, rank, e, kind>>."""
    return f"transform({column}, x -> named_struct('s', x.s, 'rank', {rank}, 'e', x.s + length(x.v), 'kind', '{kind}'))"


def expr(sql: str) -> Column:
    return F.expr(sql)
