"""URL filters: a sorted sweep of reversed-host keys against the intervals of nested rules.

A host turned round by its labels (`www.example.com` -> `com\\x01example\\x01www\\x01`) makes "this host and all its
subdomains" a prefix, and so an interval of the sorted keys. Pages and rules are dealt to ranges of the key; in each
range one sweep in key order keeps the stack of hosts whose interval is open. The paths of a host's rules are intervals
too: sorted, each with a link to the longest other rule that starts it, so a page's longest path rule is found by one
bisection and a walk up the links, however many rules a host has. Rows of one busy host are spread over ranges, because
the path and the page id are part of the range key; the stack at the start of a range is filled from the ancestors of its
first key. More rules than BLOCK are swept block by block, with each page's best rule so far kept beside it.

Defined results: a null url, or one without `://`, has empty host and path and takes the default verdict. Repeated pages
are judged alike. Among rules of equal length the longer host wins, then a block before an allow. Null rule fields: a
null host or path is empty; an empty host fits every page. A rule with a null action is an error of the caller.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Rules that a task holds at once.
BLOCK = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEP = "\x01"
#: The best rule of a page so far: its length, its host's length, whether it blocks, host and path.
_Best = tuple[int, int, bool, str] | None


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url: the text after the first '://' up to '/', '?', '#'; then up to '?', '#'."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class _Paths:
    """The path rules of one host, as nested intervals of the sorted paths."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        best: dict[str, str] = {}
        for action, path in rules:  # a block goes before an allow of the same path
            best[path] = max(action, best.get(path, action))
        self.paths = sorted(best)
        self.actions = [best[p] for p in self.paths]
        self.outer: list[int] = []
        stack: list[int] = []
        for i, p in enumerate(self.paths):
            while stack and not p.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.outer.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str) -> int:
        """The place of the longest rule that starts path, or -1."""
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return i


class _Sweep:
    """Open hosts while keys come in ascending order."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]) -> None:
        by_host: dict[str, list[tuple[str, str]]] = {}
        for action, host, path in rules:
            by_host.setdefault(host, []).append((action, path))
        self.hosts = {_key(h): (h, _Paths(x)) for h, x in by_host.items()}
        self.starts = sorted(self.hosts)
        self.stack: list[str] = []
        self.next = 0

    def seek(self, key: str) -> None:
        """Open what holds key; close what doesn't. Works from any earlier point of the order."""
        while self.stack and not key.startswith(self.stack[-1]):
            self.stack.pop()
        while self.next < len(self.starts) and self.starts[self.next] <= key:
            start = self.starts[self.next]
            while self.stack and not start.startswith(self.stack[-1]):
                self.stack.pop()
            if key.startswith(start):
                self.stack.append(start)
            self.next += 1

    def judge(self, host: str, path: str, best: _Best) -> _Best:
        """The better of best and the longest open rule: (length, length of the host, is a block, rule)."""
        self.seek(_key(host))
        for start in self.stack:
            rhost, paths = self.hosts[start]
            if (i := paths.longest(path)) >= 0:
                found = (len(rhost) + len(paths.paths[i]), len(rhost), paths.actions[i] == "block", rhost + paths.paths[i])
                best = max(best, found) if best else found
        return best


def _key(host: str) -> str:
    return "".join(x + _SEP for x in reversed(host.split("."))) if host else ""


_SWEPT = "page_id long, host string, path string, __key string, __n long, __host_n long, __block boolean, __rule string"


def _sweep(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The pages with the better of their best rule so far and that of rules; pages are sorted by key in each partition."""
    shared = pages.sparkSession.sparkContext.broadcast(list(rules))
    names = [x.split()[0] for x in _SWEPT.split(", ")]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Sweep(shared.value)
        for batch in rows:
            host, path, *best = (batch.column(k).to_pylist() for k in ("host", "path", *names[4:]))
            known = [x if x[0] is not None else None for x in zip(*best, strict=True)]
            found = [state.judge(h, p, x) or (None,) * 4 for h, p, x in zip(host, path, known, strict=True)]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names[:4]), *columns], names=names)

    return pages.mapInArrow(run, _SWEPT)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str | None, str | None, str | None]] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of each page; see the module. rules: (action, host, path)."""
    rules = [(a, h or "", p or "") for a, h, p in rules]
    if bad := {a for a, _, _ in rules} - {"allow", "block"}:
        raise ValueError(f"unknown actions: {bad}")
    host, path = url_parts(F.col("__url"))
    flat = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("__url"))
    flat = flat.select("page_id", host.alias("host"), path.alias("path"))
    # The labels' order is that of _key: separators close each label, so that `ab` is not below `a`.
    turned = F.when(F.col("host") == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split("host", r"\.")), _SEP), F.lit(_SEP)))
    best = [F.lit(None).cast(kind).alias(name) for name, kind in (x.split() for x in _SWEPT.split(", ")[4:])]
    swept = flat.select("page_id", "host", "path", turned.alias("__key"), *best)
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for i in range(0, max(1, len(rules)), BLOCK):
        if i:
            swept = materialize(swept, "urls")
        swept = _sweep(swept.repartitionByRange(parts, "__key", "path", "page_id").sortWithinPartitions("__key"), rules[i : i + BLOCK])
    verdict = F.when(F.col("__rule").isNull(), default).when(F.col("__block"), "block").otherwise("allow")
    return swept.select("page_id", "host", "path", F.col("__rule").alias("rule"), verdict.alias("verdict"))


#: The same for DuckDB; the rules' order by length is written out.
ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), flat AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), rules(action, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), judged AS (
  SELECT f.page_id, f.host, f.path, r.rhost || r.rpath AS rule, r.action,
         row_number() OVER (PARTITION BY f.page_id, f.host, f.path ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST, length(r.rhost) DESC) AS rn
  FROM flat f LEFT JOIN rules r ON (f.host = r.rhost OR ends_with(f.host, '.' || r.rhost)) AND starts_with(f.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM judged WHERE rn = 1
"""
