"""Spreadsheet workbooks (XLSX), also sets of them in zip files: sheets chosen by name or place, rows as text cells."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, workbook string, sheet string, row long, cells array<string>"
#: The names that the format gives to relations between its parts.
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of a sheet that are sent to Spark at once.
BATCH = 5_000


def read_workbooks(spark: SparkSession, path: str, sheet: str | None = None, width: int | None = None) -> DataFrame:
    """workbook_rows of the files under a path that Spark's binary reader takes."""
    return workbook_rows(spark.read.format("binaryFile").load(path).select("path", "content"), sheet, width)


def workbook_rows(files: DataFrame, sheet: str | None = None, width: int | None = None) -> DataFrame:
    """(path, workbook, sheet, row, cells) of files (path, content): XLSX workbooks, or zip files with workbooks in them.

    sheet is a fragment of the wanted sheet's name, in either case, the first that has it; without it the last sheet is taken.
    row is the sheet's own row number from 1; cells has `width` columns if given, else up to the row's last one, null where
    the sheet has none. Numbers are text as stored, dates their day numbers. Empty rows are left out; files that are null or
    broken, and workbooks without such a sheet, give no rows. A workbook is one task's work: the format ends at 1,048,576
    rows a sheet, which stream through in batches.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                for name, book in _books(path, content):
                    yield from _frames(path, name, book, sheet, width)

    return files.select("path", "content").mapInPandas(rows, ROWS)


def _books(path: str, content: bytes | None) -> Iterator[tuple[str, zipfile.ZipFile]]:
    try:
        outer = zipfile.ZipFile(io.BytesIO(bytes(content or b"")))
    except zipfile.BadZipFile:
        return
    if "xl/workbook.xml" in outer.namelist():
        yield path.rsplit("/", 1)[-1], outer
        return
    for name in sorted(n for n in outer.namelist() if n.lower().endswith(".xlsx")):
        try:
            yield name, zipfile.ZipFile(io.BytesIO(outer.read(name)))
        except zipfile.BadZipFile:
            continue


def _frames(path: str, name: str, book: zipfile.ZipFile, sheet: str | None, width: int | None) -> Iterator[pd.DataFrame]:
    try:
        found = _sheet(book, sheet)
        if found is None:
            return
        title, part = found
        held = []
        for number, cells in _cells(book, part, _strings(book)):
            if width is not None:
                cells = (cells + [None] * width)[:width]
            held.append((path, name, title, number, cells))
            if len(held) == BATCH:
                yield pd.DataFrame(held, columns=["path", "workbook", "sheet", "row", "cells"])
                held = []
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return
    if held:
        yield pd.DataFrame(held, columns=["path", "workbook", "sheet", "row", "cells"])


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _sheet(book: zipfile.ZipFile, fragment: str | None) -> tuple[str, str] | None:
    """Name and part of the wanted sheet."""
    parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), s.get(_LINK)) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
    wanted = [s for s in sheets if fragment.lower() in s[0].lower()][:1] if fragment is not None else sheets[-1:]
    if not wanted:
        return None
    target = parts[wanted[0][1]]
    return wanted[0][0], target[1:] if target.startswith("/") else f"xl/{target}"


def _text(node: ElementTree.Element) -> str:
    """The text of a string item: its runs joined, without readings of characters."""
    skip = {id(t) for p in node.iter() if _local(p.tag) == "rPh" for t in p.iter()}
    return "".join(t.text or "" for t in node.iter() if _local(t.tag) == "t" and id(t) not in skip)


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return [_text(s) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if _local(s.tag) == "si"]


def _cells(book: zipfile.ZipFile, part: str, strings: Sequence[str]) -> Iterator[tuple[int, list[str | None]]]:
    """Row number and cells of each row that has any, one at a time."""
    last = 0
    with book.open(part) as lines:
        for _, node in ElementTree.iterparse(lines):
            if _local(node.tag) != "row":
                continue
            last = int(node.get("r") or last + 1)
            cells: list[str | None] = []
            for c in node:
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value = next((v.text for v in c if _local(v.tag) == "v"), None)
                if c.get("t") == "s" and value is not None:
                    value = strings[int(value)] if int(value) < len(strings) else None
                elif c.get("t") == "inlineStr":
                    value = _text(c)
                cells[at] = value
            node.clear()
            if any(v is not None for v in cells):
                yield last, cells


def _column(ref: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for letter in re.match("[A-Z]+", ref.upper())[0]:
        n = 26 * n + ord(letter) - 64
    return n - 1


def workbook_bytes(sheets: Mapping[str, Sequence[Sequence[object]]]) -> bytes:
    """A workbook of the given sheets: texts shared, numbers as they are, None left out."""
    shared: dict[str, int] = {}
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"

    def cell(v: object, row: int, col: int) -> str:
        if v is None:
            return ""
        letters, n = "", col + 1
        while n:
            n, k = divmod(n - 1, 26)
            letters = chr(65 + k) + letters
        if isinstance(v, str):
            return f'<c r="{letters}{row}" t="s"><v>{shared.setdefault(v, len(shared))}</v></c>'
        return f'<c r="{letters}{row}"><v>{v}</v></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{i}">{"".join(cell(v, i, j) for j, v in enumerate(row))}</row>' for i, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{_LINK[1:-3]}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Type="{_LINK[1:-3]}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si><t>{escape(s)}</t></si>" for s in shared)}</sst>')
    return out.getvalue()
