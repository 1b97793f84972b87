"""Workbooks: round trips, sheets by name and place, sets in zip files, broken files."""

import io
import zipfile

from atalaya.sources.workbooks import BATCH, _column, read_workbooks, workbook_bytes, workbook_rows

BOOK = {"Uno": [["a & b", 1], [], [None, "<c>", 2.5]], "Serie Mensual": [["x", None, "y"]], "fin": [["z"], [None], ["z", "w"]]}


def rows(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.workbook, r.sheet, r.row, r.cells) for r in df.collect())


def test_sheets_by_name_and_place(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook_bytes(BOOK))
    read = lambda *a: [r[2:] for r in rows(read_workbooks(spark, str(tmp_path / "*.xlsx"), *a))]
    assert read("uno") == [("Uno", 1, ["a & b", "1"]), ("Uno", 3, [None, "<c>", "2.5"])]
    assert read("mensual", 2) == [("Serie Mensual", 1, ["x", None])]
    assert read(None, 3) == [("fin", 1, ["z", None, None]), ("fin", 3, ["z", "w", None])]
    assert read("nothing") == []


def test_sets_and_broken_files(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("m/one.xlsx", workbook_bytes(BOOK))
        z.writestr("m/two.XLSX", workbook_bytes({"only": [["q"]]}))
        z.writestr("m/bad.xlsx", b"no workbook")
        z.writestr("m/readme.txt", b"text")
    half = workbook_bytes(BOOK)[:200]
    files = spark.createDataFrame([("set.zip", out.getvalue()), ("half.xlsx", half), ("none.xlsx", None), ("empty.xlsx", b"")], "path string, content binary")
    assert [(p, w, s) for p, w, s, *_ in rows(workbook_rows(files))] == [("set.zip", "m/one.xlsx", "fin"), ("set.zip", "m/one.xlsx", "fin"), ("set.zip", "m/two.XLSX", "only")]


def test_rich_and_inline_strings(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook_bytes({"s": [["x"]]}))) as old, zipfile.ZipFile(out, "w") as z:
        for n in old.namelist():
            if not n.endswith(("sheet1.xml", "sharedStrings.xml")):
                z.writestr(n, old.read(n))
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>in</t></is></c><c t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>")
    files = spark.createDataFrame([("b.xlsx", out.getvalue())], "path string, content binary")
    assert [r[4] for r in rows(workbook_rows(files))] == [["rich", "in", "1"]]


def test_long_sheets_keep_all_rows(spark):
    n = 2 * BATCH + 7
    files = spark.createDataFrame([("b.xlsx", workbook_bytes({"s": [[k, f"t{k % 5}"] for k in range(n)]}))], "path string, content binary")
    got = rows(workbook_rows(files))
    assert [r[4] for r in got] == [[str(k), f"t{k % 5}"] for k in range(n)]


def test_columns():
    assert [_column(x) for x in ("A1", "Z9", "AA1", "AZ2", "BA3")] == [0, 25, 26, 51, 52]
