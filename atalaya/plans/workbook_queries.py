"""Queries of workbooks that Spark's tasks write from the tables and read again."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import bindings as b
from ..sources import workbooks
from .registry import query

_FILES = "path string, content binary"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    """segment, zone, n: customers, at most 25 rows a segment."""
    return b.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("zone")).agg(F.count("*").alias("n"))


@query("s15_last_sheet", "SELECT c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS zone, count(*) AS n FROM customer GROUP BY 1, 2")
def s15_last_sheet(spark: SparkSession, d: str) -> DataFrame:
    """A workbook a segment: of the last sheet, without header, the rows "Comuna N" and their third column."""

    def book(rows: pd.DataFrame) -> pd.DataFrame:
        table = [["Poblacion por comuna"], [None, None, "total"], *[[f"Comuna {z}", None, int(n)] for z, n in zip(rows["zone"], rows["n"])], ["Total", None, int(rows["n"].sum())]]
        return pd.DataFrame({"path": [f"{rows['segment'].iloc[0]}.xlsx"], "content": [workbooks.workbook_bytes({"Notas": [["Comuna 1", None, -1]], "Cuadro": table})]})

    read = workbooks.workbook_rows(_counts(spark, d).groupBy("segment").applyInPandas(book, _FILES), width=3)
    zone = F.regexp_extract(F.col("cells")[0], r"^Comuna (\d+)$", 1)
    return read.where(zone != "").select(F.regexp_replace("workbook", r"\.xlsx$", "").alias("segment"), zone.cast("long").alias("zone"), F.col("cells")[2].try_cast("long").alias("n"))


@query("s16_workbook_set", "SELECT CAST(c_nationkey AS BIGINT) AS zone, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1, 2")
def s16_workbook_set(spark: SparkSession, d: str) -> DataFrame:
    """Zip files, each a set of workbooks: of each the sheet whose name holds "datos", its first columns below the header."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for segment, part in rows.groupby("segment"):
                table = [["Zona", "Segmento", "Cantidad", "Unidad", "Nota"], *[[int(k), segment, int(n), "personas", "x"] for k, n in zip(part["zone"], part["n"])]]
                z.writestr(f"set/{segment}.xlsx", workbooks.workbook_bytes({"Indice": [["Datos"]], "Datos 2024": table, "Final": [[0, "?", 0, "?"]]}))
        return pd.DataFrame({"path": [f"set-{rows['box'].iloc[0]}.zip"], "content": [out.getvalue()]})

    sets = _counts(spark, d).withColumn("box", F.col("zone") % 5).groupBy("box").applyInPandas(pack, _FILES)
    read = workbooks.workbook_rows(sets, "datos", 4).where("row > 1")
    return read.select(F.col("cells")[0].try_cast("long").alias("zone"), F.col("cells")[1].alias("segment"), F.col("cells")[2].try_cast("long").alias("n"))
