"""Readers of dirty files: headers, separators, encodings, null tokens, yearly files, zip members, GeoJSON, JSON APIs."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normalize_columns(df: DataFrame, aliases: Mapping[str, str] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """Headers trimmed, lower-cased and without a byte-order mark, renamed by aliases; required ones must be there."""
    names = [(aliases or {}).get(n, n) for n in (c.lstrip("﻿").strip().strip('"').lower() for c in df.columns)]
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"missing columns {missing}; found {names}")
    if len(set(names)) < len(names):
        raise ValueError(f"columns share a name: {names}")
    return df.toDF(*names)


def read_delimited(spark: SparkSession, path: str | Sequence[str], sep: str = ",", encoding: str = "UTF-8", null: str | None = None, aliases: Mapping[str, str] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """A delimited file with a header, all columns text; bad lines are dropped. encoding is a JVM name (IBM850)."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "DROPMALFORMED")
    if null is not None:
        reader = reader.option("nullValue", null)
    return normalize_columns(reader.csv(path), aliases, required)


def decimal_comma(text: Column) -> Column:
    """A number written with a decimal comma; null if it is none."""
    return F.regexp_replace(text, ",", ".").try_cast("double")


def read_yearly(spark: SparkSession, paths: Sequence[str], aliases: Mapping[str, str], required: Sequence[str], **options) -> DataFrame:
    """Yearly files under one schema: each file's headers normalised, its year (from the name) added, then a union."""
    out = None
    for path in paths:
        x = read_delimited(spark, path, aliases=aliases, required=required, **options).select(*required)
        x = x.withColumn("anio_archivo", F.regexp_extract(F.input_file_name(), r"(\d{4})[^/]*$", 1).try_cast("int"))
        out = x if out is None else out.unionByName(x)
    if out is None:
        raise ValueError("no files")
    return out


def read_zip_members(spark: SparkSession, path: str, columns: Sequence[str], member: str = r"\.csv$", partitions: int = 8) -> DataFrame:
    """Rows of the delimited members of zip files as text columns and `member`; one row of work for each zip file.

    Separators are told from the header line (the commonest of `;`, `,`, tab), marks and quotes are stripped, and zip
    files that are broken give no rows. Members stream line by line.
    """
    schema = ", ".join([*[f"`{c}` string" for c in columns], "member string"])
    files = spark.read.format("binaryFile").load(path).select("content").repartition(partitions)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield from _members(bytes(content), columns, member)

    return files.mapInPandas(rows, schema)


def _members(content: bytes, columns: Sequence[str], member: str) -> Iterator[pd.DataFrame]:
    import re

    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        if archive.testzip() is not None:
            return
    except zipfile.BadZipFile:
        return
    for name in archive.namelist():
        if not re.search(member, name, re.IGNORECASE):
            continue
        with io.TextIOWrapper(archive.open(name), encoding="utf-8-sig", errors="replace", newline="") as lines:
            header = lines.readline()
            sep = max(";,\t", key=header.count)
            names = [h.strip().strip('"').lower() for h in header.rstrip("\r\n").split(sep)]
            place = [names.index(c) if c in names else None for c in columns]
            chunk: list[list[str | None]] = []
            for row in csv.reader(lines, delimiter=sep):
                if len(row) == len(names):
                    chunk.append([row[k].strip().strip('"') if k is not None else None for k in place] + [name])
                if len(chunk) >= 20_000:
                    yield pd.DataFrame(chunk, columns=[*columns, "member"])
                    chunk = []
            if chunk:
                yield pd.DataFrame(chunk, columns=[*columns, "member"])


def read_geojson(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """Features of GeoJSON files: the named properties as text, and lon and lat of points."""
    fields = ", ".join(f"`{p}`: string" for p in properties)
    shape = f"struct<features: array<struct<properties: struct<{fields}>, geometry: struct<type: string, coordinates: string>>>>"
    text = spark.read.option("wholetext", True).text(path)
    f = text.select(F.explode(F.from_json("value", shape)["features"]).alias("f"))
    at = F.from_json(F.col("f.geometry.coordinates"), "array<double>")
    return f.select(*[F.col(f"f.properties.{p}").alias(p) for p in properties], F.when(F.col("f.geometry.type") == "Point", F.get(at, F.lit(0))).alias("lon"), F.when(F.col("f.geometry.type") == "Point", F.get(at, F.lit(1))).alias("lat"))


def read_series_api(spark: SparkSession, path: str, names: Mapping[str, str], missing: float = -999) -> DataFrame:
    """A JSON answer {series: {date: value}} as fecha and one column for each series; the missing sign becomes null."""
    shape = "struct<" + ", ".join(f"`{s}`: map<string, double>" for s in names) + ">"
    doc = spark.read.option("wholetext", True).text(path).select(F.from_json("value", shape).alias("d"))
    long = None
    for series, name in names.items():
        x = doc.select(F.explode(F.col(f"d.{series}")).alias("k", "v")).select("k", F.lit(name).alias("name"), F.nullif(F.col("v"), F.lit(float(missing))).alias("v"))
        long = x if long is None else long.unionAll(x)
    return long.groupBy(F.to_date("k", "yyyyMMdd").alias("fecha")).pivot("name", list(names.values())).agg(F.max("v"))


def cached(path: str, fetch: Callable[[str], None], valid: Callable[[str], bool] | None = None, tries: int = 3) -> str:
    """The path of a file, fetched by the caller's function unless a valid one is there; retried on errors."""
    import os

    for attempt in range(tries):
        if os.path.exists(path) and (valid is None or valid(path)):
            return path
        try:
            fetch(path)
        except OSError:
            if attempt == tries - 1:
                raise
    raise OSError(f"{path} is not valid after {tries} tries")


def normalise_flow(df: DataFrame, lines: str = r"^(?i:linea)[ _]*") -> DataFrame:
    """fecha, hora, estacion, linea, cantidad of a raw ridership file, whatever its year's headers.

    The measure is the column whose name holds `total` or `cantidad`, one with `pax` first; the hour comes from `desde`
    (HH:MM:SS) or `hora`; dates are day first. Rows without date, hour or measure are dropped.
    """
    x = normalize_columns(df)
    found = sorted((c for c in x.columns if "total" in c or "cantidad" in c), key=lambda c: ("pax" not in c, c))
    hour = next((c for c in ("desde", "hora") if c in x.columns), None)
    if not found or hour is None:
        raise ValueError(f"no measure or no hour in {x.columns}")
    day = F.coalesce(*[F.try_to_date("fecha", f) for f in ("d/M/yyyy", "yyyy-MM-dd")])
    out = x.select(day.alias("fecha"), F.split(F.col(hour).cast("string"), ":").getItem(0).try_cast("int").alias("hora"), "estacion", F.regexp_replace("linea", lines, "").alias("linea"), F.col(found[0]).try_cast("double").alias("cantidad"))
    return out.where("fecha IS NOT NULL AND hora IS NOT NULL AND cantidad IS NOT NULL")


def split_frames(df: DataFrame, year: str, columns: Sequence[str], train_to: int, val: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test rows of a table by year, with just the columns asked for."""
    x = df.select(*columns, F.col(year).alias("__y"))
    return tuple(x.where(c).drop("__y") for c in (F.col("__y") <= train_to, F.col("__y") == val, F.col("__y") > val))
