"""Helpers that the operators share: scratch tables, row keys, Arrow text buffers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import discard, without_shuffles  # noqa: F401

#: Columns of the documents table, in order.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The scratch folder that all executors share; one of its own only where one machine does all and none is named (tests)."""
    where, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = sc._text_scratch = getattr(sc, "_text_scratch", None) or tempfile.mkdtemp(prefix="spark-shared-")
    return where


def written(df: DataFrame, name: str, unique: Iterable[str] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors. unique: columns without a dictionary."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with without_shuffles(df.sparkSession):
        df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in unique if c in df.columns}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)


#: Rows of keys (a few dozen bytes each) that may be broadcast; larger sides are joined by shuffle.
BROADCAST_ROWS = 200_000


def sized(keys: DataFrame) -> DataFrame:
    """keys, which should be a written table, marked for broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def documents(df: DataFrame) -> DataFrame:
    """(doc_id, text) of a documents table, without any other column it may carry."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def row_key(*cols: Column) -> Column:
    """A 64-bit key of the given values; nulls count, so that (null, 'a') and ('a', null) differ."""
    return F.xxhash64(*[x for c in cols for x in (c, c.isNull())])


def held_out(doc_id: Column) -> Column:
    """The rows kept from training: crc32(doc_id as text) mod 5 = 0; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; nulls are empty. No Python strings are made."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8) if offs else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes stay near limit; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def batches(rows: Iterable[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the incoming batches with the bytes of column 'text': (slice, bytes, offsets from 0)."""
    for batch in rows:
        if batch.num_rows:
            data, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            for i, j in pieces(offsets, limit):
                yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
