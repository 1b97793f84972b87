"""The folder that the cluster shares: lineage cut there, raw files written there."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether shuffle files go at the end of the query that made them, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, what a write shuffles is deleted as soon as it is written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder; cached on one machine where no folder is set (tests)."""
    spark = df.sparkSession
    sc, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if folder and not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    if sc.getCheckpointDir():
        return df.checkpoint()
    _alone(spark)
    return df.cache()


def stored(df: DataFrame) -> DataFrame:
    """df as columns in the shared folder, read back: as cut, for tables too large for rows that are not compressed."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/table-{uuid.uuid4().hex}"
    with without_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a written table that nothing will read again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> str:
    """The shared folder; one of its own where none is set and one machine does all (tests)."""
    sc, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        _alone(spark)
        folder = sc._atalaya_scratch = getattr(sc, "_atalaya_scratch", None) or tempfile.mkdtemp(prefix="spark-scratch-")
    return folder.rstrip("/")


def _alone(spark: SparkSession) -> None:
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
