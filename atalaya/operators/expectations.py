"""Checks that abort, and a run log: integrity of inputs and a record of what was fitted."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def expect(df: DataFrame, **conditions: str) -> DataFrame:
    """df, failing at run time with the condition's name where a row breaks it (null counts as broken)."""
    out = df
    for name, sql in conditions.items():
        out = out.where(F.assert_true(F.coalesce(F.expr(sql), F.lit(False)), F.lit(f"expectation {name}: {sql}")).isNull())
    return out


def expect_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, if no key occurs twice; else a ValueError. Nulls are keys too."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"keys {list(keys)} are not unique")
    return df


def expect_total(df: DataFrame, column: str, total: float, tolerance: float = 0.001) -> DataFrame:
    """df, if the column sums to the total within a relative tolerance; else a ValueError."""
    got = df.agg(F.sum(column)).first()[0] or 0
    if abs(got - total) > tolerance * max(1, abs(total)):
        raise ValueError(f"{column} sums to {got}, expected {total}")
    return df


def log_run(spark: SparkSession, path: str, name: str, params: Mapping[str, object], metrics: Mapping[str, float]) -> None:
    """Append one run to a Parquet table: name, time, parameters and metrics."""
    row = [(name, {k: str(v) for k, v in params.items()}, {k: float(v) for k, v in metrics.items()})]
    spark.createDataFrame(row, "name string, params map<string,string>, metrics map<string,double>").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
