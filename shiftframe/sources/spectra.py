"""Spectra on disk: points partitioned by nucleus, and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_spectra(points: DataFrame, meta: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """``points`` and ``meta`` both carry a nucleus column."""
    points.write.mode(mode).partitionBy("nucleus").parquet(f"{path}/points")
    meta.write.mode(mode).partitionBy("nucleus").parquet(f"{path}/meta")


def read_spectra(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/meta")
