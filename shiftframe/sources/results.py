"""Nested prediction responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftframe.schemas import PREDICTION_RESPONSE


def read_responses(spark: SparkSession, path: str, *, format: str = "json") -> DataFrame:
    """Responses with the fixed schema; nothing is inferred."""
    return spark.read.schema(PREDICTION_RESPONSE).format(format).load(path)


def engine_headers(responses: DataFrame, *keep: str) -> DataFrame:
    """One row per engine of each response."""
    return responses.select(*keep, F.explode("engines").alias("engine", "_r")).select(
        *keep, "engine", "_r.status", "_r.message", F.coalesce(F.size("_r.shifts"), F.lit(0)).alias("n_shifts")
    )


def engine_shifts(responses: DataFrame, *keep: str) -> DataFrame:
    """One row per engine and shift; an engine without shifts keeps one row with null fields."""
    opened = responses.select(*keep, F.explode("engines").alias("engine", "_r"))
    return opened.select(*keep, "engine", "_r.status", "_r.message", F.inline_outer("_r.shifts"))


def consensus_shifts(responses: DataFrame, *keep: str) -> DataFrame:
    """One row per merged shift."""
    return responses.select(*keep, F.inline("consensus.shifts"))
