"""Column helpers on text that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftframe.functions.workspace import materialize

#: A table is marked for broadcast only when a count has shown that it has at most this many rows.
BROADCAST_ROWS = 300_000

#: Fixed value: what separates words for word counts, fingerprints and the language model.
SPACE = r"\x20\x09-\x0D"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_or_shuffled(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Write ``df`` down, count it, and mark it for broadcast if it has at most ``most`` rows.

    Beyond that the join that uses it shuffles; the result is the same.
    """
    stored = materialize(df, name)
    return F.broadcast(stored) if stored.count() <= most else stored
