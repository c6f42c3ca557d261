"""Rosters and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe import constants as C


def roster_join(requested: DataFrame, roster: DataFrame, *, engine: str = "engine") -> DataFrame:
    """Requested engines with status pending and a message where the roster has no implementation."""
    known = roster.select(engine, F.col("implemented").alias("_implemented"))
    missing = ~F.coalesce("_implemented", F.lit(False))
    return requested.join(known, engine, "left").select(
        *requested.columns,
        F.when(missing, "pending").alias("status"),
        F.when(missing, F.format_string(C.MESSAGE_ENGINE_PENDING, engine)).alias("message"),
    )


def first_ready(roster: DataFrame, n: int = 2, *, engine: str = "engine", ready: str = "ready") -> DataFrame:
    """The first ``n`` ready engines of the roster, which is ordered by name."""
    return roster.where(F.col(ready)).orderBy(engine).limit(n)


def engine_summary(
    signals: DataFrame, *, nucleus: str = "1H", engine: str = "engine", keys: Sequence[str] = ()
) -> DataFrame:
    """Signals and protons per engine, and a row with a null engine for the total of each key."""
    protons = F.sum("integration") if nucleus == "1H" else F.lit(None).cast("long")
    table = signals.rollup(*keys, engine).agg(
        F.count(F.lit(1)).alias("n_signals"),
        protons.alias("protons"),
        F.grouping(engine).cast("int").alias("is_total"),
        *[F.grouping(k).alias(f"_g_{k}") for k in keys],
    )
    for k in keys:
        table = table.where(F.col(f"_g_{k}") == 0).drop(f"_g_{k}")
    return table
