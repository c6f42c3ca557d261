"""Values that stay unchanged for a while."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe.constants import DEBOUNCE_MILLISECONDS


def debounce(
    events: DataFrame,
    *,
    keys: Sequence[str] = ("user_id",),
    ts: str = "ts",
    tie: str = "event_id",
    delay_ms: int = DEBOUNCE_MILLISECONDS,
) -> DataFrame:
    """Events followed by no other event of their key for at least the delay.

    Time is cut into slots of the delay's length. Two events in one slot are closer than the delay, so only the last
    event of a slot can survive; and only an event of the next slot can come too early for it. Each slot is reduced to
    one row on the map side, and then learns the first event of the slot after it. Nothing is ordered within a key, so
    a key with very many events is as well spread as many keys.
    """
    delay_us = delay_ms * 1000
    payload = [c for c in events.columns if c not in keys]
    timed = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    slots = timed.groupBy(*keys, F.floor(F.col("_us") / delay_us).alias("_slot")).agg(
        F.min("_us").alias("_first"), F.max(F.struct("_us", tie, *[c for c in payload if c != tie])).alias("_last")
    )
    told = F.array(
        F.struct(F.col("_slot"), F.col("_last"), F.lit(None).cast("long").alias("_next")),
        F.struct(
            (F.col("_slot") - 1).alias("_slot"), F.when(F.lit(False), F.col("_last")).alias("_last"), F.col("_first").alias("_next")
        ),
    )
    met = slots.select(*keys, F.inline(told)).groupBy(*keys, "_slot").agg(
        F.max("_last").alias("_last"), F.min("_next").alias("_next")
    )
    return met.where(
        F.col("_last").isNotNull() & (F.col("_next").isNull() | (F.col("_next") - F.col("_last._us") >= delay_us))
    ).select(*[F.col(c) if c in keys else F.col(f"_last.{c}") for c in events.columns])
