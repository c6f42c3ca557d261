"""Debounce on an unbounded table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftframe.constants import DEBOUNCE_MILLISECONDS
from shiftframe.functions.workspace import new_path


def debounce_stream(
    events: DataFrame,
    *,
    keys: Sequence[str] = ("user_id",),
    ts: str = "ts",
    tie: str = "event_id",
    delay_ms: int = DEBOUNCE_MILLISECONDS,
    watermark: str = "1 minute",
) -> DataFrame:
    """The last event of every session of a key, once the watermark has passed its end.

    A session ends when nothing follows for the delay. Only the latest event of an open session is kept in state.
    Events later than the watermark are dropped by the engine.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    payload = [c for c in events.columns if c not in keys]
    last = F.max(F.struct(ts, tie, *[c for c in payload if c not in (ts, tie)])).alias("_last")
    sessions = timed.groupBy(*keys, F.session_window(ts, f"{delay_ms} milliseconds")).agg(last)
    return sessions.select(*[F.col(c) if c in keys else F.col(f"_last.{c}") for c in events.columns])


def debounce_slots_stream(
    events: DataFrame,
    *,
    keys: Sequence[str] = ("user_id",),
    ts: str = "ts",
    tie: str = "event_id",
    delay_ms: int = DEBOUNCE_MILLISECONDS,
    watermark: str = "1 minute",
) -> DataFrame:
    """The events ``debounce`` keeps, each once the watermark has passed the end of the time slot after its own.

    Slots are as long as the delay. The first step keeps per key and slot its first time and its last event; the slot is
    part of the state's key, so a key with very many events lies in as many state partitions as it has open slots, and
    is reduced before it is shuffled. The second step joins each slot with the one after it, in windows of two slots:
    the last event of the earlier slot is kept unless the first of the later one comes within the delay. It sees one row
    per key and slot. Events later than the watermark are dropped by the engine, and so are those without a time.
    """
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    payload = [c for c in events.columns if c not in keys]
    slot, two = f"{delay_ms} milliseconds", f"{2 * delay_ms} milliseconds"
    slots = timed.groupBy(*keys, F.window(ts, slot).alias("window")).agg(
        F.min(ts).alias("_first"), F.max(F.struct(ts, tie, *[c for c in payload if c not in (ts, tie)])).alias("_last")
    )
    pairs = F.window("window", two, slot)
    begin = F.unix_micros("window.start")
    tagged = slots.select(*keys, "window", "_first", "_last", begin.alias("_begin"))
    met = tagged.groupBy(*keys, pairs.alias("_pair")).agg(
        F.min_by("_last", "_begin").alias("_earlier"),
        F.min("_begin").alias("_begin"),
        F.max_by("_first", "_begin").alias("_next"),
        F.count(F.lit(1)).alias("_slots"),
    )
    here = F.col("_begin") == F.unix_micros("_pair.start")
    far = F.unix_micros("_next") - F.unix_micros(F.col(f"_earlier.{ts}")) >= delay_ms * 1000
    kept = met.where(here & ((F.col("_slots") == 1) | far))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_earlier.{c}") for c in events.columns])


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process what is available now, append it to a table in the shared folder, and read that."""
    spark: SparkSession = stream.sparkSession
    path = new_path(spark, name)
    running = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
