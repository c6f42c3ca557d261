"""Debounce on a stream: batch after batch, one key with a third of all events."""

import datetime as dt
import random

from pyspark.sql import functions as F

from shiftframe.functions.workspace import new_path
from shiftframe.streaming.debounce import debounce_slots_stream, debounce_stream, run_to_table

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
KINDS = "user_id long, event_id long, ts timestamp, note string"


def written(spark, batches):
    """One file per batch, in order of time."""
    path = new_path(spark, "stream-input")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, KINDS).coalesce(1).write.parquet(f"{path}/part={n:03d}")
    return spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def expected(rows, delay, watermark):
    """Ids of the events that nothing of their key follows within the delay, in slots closed at the end."""
    newest = max(r[2] for r in rows) - watermark
    by_key = {}
    for r in rows:
        by_key.setdefault(r[0], []).append(r)
    kept = set()
    for own in by_key.values():
        own.sort(key=lambda r: (r[2], r[1]))
        for r, after in zip(own, [*own[1:], None]):
            slot = START + (r[2] - START) // delay * delay
            if (after is None or after[2] - r[2] >= delay) and slot + 2 * delay <= newest:
                kept.add(r[1])
    return kept


def test_slots_over_many_batches(spark):
    draw = random.Random(5)
    delay, watermark = dt.timedelta(seconds=10), dt.timedelta(seconds=30)
    rows, now = [], START
    for event in range(3000):
        now += dt.timedelta(milliseconds=draw.choice([0, 700, 1000, 9000]))
        user = 0 if event % 3 == 0 else draw.randrange(1, 60)
        rows.append((user, event, now, f"n{event}"))
    # exactly the delay apart, on the edge of a slot, and equal times
    now = START + (now - START) // delay * delay + 20 * delay
    rows += [(99, 9000, now, None), (99, 9001, now + delay, None), (99, 9002, now + delay, "last")]
    rows += [(98, 9003, now + dt.timedelta(hours=1), None)]
    batches = [rows[i : i + 700] for i in range(0, len(rows), 700)]
    stream = debounce_slots_stream(written(spark, batches), delay_ms=10_000, watermark="30 seconds")
    assert stream.columns == ["user_id", "event_id", "ts", "note"]
    found = run_to_table(stream, "slots").collect()
    assert sorted(r.event_id for r in found) == sorted(expected(rows, delay, watermark))
    assert {9000, 9002} <= {r.event_id for r in found} and 9001 not in {r.event_id for r in found}
    assert all(r.note == f"n{r.event_id}" for r in found if r.event_id < 3000)


def test_late_events_nulls_and_no_rows(spark):
    at = [START + dt.timedelta(seconds=s) for s in (0, 500, 1, 1000)]
    # the last batch is later than the watermark, which holds from the batch after the one that moves it
    batches = [[(1, 1, at[0], "a"), (1, 7, None, "x"), (None, 8, at[0], "y")], [(1, 2, at[1], "b")], [(2, 4, at[3], "c")], [(1, 3, at[2], "late")]]
    for run in (debounce_slots_stream, debounce_stream):
        found = run_to_table(run(written(spark, batches), delay_ms=10_000, watermark="30 seconds"), "late").collect()
        assert sorted(r.event_id for r in found) == [1, 2, 8]
    empty = written(spark, [[]])
    assert run_to_table(debounce_slots_stream(empty), "none").count() == 0


def test_state_of_one_key_is_spread(spark):
    """All events belong to one key; the first step's state rows lie in more than one partition."""
    rows = [(1, n, START + dt.timedelta(seconds=n), "") for n in range(400)]
    stream = debounce_slots_stream(written(spark, [rows]), delay_ms=10_000, watermark="1000 seconds")
    path = new_path(spark, "spread")
    query = (
        stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    states = [o["numRowsTotal"] for o in query.lastProgress["stateOperators"]]
    assert max(states) == 40  # one row per slot, not per event
    state = spark.read.format("statestore").option("operatorId", 1).load(f"{path}/checkpoint")
    if state.count() != 40:
        state = spark.read.format("statestore").option("operatorId", 0).load(f"{path}/checkpoint")
    assert state.count() == 40 and state.select(F.countDistinct("partition_id")).first()[0] > 1
