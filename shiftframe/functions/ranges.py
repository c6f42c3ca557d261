"""Ordered work inside groups over ranges of equal size.

All rows are dealt once into ranges of about equal count, by group, order and a hash of the whole row, so neither a group
that holds most rows nor a value that most rows share makes one range larger than the others. A task passes over its
range in order and keeps sums per group. A group that begins in an earlier range gets the sums from there: one row per
range, as only a range's last group can go on in the next.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftframe.functions.parts import parts_by_size
from shiftframe.functions.workspace import materialize

# What a row is in its range: nothing, the first, the last, or both.
FIRST, LAST = 1, 2


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows dealt into ranges by keys, order and row hash, sorted so inside each; their number grows with the files read."""
    hashed = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    place = [*[F.col(k) for k in keys], *order, F.xxhash64(*hashed)]
    return df.repartitionByRange(parts_by_size(df), *place).sortWithinPartitions(*place)


def changes(column: pa.Array, before: pa.Array | None) -> np.ndarray:
    """Where a value differs from the one before it; nulls are equal, and so are NaNs. ``before`` holds one value."""
    led = pa.concat_arrays([before if before is not None else column[:1], column[:-1]])
    differ = pc.fill_null(pc.not_equal(column, led), False)
    if pa.types.is_floating(column.type):
        differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(column), pc.is_nan(led)), False))
    differ = pc.or_(differ, pc.not_equal(pc.is_null(column), pc.is_null(led)))
    return differ.to_numpy(zero_copy_only=False)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column]) -> DataFrame:
    """Add inclusive running sums over each group in ``order``; a null adds nothing.

    Sums of whole numbers are long, others double. Nulls among the keys are one group, rows that ``order`` does not tell
    apart are in the order of their hashes. The ranges come from a sample, so what was summed inside them is written to
    the shared folder before it is read again, which runs when this is called.
    """
    names = list(sums)
    asked = df.select("*", *[c.alias(f"_in_{n}") for n, c in sums.items()])
    whole = {n: isinstance(asked.schema[f"_in_{n}"].dataType, T.IntegralType) for n in names}
    kinds = {n: T.LongType() if whole[n] else T.DoubleType() for n in names}
    asked = asked.withColumns({f"_in_{n}": F.coalesce(F.col(f"_in_{n}").cast(kinds[n]), F.lit(0)) for n in names})
    added = [*[T.StructField(n, kinds[n]) for n in names], T.StructField("_range", T.IntegerType()), T.StructField("_edge", T.IntegerType()), T.StructField("_opening", T.BooleanType())]
    columns = df.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, opening = TaskContext.get().partitionId(), True
        # the batch that may be the last one of the range, and its marks
        held: tuple[list[pa.Array], np.ndarray, np.ndarray] | None = None
        last: dict[str, pa.Array] = {}
        reached = {n: 0 for n in names}

        def told(arrays: list[pa.Array], edge: np.ndarray, opens: np.ndarray) -> pa.RecordBatch:
            extra = [pa.array(np.full(len(edge), number, dtype=np.int32)), pa.array(edge), pa.array(opens)]
            return pa.RecordBatch.from_arrays([*arrays, *extra], names=[*columns, *[f.name for f in added]])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, dtype=bool)
            for k in keys:
                new |= changes(batch.column(k), last.get(k))
                last[k] = batch.column(k)[-1:]
            starts = np.flatnonzero(new)
            group = np.cumsum(new)
            opens = np.full(n, opening)
            if len(starts):
                opens[starts[0] :] = opening = False
            found = []
            for name in names:
                value = batch.column(f"_in_{name}").to_numpy(zero_copy_only=False)
                total = np.cumsum(value)
                before = np.concatenate([[-reached[name]], total[starts] - value[starts]]).astype(value.dtype)
                own = total - before[group]
                reached[name] = own[-1]
                found.append(pa.array(own))
            edge = np.zeros(n, dtype=np.int32)
            if held is None:
                edge[0] = FIRST
            else:
                yield told(*held)
            held = [*[batch.column(c) for c in columns], *found], edge, opens
        if held is not None:
            held[1][-1] += LAST
            yield told(*held)

    scanned = in_ranges(asked, keys, order).mapInArrow(scan, T.StructType([*df.schema.fields, *added]))
    stored = materialize(scanned, "ranges")
    of = [F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]
    keyed = [f"_key_{i}" for i in range(len(keys))]
    # per group and range: first what is carried into the range is asked for, then what the range adds is told
    ask = F.struct(F.lit(0).alias("_turn"), *[F.lit(0).cast(kinds[n]).alias(f"_sum_{n}") for n in names])
    tell = F.struct(F.lit(1).alias("_turn"), *[F.col(n).alias(f"_sum_{n}") for n in names])
    edge = F.col("_edge")
    turns = F.when(edge == FIRST, F.array(ask)).when(edge == LAST, F.array(tell)).otherwise(F.array(ask, tell))
    marked = stored.where(edge > 0).select("_range", *of, F.inline(turns))
    earlier = Window.partitionBy(*keyed).orderBy("_range", "_turn").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.select("_range", "_turn", *[F.sum(f"_sum_{n}").over(earlier).alias(f"_before_{n}") for n in names])
    carried = carried.where("_turn = 0").select(F.col("_range").alias("_to"), *[f"_before_{n}" for n in names])
    # one row per range
    told = stored.join(F.broadcast(carried), F.col("_opening") & (F.col("_range") == F.col("_to")), "left")
    return told.select(*columns, *[(F.col(n) + F.coalesce(f"_before_{n}", F.lit(0))).alias(n) for n in names])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, *, start: int = 1) -> DataFrame:
    """Consecutive numbers from ``start`` within each group, in ``order`` (see ``running``)."""
    counted = running(df, keys, order, {name: F.lit(1).cast("long")})
    return counted.withColumn(name, F.col(name) + (start - 1))
