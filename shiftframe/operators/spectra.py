"""Spectra from lines."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftframe import constants as C
from shiftframe.functions.ranges import changes
from shiftframe.functions.skew import join_on

CHUNK_LINES = 65_536
TILE_POINTS, TILE_CELLS = 4096, 131_072  # what the kernel has in the cache at a time
CELL_POINTS = 128  # of the smallest cells of lines
SERIES_TERMS = 30  # 31 / 4^30 is below the precision of a double
SERIES_LINES = 32  # up to so many lines of a cell are quicker to sum one by one


def shared_domain(
    lines: DataFrame, spectra: DataFrame, *, nucleus: str, keys: Sequence[str] = ("spec_id",), position: str = "shift"
) -> DataFrame:
    """(keys, low, high): the range of the lines with a margin, inside the default domain; the default without lines."""
    default_low, default_high = C.DOMAIN_PPM.get(nucleus, C.OTHER_DOMAIN_PPM)
    margin = C.DOMAIN_MARGIN_1H_PPM if nucleus == "1H" else C.DOMAIN_MARGIN_OTHER_PPM
    extent = lines.where(~F.isnan(position)).groupBy(*keys).agg(F.min(position).alias("_min"), F.max(position).alias("_max"))

    def inside(value: Column) -> Column:
        return F.least(F.lit(default_high), F.greatest(F.lit(default_low), value))

    return spectra.select(*keys).distinct().join(extent, list(keys), "left").select(
        *keys,
        F.when(F.col("_min").isNull(), default_low).otherwise(inside(F.col("_min") - margin)).alias("low"),
        F.when(F.col("_max").isNull(), default_high).otherwise(inside(F.col("_max") + margin)).alias("high"),
    )


def line_width(nucleus: str, std: Column) -> Column:
    """Line width, broadened by the spread of the predictions."""
    width = C.LINE_WIDTH_PPM.get(nucleus, C.OTHER_LINE_WIDTH_PPM)
    return width + F.greatest(F.lit(0.0), F.coalesce(std, F.lit(0.0)) * C.STD_BROADENING)


def spectrum_axis(
    domains: DataFrame, *, nucleus: str, points: int | None = None, keys: Sequence[str] = ("spec_id",)
) -> DataFrame:
    """Evenly spaced positions (keys, i, x) from low to high."""
    n = points or C.SPECTRUM_POINTS.get(nucleus, C.OTHER_SPECTRUM_POINTS)
    step = (F.col("high") - F.col("low")) / max(1, n - 1)
    return domains.select(*keys, "low", step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(
        *keys, "i", (F.col("low") + F.col("i") * F.col("_step")).alias("x")
    )


def _add_near(y: np.ndarray, x: np.ndarray, center: np.ndarray, weight: np.ndarray, squared: np.ndarray) -> None:
    """Add weight / ((x - center)^2 + squared) of every line to ``y``, in tiles that stay in the cache."""
    for at in range(0, len(x), TILE_POINTS):
        part, own = x[at : at + TILE_POINTS], y[at : at + TILE_POINTS]
        strip = max(1, TILE_CELLS // len(part))
        for first in range(0, len(center), strip):
            lines = slice(first, first + strip)
            delta = part[None, :] - center[lines, None]
            delta *= delta
            delta += squared[lines, None]
            np.reciprocal(delta, out=delta)
            own += weight[lines] @ delta


def _add_lines(y: np.ndarray, low: float, step: float, center: np.ndarray, height: np.ndarray, half: np.ndarray) -> None:
    """Add Lorentzian lines to the points ``low + i * step``; half widths are above zero.

    A line is height * half * Im 1 / (x - z) with z = center + half * i. Lines are gathered in cells some points wide, wider ones for
    broader lines. At points four radii from the middle of a cell and beyond, the sum over its lines is a power series in
    radius / (x - middle), whose rest after ``SERIES_TERMS`` terms is below the precision of a double; nearer points
    and cells of few lines are summed line by line.
    """
    n = len(y)
    x = low + np.arange(n) * step
    weight, squared = height * half * half, half * half
    left, sound, wide = np.ones(len(center), dtype=bool), np.isfinite(center) & np.isfinite(weight) & (step > 0), CELL_POINTS
    while wide * 6 < n and left.any():
        size = wide * step
        own = np.flatnonzero(left & sound & (half <= size / 2) & (np.abs(center - low) < size * 2**40))
        left[own] = False
        cell = np.floor((center[own] - low) / size).astype(np.int64)
        own = own[np.argsort(cell, kind="stable")]
        cells, starts = np.unique(np.sort(cell), return_index=True)
        radius = size / np.sqrt(2)
        for place, begin, end in zip(cells, starts, [*starts[1:], len(own)]):
            lines = own[begin:end]
            if len(lines) <= SERIES_LINES:
                _add_near(y, x, center[lines], weight[lines], squared[lines])
                continue
            middle = low + (place + 0.5) * size
            first, last = np.searchsorted(x, [middle - 4 * radius, middle + 4 * radius])
            _add_near(y[first:last], x[first:last], center[lines], weight[lines], squared[lines])
            z = ((center[lines] - middle) + 1j * half[lines]) / radius
            power, sums = np.ones(len(lines), dtype=complex), []
            for _ in range(SERIES_TERMS):
                power *= z
                sums.append((height[lines] * half[lines]) @ power.imag)
            for far in (slice(0, first), slice(last, n)):
                t = radius / (x[far] - middle)
                total = np.full(len(t), sums[-1])
                for term in sums[-2::-1]:
                    total *= t
                    total += term
                total *= t
                total *= t
                total /= radius
                y[far] += total
        wide *= 4
    _add_near(y, x, center[left], weight[left], squared[left])


def _sampler(keys: Sequence[str], n: int, normalize: bool):
    """mapInArrow function: lines in order of spectrum and chunk to the points of each.

    A task keeps one running vector and the lines that are not yet in it, until the next spectrum or chunk begins.
    """
    names = list(keys)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[pa.Array], float, float] | None = None  # keys, low, high
        last: dict[str, pa.Array] = {}
        y, waiting, count = np.zeros(n), [], 0

        def drawn() -> None:
            nonlocal waiting, count
            if waiting:
                _add_lines(y, held[1], (held[2] - held[1]) / max(1, n - 1), *(np.concatenate(part) for part in zip(*waiting)))
            waiting, count = [], 0

        def told() -> pa.RecordBatch:
            drawn()
            top = y.max() if n else 0.0
            values = y / top if normalize and top > 0 else y.copy()
            x = held[1] + np.arange(n) * ((held[2] - held[1]) / max(1, n - 1))
            owned = [k.take(pa.array(np.zeros(n, dtype=np.int64))) for k in held[0]]
            return pa.RecordBatch.from_arrays([*owned, pa.array(np.arange(n, dtype=np.int32)), pa.array(x), pa.array(values)], names=[*names, "i", "x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            for k in (*names, "_chunk"):
                new |= changes(batch.column(k), last.get(k))
                last[k] = batch.column(k)[-1:]
            new[0] |= held is None
            low, high = (batch.column(c).to_numpy() for c in ("low", "high"))
            center, height, width = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shift", "intensity", "width"))
            half = np.abs(width) / 2
            some = ~np.isnan(center) & (half * half != 0)
            cuts = np.flatnonzero(new)
            for begin, end in zip([*([] if new[0] else [0]), *cuts], [*cuts[(1 if new[0] else 0) :], batch.num_rows]):
                if new[begin]:
                    if held is not None:
                        yield told()
                    held = [batch.column(k)[begin : begin + 1] for k in names], low[begin], high[begin]
                    y = np.zeros(n)
                own = begin + np.flatnonzero(some[begin:end])
                waiting.append((center[own], height[own], half[own]))
                count += len(own)
                if count >= CHUNK_LINES:
                    drawn()
        if held is not None:
            yield told()

    return sample


def spectrum_synthesis(
    lines: DataFrame,
    domains: DataFrame,
    *,
    nucleus: str,
    points: int | None = None,
    keys: Sequence[str] = ("spec_id",),
    chunk_lines: int = CHUNK_LINES,
) -> DataFrame:
    """Points (keys, i, x, y): the sum of Lorentzian lines (shift, intensity, width), highest point scaled to 1.

    Lines are dealt by spectrum, those of a very large one in chunks of about ``chunk_lines``; a task draws each chunk
    into one vector and emits it once. A spectrum of one chunk is finished there, with no further shuffle; the chunks of
    a larger one add up point by point. Lines with a null or NaN in place, height or width are left out, as are lines
    of width zero.
    """
    n = points or C.SPECTRUM_POINTS.get(nucleus, C.OTHER_SPECTRUM_POINTS)
    keys = list(keys)
    kinds = {f.name: f.dataType for f in domains.schema.fields}
    out = T.StructType(
        [T.StructField(k, kinds[k]) for k in keys]
        + [T.StructField("i", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]
    )
    names = ("shift", "intensity", "width")
    sound = lines.select(*keys, *[F.col(name).cast("double").alias(name) for name in names])
    for name in names:
        sound = sound.where(F.col(name).isNotNull() & ~F.isnan(name))
    sizes = sound.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / chunk_lines).alias("_chunks"))
    spans = join_on(domains.select(*keys, F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")), sizes, keys, "left")
    spans = spans.withColumn("_chunks", F.coalesce("_chunks", F.lit(1).cast("long")))
    chunk = F.pmod(F.xxhash64(*names), F.col("_chunks")).alias("_chunk")
    held = join_on(spans, sound, keys, "left").select(*keys, "low", "high", "_chunks", chunk, *names)
    partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def drawn(rows: DataFrame, normalize: bool) -> DataFrame:
        dealt = rows.drop("_chunks").repartition(partitions, *keys, "_chunk").sortWithinPartitions(*keys, "_chunk")
        return dealt.mapInArrow(_sampler(keys, n, normalize), out)

    parts = drawn(held.where("_chunks > 1"), False)
    summed = parts.groupBy(*keys, "i").agg(F.first("x").alias("x"), F.sum("y").alias("y"))
    scaled = join_on(summed, summed.groupBy(*keys).agg(F.max("y").alias("_top")), keys).select(
        *keys, "i", "x", F.when(F.col("_top") > 0, F.col("y") / F.col("_top")).otherwise(F.col("y")).alias("y")
    )
    return drawn(held.where("_chunks = 1"), True).unionByName(scaled)


def spectrum_meta(domains: DataFrame, *, nucleus: str, keys: Sequence[str] = ("spec_id",), title: Column | None = None) -> DataFrame:
    """One metadata row per spectrum. The experiment is proton for 1H and carbon for every other nucleus."""
    frequency = C.FREQUENCY_MHZ.get(nucleus, C.OTHER_FREQUENCY_MHZ)
    extra = [] if title is None else [title.alias("title")]
    return domains.select(
        *keys,
        *extra,
        F.lit(nucleus).alias("nucleus"),
        F.lit("proton" if nucleus == "1H" else "carbon").alias("experiment"),
        F.lit(frequency).alias("base_frequency"),
        ((F.col("low") + F.col("high")) * frequency / 2).alias("frequency_offset"),
        (F.col("high") - F.col("low")).alias("spectral_width"),
    )


def rbf_expand(distance: Column, *, size: int = C.RBF_SIZE) -> Column:
    """Radial basis values of a distance, as an array; of no distance an array of nulls. One kernel call per batch."""
    centres = np.arange(size) * C.RBF_DELTA - C.RBF_MU

    @F.arrow_udf("array<double>")
    def values(distances: pa.Array) -> pa.Array:
        away = distances.to_numpy(zero_copy_only=False).astype(float)[:, None] - centres
        missing = distances.is_null().to_numpy(zero_copy_only=False)
        flat = pa.array(np.exp(-(away * away) / C.RBF_DELTA).ravel(), mask=np.repeat(missing, size) if missing.any() else None)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(distances) + 1, dtype=np.int32) * size), flat)

    return values(distance.cast("double"))


def array_total(values: Column) -> Column:
    """Sum of an array of doubles, null for no array; null elements add nothing."""

    @F.arrow_udf("double")
    def total(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        sums = np.concatenate([[0.0], np.cumsum(flat)]) if not len(flat) or len(set(np.diff(ends, prepend=0))) > 1 else None
        found = flat.reshape(len(lists), -1).sum(axis=1) if sums is None else sums[ends] - sums[np.concatenate([[0], ends[:-1]]).astype(int)]
        return pa.array(found, mask=lists.is_null().to_numpy(zero_copy_only=False))

    return total(values)
