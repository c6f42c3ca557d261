"""Observed peaks against signals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftframe import constants as C
from shiftframe.operators.signals import highlight_range


def match_tolerance(nucleus: str, low, high):
    """Largest accepted score of a signal with the given highlight range."""
    base = C.MATCH_TOLERANCE_PPM.get(nucleus, C.OTHER_MATCH_TOLERANCE_PPM)
    which = 0 if nucleus == "1H" else 1
    span = F.abs(high - low)
    return F.least(F.lit(base), F.greatest(F.lit(C.TOLERANCE_FLOOR_PPM[which]), span * C.TOLERANCE_SPAN_FACTOR[which]))


def codes(left: Sequence[pa.ChunkedArray], right: Sequence[pa.ChunkedArray]) -> tuple[np.ndarray, np.ndarray]:
    """One number per row for each combination of values, the same on both sides."""
    code = np.zeros(len(left[0]) + len(right[0]), dtype=np.int64)
    for a, b in zip(left, right):
        both = pa.chunked_array([*a.chunks, *b.chunks], type=a.type).combine_chunks().dictionary_encode()
        indices = both.indices.to_numpy()
        code = np.unique(code * (len(both.dictionary) + 1) + indices, return_inverse=True)[1]
    return code[: len(left[0])], code[len(left[0]) :]


def covered(group: np.ndarray, first: np.ndarray, last: np.ndarray, at_group: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges ``first..last`` of groups, the first place and the end of the points inside, points being in order."""
    n, m = len(group), len(at)
    groups = np.concatenate([group, at_group, group])
    values = np.concatenate([first, at, last])
    kind = np.repeat([0, 1, 2], [n, m, n])  # a range holds the points at both its ends
    order = np.lexsort((kind, values, groups))
    before = np.empty(len(order), dtype=np.int64)
    before[order] = np.cumsum(kind[order] == 1)
    return before[:n], before[n + m :]


def lowest(begin: np.ndarray, end: np.ndarray, rank: np.ndarray, points: int) -> np.ndarray:
    """For every point the smallest rank of the ranges ``begin..end`` (end excluded) over it; ``len(rank)`` if none.

    A range is two ranges of a power of two that overlap. From the longest down, each is handed to its halves.
    """
    none = len(rank)
    length = end - begin
    some = length > 0
    begin, end, rank = begin[some], end[some], rank[some]
    level = np.frexp(length[some].astype(float))[1] - 1
    held = np.full(points, none, dtype=np.int64)
    for k in range(int(level.max(initial=0)), -1, -1):
        own = level == k
        np.minimum.at(held, begin[own], rank[own])
        np.minimum.at(held, end[own] - (1 << k), rank[own])
        if k:
            half = 1 << (k - 1)
            moved = held.copy()
            moved[half:] = np.minimum(held[half:], held[:-half]) if points > half else held[half:]
            held = moved
    return held


def line_minimum(lines: np.ndarray, offsets: np.ndarray, which: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distance from each point to the nearest line of its signal ``which``; infinite without lines."""
    size = offsets[which + 1] - offsets[which]
    found = np.full(len(at), np.inf)
    some = np.flatnonzero(size)
    if len(some):
        sizes = size[some]
        starts = np.cumsum(sizes) - sizes
        place = np.repeat(offsets[which[some]] - starts, sizes) + np.arange(sizes.sum())
        found[some] = np.minimum.reduceat(np.abs(lines[place] - np.repeat(at[some], sizes)), starts)
    return found


def best_signals(
    group: np.ndarray, position: np.ndarray, center: np.ndarray, low: np.ndarray, high: np.ndarray, lines: np.ndarray,
    offsets: np.ndarray, reach: float, at_group: np.ndarray, at: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """(signal, score) with the lowest score, then position, for every peak; points must be in order of group and value.

    A score is made of straight pieces with few slopes: by distance to a line or to the centre, inside the highlight
    range or to either side of it. Of pieces with one slope the one with the lowest intercept wins wherever it reaches,
    so every slope has one winner per peak, and only the winners are scored.
    """
    owner = np.repeat(np.arange(len(group)), np.diff(offsets))
    every = np.arange(len(group))
    bottom, top = low - reach, high + reach
    inside = (owner, lines, low[owner], high[owner], 1.0)
    far, slope = C.BOUNDARY_DISTANCE_FACTOR, C.CENTER_DISTANCE_FACTOR
    sided = [(inside, 0.0, 0.0), ((every, center, low, high, slope), 0.0, 0.0)]
    for first, last, side, edge in ((bottom, low, -far, low), (high, top, far, high)):
        sided.append(((owner, lines, first[owner], last[owner], 1.0), side, edge[owner]))
        sided.append(((every, center, first, last, slope), side, edge))
    winners = []
    for (signal, point, first, last, factor), side, edge in sided:
        for sign in (-1.0, 1.0):
            u, v = (first, np.minimum(last, point)) if sign < 0 else (np.maximum(first, point), last)
            intercept = -sign * factor * point - side * edge
            order = np.lexsort((position[signal], intercept))
            begin, end = covered(group[signal][order], u[order], v[order], at_group, at)
            rank = lowest(begin, np.maximum(begin, end), np.arange(len(order)), len(at))
            winners.append(np.concatenate([signal[order], [-1]])[rank] if len(order) else np.full(len(at), -1))
    chosen = np.stack(winners) if winners else np.full((1, len(at)), -1)
    best, lead = np.full(len(at), -1), np.full(len(at), np.inf)
    for candidate in chosen:
        has = np.flatnonzero(candidate >= 0)
        which, p = candidate[has], at[has]
        near = np.minimum(line_minimum(lines, offsets, which, p), np.abs(center[which] - p) * slope)
        outside = np.where(p < low[which], low[which] - p, np.where(p > high[which], p - high[which], 0.0))
        score = near + outside * far
        held = best[has]
        better = (score < lead[has]) | ((score == lead[has]) & (position[which] < position[held]) & (held >= 0))
        best[has[better]], lead[has[better]] = which[better], score[better]
    return best, lead


def peak_match(
    signals: DataFrame,
    peaks: DataFrame,
    *,
    nucleus: str = "1H",
    keys: Sequence[str] = ("mol_id",),
    position: str = "pos",
    peak: str = "peak_id",
    bin_ppm: float | None = None,
) -> DataFrame:
    """For every peak the signal with the lowest score, if the score is within that signal's tolerance.

    ``signals`` has (keys, position, center, lines as array of ppm), ``peaks`` (keys, peak, ppm). The score grows by
    3 per ppm outside the highlight range, so an accepted signal lies within a third of the base tolerance of the
    peak: the band below is exact. The band is cut into bins, which are dealt with ``keys``. Signals and peaks of a bin
    are never paired: the lowest scores are found from straight pieces in order (``best_signals``), in n log n steps.
    Of equal signals only the first position can win, so they are reduced to it before. With ``keys=()`` it is a
    search over all signals. Rows with a null key, a null or NaN ppm or no centre match nothing.
    """
    base = C.MATCH_TOLERANCE_PPM.get(nucleus, C.OTHER_MATCH_TOLERANCE_PPM)
    reach = base / C.BOUNDARY_DISTANCE_FACTOR
    width = bin_ppm or base
    low, high = highlight_range(nucleus, F.col("lines"), F.col("center"))
    keys = list(keys)
    first = signals.groupBy(*keys, "center", "lines").agg(F.min(position).alias(position))
    bands = first.select(*keys, position, "center", "lines", low.alias("low"), high.alias("high")).withColumn(
        "tolerance", match_tolerance(nucleus, F.col("low"), F.col("high"))
    )
    bins = F.sequence(
        F.floor((F.col("low") - reach) / width).cast("long"), F.floor((F.col("high") + reach) / width).cast("long")
    )
    bands = bands.where(~F.isnan("center")).withColumn("_bin", F.explode(bins)).dropna(subset=[*keys, "_bin"])
    observed = peaks.select(*keys, peak, "ppm").withColumn("_bin", F.floor(F.col("ppm") / width).cast("long"))
    observed = observed.where(~F.isnan("ppm")).dropna(subset=[*keys, "ppm"])
    # signals of bins without peaks stay where they are
    bands = bands.join(observed.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi")
    parts = int(signals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*keys, "_bin"), F.lit(parts)).alias("_part")
    fields = [*[peaks.schema[k] for k in keys], peaks.schema[peak], T.StructField("ppm", T.DoubleType()), T.StructField(position, signals.schema[position].dataType),
              T.StructField("center", T.DoubleType()), T.StructField("score", T.DoubleType())]

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return right.select([*keys, peak]).slice(0, 0).append_column("ppm", pa.array([], pa.float64())).append_column(
                position, left.column(position).slice(0, 0)
            ).append_column("center", pa.array([], pa.float64())).append_column("score", pa.array([], pa.float64()))
        group, at_group = codes([left.column(k) for k in [*keys, "_bin"]], [right.column(k) for k in [*keys, "_bin"]])
        at = right.column("ppm").to_numpy()
        order = np.lexsort((at, at_group))
        lists = left.column("lines").combine_chunks()
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        number = lambda c: left.column(c).to_numpy()
        places = np.unique(number(position), return_inverse=True)[1]
        best, score = best_signals(
            group, places, number("center"), number("low"), number("high"), lists.flatten().to_numpy(zero_copy_only=False).astype(float), offsets, reach,
            at_group[order], at[order],
        )
        good = (best >= 0) & (score <= number("tolerance")[best])
        rows, own = pa.array(order[good]), pa.array(best[good])
        table = right.select([*keys, peak, "ppm"]).take(rows)
        return table.append_column(position, left.column(position).take(own)).append_column("center", left.column("center").take(own)).append_column(
            "score", pa.array(score[good])
        )

    dealt = [
        bands.select("*", part).groupBy("_part"),
        observed.select(*keys, peak, F.col("ppm").cast("double").alias("ppm"), "_bin", part).groupBy("_part"),
    ]
    return dealt[0].cogroup(dealt[1]).applyInArrow(match, T.StructType(fields))
