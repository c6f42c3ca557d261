"""Signals: clusters of shifts, what describes them, and how they look."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftframe import constants as C
from shiftframe.functions.once import once
from shiftframe.functions.parts import parts_of
from shiftframe.functions.ranges import changes, running
from shiftframe.functions.skew import sized_split
from shiftframe.operators.signal_walk import BLOCK_ROWS, walk_large

# Optional columns of a shift row and their types.
OPTIONAL = {
    "source_id": "string",
    "source_label": "string",
    "source_smiles": "string",
    "engine": "string",
    "element": "string",
    "attached_atom_index": "int",
    "assignment_group": "string",
    "multiplicity": "string",
    "coupling_hz": "double",
    "neighbor_count": "double",
    "std": "double",
}
FOLD_ROWS = 1_000_000


def _complete(shifts: DataFrame, value: str, scope: Sequence[str], mode: str) -> DataFrame:
    have = set(shifts.columns)
    columns = {
        name: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind) for name, kind in OPTIONAL.items()
    }
    if mode == "consensus":
        columns["engine"] = F.lit(None).cast("string")
    engine = F.lit("consensus") if mode == "consensus" else F.coalesce(columns["engine"], F.lit("engine"))
    group = F.coalesce(
        columns["assignment_group"], F.concat(F.lit("atom:"), F.col("atom_index").cast("string"))
    )
    key = F.concat_ws(":", F.coalesce(columns["source_id"], F.lit("default")), engine, group)
    return shifts.select(
        *scope,
        key.alias("base_key"),
        F.col("atom_index").cast("int").alias("atom_index"),
        F.col(value).cast("double").alias("shift"),
        *[column.alias(name) for name, column in columns.items()],
    )


def _walk_sorted(rows: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """Walk each group, highest shift first, by the ``_tolerance`` of its rows. Only the newest cluster can take the next shift.

    Rows are dealt by group to ``parts`` tasks and sorted; a task passes over them once and keeps the newest cluster only, however the
    rows are cut into batches.
    """
    payload = [c for c in rows.columns if c not in (*keys, "shift", "atom_index")]
    dealt = rows.repartition(parts, *keys).sortWithinPartitions(*keys, F.col("shift").desc(), "atom_index", *payload)
    added = [T.StructField("walk_pos", T.LongType()), T.StructField("signal_no", T.IntegerType()),
             T.StructField("n_after", T.LongType()), T.StructField("center_after", T.DoubleType())]
    names = list(keys)

    def walk(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, place, number, center, atoms = {}, 0, -1, 0.0, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, dtype=bool)
            for name in names:
                new |= changes(batch.column(name), last.get(name))
                last[name] = batch.column(name)[-1:]
            out = []
            shifts, atom_indices, tolerances = (batch.column(c).to_pylist() for c in ("shift", "atom_index", "_tolerance"))
            for begins, shift, atom, tolerance in zip(new.tolist(), shifts, atom_indices, tolerances):
                if begins:
                    place, number, atoms = 0, -1, set()
                if number >= 0 and abs(center - shift) <= tolerance:
                    atoms.add(atom)
                    center = (center * (len(atoms) - 1) + shift) / len(atoms)
                else:
                    number, center, atoms = number + 1, shift, {atom}
                out.append((place, number, len(atoms), center))
                place += 1
            columns = list(zip(*out))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=[*batch.schema.names, "walk_pos", "signal_no", "n_after", "center_after"],
            )

    return dealt.mapInArrow(walk, T.StructType([*rows.schema.fields, *added]))


def signal_group(
    shifts: DataFrame,
    *,
    nucleus: str | Column,
    mode: str = "individual",
    scope: Sequence[str] = ("mol_id",),
    value: str = "shift",
    fold_rows: int = FOLD_ROWS,
    block_rows: int = BLOCK_ROWS,
    dealt: bool = False,
) -> DataFrame:
    """Member rows of every signal: key, number, id, place in the walk and running centre.

    The key is source, engine and group. Proton shifts join the newest cluster when they are within the tolerance of
    its running mean; other nuclei form one cluster per key. Rows without a number as shift belong to no signal and are
    left out, whatever the size of their group. Groups of up to ``fold_rows`` rows are walked in one pass by one task;
    larger groups block by block, one round per cluster. ``nucleus`` may be a column that is named in ``scope``: rows of
    all nuclei then share one plan. With ``dealt`` members are left dealt by key, unless a group is that large, so that
    aggregations of signals shuffle nothing more.
    """
    mixed = isinstance(nucleus, Column)
    proton = F.coalesce(nucleus == "1H", F.lit(False)) if mixed else F.lit(nucleus == "1H")
    tolerance = F.when(proton, F.lit(C.GROUP_TOLERANCE_1H_PPM)).otherwise(F.lit(float("inf")))
    keys = [*scope, "base_key"]
    rows = _complete(shifts, value, scope, mode).where(F.col("shift").isNotNull() & ~F.isnan("shift"))
    # what no shift has is null throughout and need not be dealt, sorted and passed to Python
    absent = [c for c in OPTIONAL if c not in shifts.columns or (c == "engine" and mode == "consensus")]
    columns, rows = rows.schema, rows.drop(*absent)
    small, large, count = sized_split(rows, keys, fold_rows)
    parts = parts_of(rows.sparkSession, count)
    members = _walk_sorted(small.withColumn("_tolerance", tolerance), keys, parts).drop("_tolerance")
    if large is not None:
        for some, reach in ((proton, C.GROUP_TOLERANCE_1H_PPM), (~proton, float("inf"))):
            # one key that is never null, as the rounds join on it
            chosen = large.where(some).withColumn("_group", F.to_json(F.struct(*keys)))
            if not chosen.isEmpty():
                walked = walk_large(chosen, ["_group"], reach, block_rows=block_rows)
                members = members.unionByName(walked.select(*members.columns))
    elif dealt:
        members = members.repartition(parts, *keys)
    added = members.columns[len(rows.columns) :]
    given = [F.lit(None).cast(f.dataType).alias(f.name) if f.name in absent else F.col(f.name) for f in columns]
    members = members.select(*given, *added)
    return members.withColumn("signal_id", signal_id())


def signal_id() -> Column:
    """Name of a signal in its scope: key and number."""
    return F.concat_ws(":", "base_key", F.col("signal_no").cast("string"))


def majority_label(
    rows: DataFrame, *, keys: Sequence[str], label: str = "multiplicity", position: str = "walk_pos"
) -> DataFrame:
    """Most frequent label per key; of equally frequent ones the label seen first. Empty labels do not count."""
    seen = rows.where(F.col(label).isNotNull() & (F.col(label) != ""))
    counts = seen.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct("_n", -F.col("_first"))).alias(label))


def signal_stats(
    members: DataFrame, *, nucleus: str | Column, scope: Sequence[str] = ("mol_id",), with_atoms: bool = False
) -> DataFrame:
    """One row per signal from its member rows.

    Two aggregations over the same key: first per label, then over the labels, so the majority label needs no second
    pass. ``nucleus`` may be a column named in ``scope``. The atoms of a signal are in ``signal_atoms``, in long form; ``with_atoms`` adds them as a sorted list, for
    data whose signals are known to be small.
    """
    key = [*scope, "base_key", "signal_no"]
    first_fields = ["atom_index", "element", "attached_atom_index", "engine", "source_id", "source_label", "source_smiles"]
    label = F.when(F.col("multiplicity") != "", F.col("multiplicity"))
    averaged = ("coupling_hz", "neighbor_count", "std")
    per_label = members.groupBy(*key, label.alias("_label")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("walk_pos").alias("_first_pos"),
        F.max("walk_pos").alias("_last_pos"),
        F.max_by("center_after", "walk_pos").alias("_center"),
        F.max("n_after").alias("_atoms"),
        F.min_by(F.struct(*first_fields), "walk_pos").alias("_first"),
        *[F.sum(c).alias(f"_s_{c}") for c in averaged],
        *[F.count(c).alias(f"_c_{c}") for c in averaged],
        *([F.collect_set("atom_index").alias("_list")] if with_atoms else []),
    )
    vote = F.when(F.col("_label").isNotNull(), F.struct(F.col("_n"), (-F.col("_first_pos")).alias("_p")))
    stats = per_label.groupBy(*key).agg(
        F.max_by("_center", "_last_pos").alias("center"),
        F.max("_atoms").alias("_atoms"),
        F.min_by("_first", "_first_pos").alias("_first"),
        F.max_by("_label", vote).alias("multiplicity"),
        *[F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_c_{c}")).alias(c) for c in averaged],
        *([F.array_sort(F.array_distinct(F.flatten(F.collect_list("_list")))).alias("atom_indices")] if with_atoms else []),
    )
    proton = nucleus == "1H" if isinstance(nucleus, Column) else F.lit(nucleus == "1H")
    integration = F.when(proton, F.col("_atoms"))
    return stats.select(
        *key,
        signal_id().alias("signal_id"),
        "center",
        integration.alias("integration"),
        "multiplicity",
        *averaged,
        F.col("_first.atom_index").alias("representative_atom_index"),
        *[F.col(f"_first.{c}").alias(c) for c in first_fields[1:]],
        *(["atom_indices"] if with_atoms else []),
    )


def signal_atoms(members: DataFrame, *, scope: Sequence[str] = ("mol_id",)) -> DataFrame:
    """The different atoms of every signal, one row each."""
    return members.select(*scope, "signal_id", "atom_index").distinct()


def sort_signals(signals: DataFrame, *, center: str = "center", ties: Sequence[str] = ("pos",)) -> DataFrame:
    """Global order, highest centre first; a range-partitioned sort."""
    return signals.orderBy(F.col(center).desc(), *ties)


def per_nucleus(
    rows: DataFrame,
    operator: Callable[..., DataFrame],
    *,
    nuclei: Sequence[str] = tuple(C.DOMAIN_PPM),
    column: str = "nucleus",
    other: str = "other",
    **options,
) -> DataFrame:
    """Run an operator that takes one ``nucleus`` on rows that each name theirs, and keep the name as a column.

    There is one branch per listed nucleus, which reads only its rows, and one for all others, which share their
    defaults. The operator's ``scope`` or ``keys`` are extended by the nucleus column.
    """
    key = "keys" if "keys" in inspect.signature(operator).parameters else "scope"
    names = [column, *options.pop(key, inspect.signature(operator).parameters[key].default)]
    listed = F.col(column).isin(list(nuclei))
    parts = [operator(rows.where(F.col(column) == n), nucleus=n, **{key: names}, **options) for n in nuclei]
    parts.append(operator(rows.where(~F.coalesce(listed, F.lit(False))), nucleus=other, **{key: names}, **options))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- texts and lines --------------------------------------------------------------------------------------------


def islands(rows: DataFrame, *, keys: Sequence[str], value: str, width: int = 65536) -> DataFrame:
    """Runs of consecutive integers per key: (keys, first, last).

    Runs are found inside ranges of ``width`` integers, which bounds every window because the values are distinct.
    Only runs that touch the edge of their range can continue in the next one and are joined up.
    """
    v = F.col("_v")
    distinct = rows.select(*keys, F.col(value).cast("long").alias("_v")).distinct()
    cut = distinct.withColumn("_range", F.floor(v / width))
    inside = Window.partitionBy(*keys, "_range").orderBy("_v")
    runs = (
        cut.withColumn("_run", v - F.row_number().over(inside))
        .groupBy(*keys, "_range", "_run")
        .agg(F.min("_v").alias("first"), F.max("_v").alias("last"))
    )
    at_edge = (F.pmod("first", F.lit(width)) == 0) | (F.pmod("last", F.lit(width)) == width - 1)
    finished = runs.where(~at_edge).select(*keys, "first", "last")
    order = Window.partitionBy(*keys).orderBy("first")
    starts = F.when(F.lag("last").over(order) + 1 == F.col("first"), 0).otherwise(1)
    edge = (
        runs.where(at_edge)
        .withColumn("_starts", starts)
        .withColumn("_chain", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_chain")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .select(*keys, "first", "last")
    )
    return finished.unionByName(edge)


def island_label(prefix: str) -> Column:
    one = F.concat(F.lit(prefix), F.col("first").cast("string"))
    return F.when(F.col("first") == F.col("last"), one).otherwise(
        F.concat(one, F.lit(f"-{prefix}"), F.col("last").cast("string"))
    )


def island_text(runs: DataFrame, *, keys: Sequence[str], prefix: str = "H") -> DataFrame:
    """The runs of each key as one text, ascending."""
    listed = F.array_sort(F.collect_list(F.struct("first", island_label(prefix).alias("text"))))
    return runs.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda e: e["text"]), ", ").alias("ranges"))


def atom_ranges(atoms: Column, prefix: str = "H") -> Column:
    """Runs of consecutive numbers of a sorted array of different ones, as one text."""
    at = lambda i: F.get(atoms, i)
    begins = F.filter(atoms, lambda a, i: (i == 0) | (at(i - 1) != a - 1))
    ends = F.filter(atoms, lambda a, i: (i == F.size(atoms) - 1) | (at(i + 1) != a + 1))
    one = lambda a: F.concat(F.lit(prefix), a.cast("string"))
    label = lambda a, b: F.when(a == b, one(a)).otherwise(F.concat(one(a), F.lit("-"), one(b)))
    return F.array_join(F.zip_with(begins, ends, label), ", ")


def assignment_text(signals: DataFrame, members: DataFrame, *, nucleus: str, scope: Sequence[str] = ("mol_id",)) -> DataFrame:
    """Add ``assignment_text``: the atom ranges of a proton signal and its anchor, else element and atom number.

    Signals that hold their ``atom_indices`` (see ``signal_stats``) need no second look at the members.
    """
    if nucleus != "1H":
        text = F.concat(
            F.coalesce("element", F.lit("atom")), F.lit(" #"), F.col("representative_atom_index").cast("string")
        )
        return signals.withColumn("assignment_text", text)
    key = [*scope, "signal_id"]
    if "atom_indices" in signals.columns:
        named = signals.withColumn("ranges", atom_ranges(F.col("atom_indices")))
    else:
        named = signals.join(island_text(islands(members, keys=key, value="atom_index"), keys=key), key)
    text = F.when(
        F.col("attached_atom_index").isNotNull(),
        F.concat(F.col("ranges"), F.lit(" on atom #"), F.col("attached_atom_index").cast("string")),
    ).otherwise(F.col("ranges"))
    return named.withColumn("assignment_text", text).drop("ranges")


def multiplet_lines(
    nucleus: str, center: Column, label: Column, coupling: Column, integration: Column
) -> Column:
    """Array of lines (shift, intensity) of a signal."""
    if nucleus != "1H":
        return F.array(F.struct(center.alias("shift"), F.lit(1.0).alias("intensity")))
    base = C.LINE_BASE_HEIGHT + F.least(
        F.lit(C.LINE_HEIGHT_MAX_EXTRA), (F.coalesce(integration, F.lit(1)) - 1) * C.LINE_HEIGHT_STEP
    )

    def lines_of(heights: Sequence[float]) -> Column:
        """Places in steps from the middle and heights as parts of the highest; literals, so a row only picks one."""
        middle, top = (len(heights) - 1) / 2, float(max(heights))
        return F.array(*[F.struct(F.lit(i - middle).alias("step"), F.lit(h / top).alias("part")) for i, h in enumerate(heights)])

    pattern = lines_of(C.MULTIPLET_PATTERNS["m"])
    for name, heights in C.MULTIPLET_PATTERNS.items():
        pattern = F.when(label == name, lines_of(heights)).otherwise(pattern)
    single = F.coalesce(label == "s", F.lit(True)) | F.coalesce(
        F.abs(coupling) < C.ZERO_COUPLING_EPSILON, F.lit(False)
    )
    pattern = F.when(single, lines_of([1.0])).otherwise(pattern)
    wanted = F.coalesce(coupling, F.lit(C.DEFAULT_COUPLING_HZ)) / C.SPECTROMETER_MHZ
    spacing = F.when((wanted == 0) | F.isnan(wanted), F.lit(C.FALLBACK_SPACING_PPM)).otherwise(wanted)
    return F.transform(
        pattern,
        lambda line: F.struct((center + line["step"] * spacing).alias("shift"), (base * line["part"]).alias("intensity")),
    )


def add_lines(signals: DataFrame, *, nucleus: str) -> DataFrame:
    """Add ``lines``, made one time per signal however often they are read."""
    lines = multiplet_lines(nucleus, F.col("center"), F.col("multiplicity"), F.col("coupling_hz"), F.col("integration"))
    return once(signals.drop("lines"), lines=lines)


def line_rows(signals: DataFrame, *, keep: Sequence[str]) -> DataFrame:
    """One row per line: kept columns, line_no, shift, intensity."""
    return signals.select(*keep, F.posexplode("lines").alias("line_no", "_line")).select(
        *keep, "line_no", "_line.shift", "_line.intensity"
    )


def highlight_range(nucleus: str, positions: Column, center: Column) -> tuple[Column, Column]:
    """Lowest and highest ppm of the band that stands for a signal; ``positions`` are its line positions."""
    half = C.HIGHLIGHT_HALF_WIDTH_PPM.get(nucleus, C.OTHER_HALF_WIDTH_PPM)
    pad = C.HIGHLIGHT_PAD_1H_PPM if nucleus == "1H" else half * C.HIGHLIGHT_PAD_OTHER_FACTOR
    some = F.coalesce(F.size(positions), F.lit(0)) > 0
    low = F.when(some, F.array_min(positions) - pad).otherwise(center - half)
    high = F.when(some, F.array_max(positions) + pad).otherwise(center + half)
    return low, high


# --- integral ---------------------------------------------------------------------------------------------------


def integral_curve(
    signals: DataFrame,
    *,
    low: float,
    high: float,
    keys: Sequence[str] = ("mol_id",),
    tie: str = "pos",
) -> DataFrame:
    """Points (seq, x, y) of the rising integral of each key, from the high to the low end of the range.

    Signals are passed in order of falling centre. Each rises by its share of the total; keys without any
    integration give no points.
    """
    rows = signals.where(F.col("integration").isNotNull()).select(*keys, "center", tie, "integration")
    totals = rows.groupBy(*keys).agg(F.sum("integration").alias("_total"), F.count(F.lit(1)).alias("_count"))
    totals = totals.where(F.col("_total") > 0)
    cumulated = running(
        rows,
        keys,
        [F.col("center").desc(), F.col(tie)],
        {"_sum": F.col("integration"), "_rank": F.lit(1)},
    ).join(totals, list(keys))

    def height(reached: Column) -> Column:
        return reached / F.col("_total") * C.INTEGRAL_AMPLITUDE + C.INTEGRAL_BASELINE

    before, after = height(F.col("_sum") - F.col("integration")), height(F.col("_sum"))
    left = F.least(F.lit(high), F.col("center") + C.INTEGRAL_SHOULDER_PPM)
    right = F.greatest(F.lit(low), F.col("center") - C.INTEGRAL_SHOULDER_PPM)
    base = (F.col("_rank").cast("long") - 1) * 4
    corners = [(left, before), (F.col("center"), before), (F.col("center"), after), (right, after)]
    steps = F.array(
        *[F.struct((base + i + 1).alias("seq"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(corners)]
    )
    ends = F.array(
        F.struct(F.lit(0).cast("long").alias("seq"), F.lit(high).alias("x"), F.lit(C.INTEGRAL_BASELINE).alias("y")),
        F.struct(
            (F.col("_count") * 4 + 1).alias("seq"),
            F.lit(low).alias("x"),
            F.lit(C.INTEGRAL_BASELINE + C.INTEGRAL_AMPLITUDE).alias("y"),
        ),
    )
    return cumulated.select(*keys, F.inline(steps)).unionByName(totals.select(*keys, F.inline(ends)))
