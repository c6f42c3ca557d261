"""Weighted merging of several engines into one value per atom."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftframe.constants import DEFAULT_WEIGHTS


def weight_of(engine: Column, weights: Mapping[str, float]) -> Column:
    """Weight by engine name; an engine without a weight counts 0."""
    chosen = F.lit(0.0)
    for name, weight in weights.items():
        chosen = F.when(engine == name, F.lit(float(weight))).otherwise(chosen)
    return chosen


def weight_overlay(
    engines: DataFrame,
    overrides: DataFrame,
    *,
    mol: str = "mol_id",
    engine: str = "engine",
    defaults: Mapping[str, float] = DEFAULT_WEIGHTS,
) -> DataFrame:
    """Add ``weight``: the override (mol, engine, weight) where there is one, also when 0, else the default, else 0."""
    given = overrides.select(mol, engine, F.col("weight").alias("_override"))
    return engines.join(given, [mol, engine], "left").select(
        *engines.columns, F.coalesce("_override", weight_of(F.col(engine), defaults)).alias("weight")
    )


def weights_used(
    headers: DataFrame, *, mol: str = "mol_id", engine: str = "engine", engine_pos: str = "engine_pos"
) -> DataFrame:
    """One map per molecule, in request order: weights of the ok engines above 0, scaled to sum 1.

    ``headers`` has one row (mol, engine, engine_pos, status, weight) per engine that was run, so the list per
    molecule is bounded by the number of engines, and an ok engine without any shift still counts.
    """
    usable = (F.col("status") == "ok") & (F.col("weight") > 0)
    entry = F.when(
        usable, F.struct(F.col(engine_pos).alias("pos"), F.col(engine).alias("engine"), F.col("weight").alias("w"))
    )
    grouped = headers.groupBy(mol).agg(
        F.array_sort(F.collect_list(entry)).alias("_entries"), F.sum(F.when(usable, F.col("weight"))).alias("_total")
    )
    scaled = F.transform("_entries", lambda e: F.struct(e["engine"], (e["w"] / F.col("_total")).alias("weight")))
    return grouped.select(mol, F.map_from_entries(scaled).alias("weights_used"))


def consensus(
    shifts: DataFrame,
    *,
    keys: Sequence[str] = ("mol_id", "atom_index"),
    value: str = "shift_ppm",
    engine: str = "engine",
    engine_pos: str = "engine_pos",
    status: str = "status",
    weight: Column | None = None,
    fields: Sequence[str] = (),
) -> DataFrame:
    """Weighted mean, spread and contributing engines per atom.

    One aggregation: scaling the weights to sum 1 cancels out in the mean, so the weights of the other atoms are not
    needed. Spread is the unweighted population deviation, null for a single entry. Engines are named in request
    order, ``engine_pos``; their set is as large as the number of different engines of a request. ``fields`` are added as
    the first contributing engine has them, like ``consensus_template`` does, in the same aggregation.
    """
    weight = weight_of(F.col(engine), DEFAULT_WEIGHTS) if weight is None else weight
    named = F.struct(F.col(engine_pos).alias("pos"), F.col(engine).alias("engine"))
    used = shifts.select(
        *keys, F.col(value).alias("_v"), named.alias("_engine"), weight.alias("_w"), F.col(status).alias("_s"),
        *([F.struct(*fields).alias("_fields")] if fields else []),
    ).where((F.col("_s") == "ok") & (F.col("_w") > 0))
    merged = used.groupBy(*keys).agg(
        (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("shift_ppm"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_pop("_v")).alias("std_ppm"),
        F.count(F.lit(1)).alias("n_entries"),
        F.array_sort(F.collect_set("_engine")).alias("_engines"),
        *([F.min_by("_fields", "_engine.pos").alias("_fields")] if fields else []),
    )
    names = F.array_distinct(F.transform("_engines", lambda e: e["engine"]))
    return merged.select(*keys, "shift_ppm", "std_ppm", "n_entries", names.alias("contributing_engines"), *[f"_fields.{f}" for f in fields])


def contributors(
    shifts: DataFrame,
    *,
    keys: Sequence[str] = ("mol_id", "atom_index"),
    engine: str = "engine",
    engine_pos: str = "engine_pos",
) -> DataFrame:
    """Engines of each atom in request order; for any engine names and any order per molecule."""
    ordered = F.array_sort(F.collect_set(F.struct(F.col(engine_pos).alias("pos"), F.col(engine).alias("engine"))))
    return shifts.groupBy(*keys).agg(F.transform(ordered, lambda e: e["engine"]).alias("contributing_engines"))


def consensus_template(
    shifts: DataFrame,
    fields: Sequence[str],
    *,
    keys: Sequence[str] = ("mol_id", "atom_index"),
    engine_pos: str = "engine_pos",
    tie: Sequence[str] = (),
) -> DataFrame:
    """Descriptive fields of each atom, taken from its first contributing engine."""
    first = F.min_by(F.struct(*fields), F.struct(engine_pos, *tie))
    return shifts.groupBy(*keys).agg(first.alias("_first")).select(*keys, *[f"_first.{name}" for name in fields])
