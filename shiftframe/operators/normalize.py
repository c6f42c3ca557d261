"""From engine results to the flat rows that signals are built from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shift_projection(shifts: DataFrame) -> DataFrame:
    """Rename symbol and value and fill the intensity; every other column passes through."""
    rest = [c for c in shifts.columns if c not in ("symbol", "shift_ppm", "confidence")]
    return shifts.select(
        *rest,
        F.col("symbol").alias("element"),
        F.col("shift_ppm").alias("shift"),
        F.coalesce("confidence", F.lit(1.0)).alias("intensity"),
    )


def engine_filter(shifts: DataFrame, engines: Sequence[str], *, mode: str = "individual", engine: str = "engine") -> DataFrame:
    """Rows of the chosen engines; none chosen leaves nothing; consensus rows are not filtered."""
    if mode != "individual":
        return shifts
    if not engines:
        return shifts.where(F.lit(False))
    return shifts.where(F.coalesce(F.col(engine), F.lit("")).isin(*engines))


def source_filter(signals: DataFrame, active: str | None, *, enabled: bool = True, source: str = "source_id") -> DataFrame:
    """Signals of the active source; no active source keeps all; disabled keeps none."""
    if not enabled:
        return signals.where(F.lit(False))
    if not active:
        return signals
    return signals.where(F.col(source) == active)


def selection_target(nucleus: Column | str, atoms: Column, anchor: Column) -> Column:
    """Atoms to select for a signal: the anchor of a proton signal, else its distinct atoms in order."""
    nucleus = F.lit(nucleus) if isinstance(nucleus, str) else nucleus
    return F.when((nucleus == "1H") & anchor.isNotNull(), F.array(anchor)).otherwise(
        F.array_sort(F.array_distinct(atoms))
    )


def atom_lookup(signals: DataFrame, wanted: DataFrame, *, keys: Sequence[str] = ("mol_id",), target: str = "target") -> DataFrame:
    """Signals whose target holds the wanted atom; ``wanted`` has the keys and ``atom_index``."""
    opened = signals.withColumn("atom_index", F.explode(target))
    return opened.join(wanted.select(*keys, "atom_index").distinct(), [*keys, "atom_index"])


def mode_select(individual: DataFrame, merged: DataFrame, requests: DataFrame, *, mol: str = "mol_id") -> DataFrame:
    """Merged rows for molecules asked in consensus mode, rows of every engine for the others.

    The status of an engine plays no part here.
    """
    modes = requests.select(mol, "mode")
    ours = individual.join(modes.where("mode = 'individual'"), mol, "left_semi")
    theirs = merged.join(modes.where("mode = 'consensus'"), mol, "left_semi")
    return ours.unionByName(theirs, allowMissingColumns=True)


def warnings(headers: DataFrame, dropped: DataFrame, *, mol: str = "mol_id") -> DataFrame:
    """Ordered warnings per molecule: engines that are not ok in request order, then dropped rows.

    ``headers`` holds one row per engine of a molecule, which bounds the list.
    """
    text = F.concat(
        F.col("engine"),
        F.lit(": "),
        F.coalesce(F.col("message"), F.concat(F.lit("status "), F.col("status"))),
    )
    entry = F.when(F.col("status") != "ok", F.struct(F.col("engine_pos").alias("pos"), text.alias("text")))
    listed = headers.groupBy(mol).agg(F.array_sort(F.collect_list(entry)).alias("_list"))
    last = F.when(F.col("warning").isNotNull(), F.array("warning")).otherwise(F.array().cast("array<string>"))
    return listed.join(dropped.select(mol, "warning"), mol, "left").select(
        mol, F.concat(F.transform("_list", lambda e: e["text"]), last).alias("warnings")
    )


def engines_used(requests: DataFrame, used: DataFrame, *, mol: str = "mol_id") -> DataFrame:
    """Engines behind the result: those with a weight in consensus mode, else those asked for; never empty."""
    names = F.when(F.col("mode") == "consensus", F.map_keys("weights_used")).otherwise(F.col("engines"))
    return requests.join(used.select(mol, "weights_used"), mol, "left").select(
        mol, F.when(F.coalesce(F.size(names), F.lit(0)) > 0, names).otherwise(F.col("engines")).alias("engines_used")
    )


def distinct_ordered(rows: DataFrame, value: str, position: str, *, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct values with the position where each first appears; sort by it for first-seen order."""
    return rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(
        F.min(position).alias("first_pos")
    )


def mix(shifts: DataFrame, components: DataFrame, *, component: str = "component_id") -> DataFrame:
    """Rows of several predictions as one set, tagged with their source.

    ``components`` has (mix_id, component, component_pos, label, smiles, nucleus, mode). The first component of a
    mix leads; another one is admitted only with the same nucleus and mode.
    """
    return shifts.join(admitted(components), component).select(
        "mix_id",
        *[c for c in shifts.columns if c != component],
        F.col(component).cast("string").alias("source_id"),
        F.col("label").alias("source_label"),
        F.col("smiles").alias("source_smiles"),
    )


def admitted(components: DataFrame) -> DataFrame:
    """Components that agree with the first one of their mix."""
    lead = components.groupBy("mix_id").agg(F.min_by(F.struct("nucleus", "mode"), "component_pos").alias("_lead"))
    same = (F.col("nucleus") == F.col("_lead.nucleus")) & (F.col("mode") == F.col("_lead.mode"))
    return components.join(lead, "mix_id").where(same).drop("_lead")


def mix_warnings(components: DataFrame) -> DataFrame:
    """Warnings of the admitted components, with the label in front when a mix has more than one."""
    kept = admitted(components)
    sizes = kept.groupBy("mix_id").agg(F.count(F.lit(1)).alias("_n"))
    text = F.when(F.col("_n") > 1, F.concat(F.col("label"), F.lit(": "), F.col("warning"))).otherwise(F.col("warning"))
    return (
        kept.select("mix_id", "component_pos", "label", F.posexplode("warnings").alias("warning_pos", "warning"))
        .join(sizes, "mix_id")
        .select("mix_id", "component_pos", "warning_pos", text.alias("warning"))
    )
