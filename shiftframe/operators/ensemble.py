"""Conformer ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe.constants import RT_KCAL
from shiftframe.functions.ranges import numbered


def boltzmann_mean(
    conformers: DataFrame,
    shifts: DataFrame,
    *,
    mol: str = "mol_id",
    conf: str = "conf_id",
    energy: str = "energy_kcal",
    value: str = "shift_ppm",
) -> DataFrame:
    """Per atom, the mean over conformers weighted by exp(-(E - Emin) / RT).

    The minimum is one aggregate joined back rather than a window, so a molecule with very many conformers is
    reduced on the map side. ``shift_ppm`` is null with status ``error`` when no weight is left.
    """
    lowest = conformers.groupBy(mol).agg(F.min(energy).alias("_lowest"))
    weighted = conformers.join(lowest, mol).select(
        mol, conf, F.exp(-(F.col(energy) - F.col("_lowest")) / F.lit(RT_KCAL)).alias("_w")
    )
    mean = shifts.select(mol, conf, "atom_index", value).join(weighted, [mol, conf]).groupBy(mol, "atom_index").agg(
        F.sum(F.col("_w") * F.col(value)).alias("_wv"), F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("n_conformers")
    )
    return mean.select(
        mol,
        "atom_index",
        F.try_divide("_wv", "_w").alias("shift_ppm"),
        "n_conformers",
        F.when(F.col("_w") > 0, "ok").otherwise("error").alias("status"),
    )


def rank_conformers(
    conformers: DataFrame,
    *,
    mol: str = "mol_id",
    conf: str = "conf_id",
    energy: str = "energy_kcal",
) -> DataFrame:
    """Number the conformers of a molecule by energy, then id; the failure flag plays no part.

    Unknown energies (null) come first and NaN last, as Spark orders them.
    """
    order = [F.col(energy).asc(), F.col(conf).asc()]
    return numbered(conformers, [mol], order, "rank")


def best_conformer(
    conformers: DataFrame, *, mol: str = "mol_id", conf: str = "conf_id", energy: str = "energy_kcal", flag: str = "flag"
) -> DataFrame:
    """Lowest energy among the conformers that did not fail; the first id when there is none."""
    usable = F.col(energy).isNotNull() & ~F.isnan(energy) & F.coalesce(F.col(flag) != -1, F.lit(True))
    best = F.min(F.when(usable, F.struct(F.col(energy).alias("e"), F.col(conf).alias("c"))))
    return conformers.groupBy(mol).agg(F.coalesce(best["c"], F.min(conf)).alias(conf))
