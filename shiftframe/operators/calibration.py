"""Calculated shieldings against reference compounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftframe import constants as C
from shiftframe.functions.text import stripped


def method_key(name: Column) -> Column:
    """Functional and basis names compare without case and outer whitespace."""
    return F.lower(stripped(name))


def reference_keyed(reference: DataFrame) -> DataFrame:
    return reference.select(
        method_key(F.col("functional")).alias("_functional"),
        method_key(F.col("basis")).alias("_basis"),
        F.col("nucleus").alias("_nucleus"),
        F.col("sigma").alias("sigma_ref"),
    )


def calibrate(shieldings: DataFrame, reference: DataFrame, *, sigma: str = "sigma") -> DataFrame:
    """Add ``sigma_ref`` and ``shift_ppm`` = reference minus shielding to rows (functional, basis, nucleus, sigma).

    Rows whose method has no reference stay, with nulls. The reference is a small dimension; its size decides the join
    at run time.
    """
    keyed = shieldings.withColumn("_functional", method_key(F.col("functional"))).withColumn(
        "_basis", method_key(F.col("basis"))
    )
    return (
        keyed.join(
            reference_keyed(reference).withColumnRenamed("_nucleus", "nucleus"), ["_functional", "_basis", "nucleus"],
            "left",
        )
        .withColumn("shift_ppm", F.col("sigma_ref") - F.col(sigma))
        .drop("_functional", "_basis")
    )


def calibrate_complete(
    targets: DataFrame,
    shieldings: DataFrame,
    *,
    mol: str = "mol_id",
    atom: str = "atom_index",
    nucleus: str = "nucleus",
    sigma: str = "sigma",
    engine: str = "ORCA",
) -> tuple[DataFrame, DataFrame]:
    """(rows of complete molecules with their shielding, per molecule: first_missing, status and message).

    One target atom without a shielding makes its molecule an error whose message names the lowest such atom.
    """
    rows = with_shielding(targets, shieldings, mol=mol, atom=atom, sigma=sigma)
    return judge_complete(rows, mol=mol, atom=atom, nucleus=nucleus, sigma=sigma, engine=engine)


def with_shielding(
    targets: DataFrame, shieldings: DataFrame, *, mol: str = "mol_id", atom: str = "atom_index", sigma: str = "sigma"
) -> DataFrame:
    """Targets with the shielding of their atom, null where there is none."""
    found = shieldings.where(F.col(sigma).isNotNull()).select(mol, atom, F.col(sigma).alias("_sigma"))
    return targets.join(found, [mol, atom], "left").withColumnRenamed("_sigma", sigma)


def judge_complete(
    rows: DataFrame, *, mol: str = "mol_id", atom: str = "atom_index", nucleus: str = "nucleus", sigma: str = "sigma", engine: str = "ORCA"
) -> tuple[DataFrame, DataFrame]:
    """``calibrate_complete`` of targets that have their shielding. The rows are read three times: join and write them before."""
    lacking = F.col(sigma).isNull()
    judged = rows.groupBy(mol).agg(F.min(F.when(lacking, F.struct(F.col(atom).alias("atom"), F.col(nucleus).alias("of")))).alias("_first"))
    element = F.regexp_replace("_first.of", "[0-9]", "")
    status = judged.select(
        mol,
        F.col("_first.atom").alias("first_missing"),
        F.when(F.col("_first").isNull(), "ok").otherwise("error").alias("status"),
        F.when(
            F.col("_first").isNotNull(),
            F.format_string(C.MESSAGE_SHIELDING_MISSING, F.lit(engine), F.col("_first.atom"), element),
        ).alias("message"),
    )
    incomplete = rows.where(F.col(sigma).isNull()).select(mol).distinct()
    return rows.join(incomplete, mol, "left_anti"), status


def reference_mean(shieldings: DataFrame, *, atomic_num: str = "atomic_num", sigma: str = "sigma") -> DataFrame:
    """Mean shielding of H and of C per method, for methods that have both."""
    number = F.col(atomic_num)
    means = (
        shieldings.withColumn("functional", method_key(F.col("functional")))
        .withColumn("basis", method_key(F.col("basis")))
        .groupBy("functional", "basis")
        .agg(*[F.avg(F.when(number == z, F.col(sigma))).alias(n) for n, z in C.NUCLEUS_ATOMIC_NUMBER.items()])
        .where(F.col("1H").isNotNull() & F.col("13C").isNotNull())
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("nucleus"), F.col(n).alias("sigma")) for n in C.NUCLEUS_ATOMIC_NUMBER])
    return means.select("functional", "basis", F.inline(pairs))


def missing_keys(wanted: DataFrame, reference: DataFrame) -> DataFrame:
    """Methods asked for that the reference table does not have."""
    keys = wanted.select(
        method_key(F.col("functional")).alias("functional"), method_key(F.col("basis")).alias("basis")
    ).distinct()
    known = reference_keyed(reference).select(F.col("_functional").alias("functional"), F.col("_basis").alias("basis"))
    return keys.join(known, ["functional", "basis"], "left_anti")
