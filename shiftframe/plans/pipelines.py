"""The end-to-end jobs, each from stored tables to a result table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftframe import constants as C
from shiftframe.constants import DEFAULT_WEIGHTS
from shiftframe.functions.workspace import materialize
from shiftframe.operators import calibration, graph, normalize, signals, spectra, validate
from shiftframe.operators.consensus import consensus, weight_overlay, weights_used
from shiftframe.sources.reference import read_reference_table, upsert_reference

ANNOTATIONS = {
    "attached_atom_index": "int",
    "assignment_group": "string",
    "multiplicity": "string",
    "coupling_hz": "double",
    "neighbor_count": "int",
}


def check_and_annotate(
    headers: DataFrame, shifts: DataFrame, atoms: DataFrame, bonds: DataFrame, *, nucleus: str = "1H"
) -> tuple[DataFrame, DataFrame]:
    """(headers, rows of the engines that are still ok), with n_atoms and all annotations; see ``merge_engines``.

    Annotated rows are written once: both the faults and what is left are read from them.
    """
    sizes = atoms.groupBy("mol_id").agg(F.count(F.lit(1)).alias("n_atoms"))
    absent = {name: F.lit(None).cast(kind) for name, kind in ANNOTATIONS.items() if name not in shifts.columns}
    rows = shifts.withColumns(absent) if absent else shifts
    attached = ["attached_atom_index"]
    if nucleus == "1H":
        found = graph.multiplicity_rule(atoms, bonds)
        found = found.select("mol_id", "atom_index", F.struct(*[c for c in ANNOTATIONS if c in found.columns]).alias("_found"))
        have = [f.name for f in found.schema["_found"].dataType.fields]
        # by atom before by molecule: predictions that were merged by atom are dealt so already
        annotated = rows.join(found, ["mol_id", "atom_index"], "left").withColumn("_own_attached", F.col("attached_atom_index"))
        attached.append("_own_attached")
        anchored = F.col("_found.attached_atom_index").isNotNull()
        rows = annotated.withColumns({c: F.when(anchored, F.col(f"_found.{c}")).otherwise(F.col(c)) for c in have}).drop("_found")
    rows = rows.join(sizes, "mol_id", "left").withColumn("n_atoms", F.coalesce("n_atoms", F.lit(0)))
    checked, rows = validate.index_check_strict(headers, materialize(rows, "annotated"), attached=attached)
    return checked, rows.drop("_own_attached")


def merge_engines(
    headers: DataFrame,
    shifts: DataFrame,
    atoms: DataFrame,
    bonds: DataFrame,
    *,
    overrides: DataFrame | None = None,
    nucleus: str = "1H",
    defaults: Mapping[str, float] = DEFAULT_WEIGHTS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Check, annotate and merge predictions: (headers, merged shifts, weights per molecule).

    ``headers`` has (mol_id, engine, engine_pos, status), ``shifts`` (mol_id, engine, atom_index, symbol, shift_ppm) and
    the engine's own annotations where it has any. A molecule without atoms makes all its engines errors. Proton
    annotations come from the graph and replace the engine's own where a proton has an anchor; attached indices are
    checked before and after that.
    """
    checked, rows = check_and_annotate(headers, shifts, atoms, bonds, nucleus=nucleus)
    return (checked, *merge_rows(checked, rows, overrides=overrides, defaults=defaults))


def merge_rows(
    checked: DataFrame, rows: DataFrame, *, overrides: DataFrame | None = None, defaults: Mapping[str, float] = DEFAULT_WEIGHTS
) -> tuple[DataFrame, DataFrame]:
    """(merged shifts, weights per molecule) of checked and annotated rows."""
    rows = rows.drop("n_atoms")
    if overrides is None:
        overrides = checked.select("mol_id", "engine", F.lit(None).cast("double").alias("weight")).where(F.lit(False))
    weighted = weight_overlay(checked, overrides, defaults=defaults)
    usable = rows.join(
        weighted.where((F.col("status") == "ok") & (F.col("weight") > 0)).select(
            "mol_id", "engine", "engine_pos", "status", "weight"
        ),
        ["mol_id", "engine"],
    )
    return consensus(usable, weight=F.col("weight"), fields=["symbol", *ANNOTATIONS]), weights_used(weighted)


def draw_spectra(
    shifts: DataFrame,
    spectra_of: DataFrame,
    *,
    nucleus: str = "1H",
    mode: str = "individual",
    scope: Sequence[str] = ("mol_id",),
    points: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From flat shifts to spectra: (signals, points, metadata). ``spectra_of`` maps the scope to a spec_id.

    In individual mode every engine has a spectrum of its own, in consensus mode there is one; all spectra of a
    spec_id share one domain.
    """
    members = signals.signal_group(shifts, nucleus=nucleus, mode=mode, scope=scope, dealt=True)
    stats = signals.signal_stats(members, nucleus=nucleus, scope=scope)
    shown = signals.add_lines(stats, nucleus=nucleus).join(spectra_of, list(scope))
    engine = F.coalesce("engine", F.lit("engine" if mode == "individual" else "consensus")).alias("engine")
    lines = signals.line_rows(shown, keep=["spec_id", "engine", "std"]).select(
        "spec_id", engine, "shift", "intensity", spectra.line_width(nucleus, F.col("std")).alias("width")
    )
    # Domain and drawing both read the lines, which are the end of a long plan.
    lines = materialize(lines, "lines")
    shared = spectra.shared_domain(lines, spectra_of, nucleus=nucleus)
    domains = shared.join(lines.select("spec_id", "engine").distinct(), "spec_id")
    keys = ("spec_id", "engine")
    drawn = spectra.spectrum_synthesis(lines, domains, nucleus=nucleus, points=points, keys=keys)
    return shown, drawn, spectra.spectrum_meta(domains, nucleus=nucleus, keys=keys)


def calibrate_logs(
    spark: SparkSession,
    sections: DataFrame,
    targets: DataFrame,
    compounds: DataFrame,
    table: str,
) -> tuple[DataFrame, DataFrame]:
    """From parsed logs to calibrated shifts: (shifts, per molecule: status and message).

    ``sections`` has (mol_id, atom_index, sigma), ``targets`` (mol_id, atom_index, nucleus, functional, basis) and
    ``compounds`` the shieldings of reference compounds. Methods the reference ``table`` lacks are computed and added.
    A molecule with an atom that has no shielding, or whose method has no reference for one of its atoms, is an error
    that says so, and has no shifts.
    """
    missing = calibration.missing_keys(targets, read_reference_table(spark, table))
    keyed = compounds.withColumn("functional", calibration.method_key(F.col("functional"))).withColumn(
        "basis", calibration.method_key(F.col("basis"))
    )
    computed = calibration.reference_mean(keyed.join(missing, ["functional", "basis"], "left_semi"))
    known = upsert_reference(spark, table, computed)
    rows = materialize(calibration.with_shielding(targets, sections), "targets")
    complete, judged = calibration.judge_complete(rows)
    calibrated = materialize(calibration.calibrate(complete, known), "calibrated")
    unknown = calibrated.where("sigma_ref is null").groupBy("mol_id").agg(
        F.min(F.struct(calibration.method_key(F.col("functional")).alias("f"), calibration.method_key(F.col("basis")).alias("b"))).alias("_method")
    )
    lacking = F.col("_method").isNotNull()
    status = judged.join(unknown, "mol_id", "left").select(
        "mol_id",
        F.when(lacking, "error").otherwise(F.col("status")).alias("status"),
        F.when(lacking, F.format_string(C.MESSAGE_REFERENCE_MISSING, "_method.f", "_method.b")).otherwise(F.col("message")).alias("message"),
    )
    return calibrated.join(unknown.select("mol_id"), "mol_id", "left_anti"), status


def flat_rows(individual: DataFrame, merged: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows to draw, by the mode of each request, without invalid atom indices (column n_atoms) and renamed."""
    chosen = normalize.mode_select(individual, merged, requests)
    valid, _ = validate.index_check_lenient(chosen)
    return normalize.shift_projection(valid)


def requested_spectra(
    headers: DataFrame,
    shifts: DataFrame,
    atoms: DataFrame,
    bonds: DataFrame,
    requests: DataFrame,
    spectra_of: DataFrame,
    *,
    nucleus: str = "1H",
    points: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From the engines' predictions to the spectra that were asked for: (signals, points, metadata).

    ``requests`` says for each molecule whether its engines are drawn one by one or merged, ``spectra_of`` to which
    spectrum it belongs. Merged molecules of a spectrum are drawn under the engine name ``consensus``.
    """
    checked, rows = check_and_annotate(headers, shifts, atoms, bonds, nucleus=nucleus)
    if "confidence" not in rows.columns:
        rows = rows.withColumn("confidence", F.lit(None).cast("double"))
    merged, _ = merge_rows(checked, rows.drop("n_atoms", "confidence"))
    sizes = rows.groupBy("mol_id").agg(F.max("n_atoms").alias("n_atoms"))
    merged = merged.withColumns({"engine": F.lit("consensus"), "confidence": F.lit(None).cast("double")}).join(sizes, "mol_id")
    flat = flat_rows(rows, merged, requests).withColumnRenamed("std_ppm", "std")
    return draw_spectra(flat, spectra_of, nucleus=nucleus, points=points)
