"""Checks on records; a rejected record stays visible with its reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftframe import constants as C
from shiftframe.functions.once import once
from shiftframe.functions.text import reference_id, string_gate, stripped
from shiftframe.schemas import REQUEST


def _outside(index: Column, n_atoms: Column) -> Column:
    return (index < 0) | (index >= n_atoms)


def index_check_strict(
    headers: DataFrame,
    shifts: DataFrame,
    *,
    keys: Sequence[str] = ("mol_id", "engine"),
    atom: str = "atom_index",
    attached: str | Sequence[str] = "attached_atom_index",
    n_atoms: str = "n_atoms",
) -> tuple[DataFrame, DataFrame]:
    """(headers, shifts) where one index outside the molecule turns the whole (molecule, engine) into an error.

    ``attached`` may name several columns, which are checked in the same pass. The keys at fault are found with a map-side distinct and joined back, so no group is gathered.
    """
    count = F.col(n_atoms)
    wrong = F.col(atom).isNull() | _outside(F.col(atom), count)
    for name in [attached] if isinstance(attached, str) else attached:
        wrong |= F.coalesce(_outside(F.col(name), count), F.lit(False))
    faults = shifts.where(wrong).select(*keys).distinct()
    failed = F.col("_fault")
    name = F.col(keys[-1])
    message = F.format_string(C.MESSAGE_ENGINE_FAILED, name, reference_id(*[F.col(k).cast("string") for k in keys]))
    kept = [c for c in headers.columns if c not in ("status", "message")]
    old_message = F.col("message") if "message" in headers.columns else F.lit(None).cast("string")
    checked = headers.join(faults.withColumn("_fault", F.lit(True)), list(keys), "left").select(
        *kept,
        F.when(failed, "error").otherwise(F.col("status")).alias("status"),
        F.when(failed, message).otherwise(old_message).alias("message"),
    )
    return checked, shifts.join(faults, list(keys), "left_anti")


def _whole_inside(index: Column, n_atoms: Column) -> Column:
    number = index.cast("double")
    return (number == F.floor(number)) & (number >= 0) & (number < n_atoms)


def index_is_valid(atom: Column, attached: Column, n_atoms: Column) -> Column:
    """A whole atom index inside the molecule, and no attached index or one of the same kind."""
    return F.coalesce(_whole_inside(atom, n_atoms), F.lit(False)) & (
        attached.isNull() | F.coalesce(_whole_inside(attached, n_atoms), F.lit(False))
    )


def index_check_lenient(
    shifts: DataFrame,
    *,
    mol: str = "mol_id",
    atom: str = "atom_index",
    attached: str = "attached_atom_index",
    n_atoms: str = "n_atoms",
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, per molecule: kept, dropped and the warning when something was dropped)."""
    valid = index_is_valid(F.col(atom), F.col(attached), F.col(n_atoms))
    counts = shifts.groupBy(mol).agg(F.count_if(valid).alias("kept"), F.count_if(~valid).alias("dropped"))
    warning = F.when(F.col("dropped") > 0, F.format_string(C.MESSAGE_DROPPED, F.col("dropped")))
    return shifts.where(valid), counts.withColumn("warning", warning)


def drop_unusable(shifts: DataFrame, *, value: str = "shift_ppm") -> DataFrame:
    """Keep rows with a value of at least 0; null and not-a-number go too."""
    return shifts.where((F.col(value) >= 0) & ~F.isnan(value))


def payload_pick(payload: Column) -> Column:
    """Second element of a longer array, else the first; null for an empty one."""
    return F.when(F.size(payload) > 1, F.get(payload, F.lit(1))).otherwise(F.get(payload, F.lit(0)))


def size_gate(
    atoms: DataFrame,
    *,
    mol: str = "mol_id",
    atomic_num: str = "atomic_num",
    max_heavy: int = C.MAX_HEAVY_ATOMS,
    max_atoms: int = C.MAX_TOTAL_ATOMS,
) -> DataFrame:
    """Per molecule: heavy and total atom counts, and the reason when it is too large."""
    counts = atoms.groupBy(mol).agg(
        F.count_if(F.col(atomic_num) > 1).alias("n_heavy"), F.count(F.lit(1)).alias("n_atoms")
    )
    reason = F.when(
        F.col("n_heavy") > max_heavy, F.format_string(C.MESSAGE_TOO_MANY_HEAVY, "n_heavy", F.lit(max_heavy))
    ).when(F.col("n_atoms") > max_atoms, F.format_string(C.MESSAGE_TOO_MANY_ATOMS, "n_atoms", F.lit(max_atoms)))
    return counts.withColumn("reason", reason)


def request_gate(requests: DataFrame, *, payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(accepted requests with parsed fields and defaults, quarantined requests with their reasons)."""
    text = F.col(payload)
    sent = F.json_object_keys(text)
    parsed = once(requests, _r=F.from_json(text, REQUEST), _sent=sent)

    def given(key: str) -> Column:
        return F.array_contains("_sent", key)

    def field(key: str) -> Column:
        return F.col(f"_r.{key}")

    def filled(key: str, default: Column) -> Column:
        return F.when(given(key), field(key)).otherwise(default)

    engines = filled("engines", F.array(F.lit("cdk")))
    mode = filled("mode", F.lit("individual"))
    nucleus = filled("nucleus", F.lit("1H"))
    strategy = filled("conformer_strategy", F.lit("fast"))
    weights = field("weights")
    known = F.array(*[F.lit(name) for name in C.DEFAULT_WEIGHTS])
    unknown = F.array_except("_sent", F.array(*[F.lit(k) for k in C.REQUEST_KEYS]))
    weights_bad = (given("weights") & weights.isNull() & F.get_json_object(text, "$.weights").isNotNull()) | ~F.coalesce(
        (F.size(F.array_except(F.map_keys(weights), known)) == 0)
        & (F.size(F.array_compact(F.map_values(weights))) == F.size(weights))
        & F.coalesce(F.array_min(F.map_values(weights)) >= 0, F.lit(True)),
        F.lit(True),
    )

    def fails(rule: Column, reason: Column | str) -> Column:
        return F.when(F.coalesce(rule, F.lit(True)), reason)

    reasons = F.array_compact(
        F.array(
            F.when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(unknown), ","))),
            fails(~F.coalesce(F.length(field("smiles")), F.lit(0)).between(1, C.MAX_STRING_LENGTH), "smiles"),
            fails(~F.size(engines).between(1, 3) | (F.size(F.array_except(engines, known)) > 0), "engines"),
            fails(~mode.isin(*C.MODES), "mode"),
            fails(~nucleus.isin(*C.NUCLEI), "nucleus"),
            fails(~strategy.isin(*C.CONFORMER_STRATEGIES), "conformer_strategy"),
            F.when(weights_bad, "weights"),
        )
    )
    judged = once(
        parsed, _reasons=F.when(F.col("_sent").isNull(), F.array(F.lit("malformed"))).otherwise(reasons)
    )
    own = requests.columns
    accepted = judged.where(F.size("_reasons") == 0).select(
        *own,
        field("smiles").alias("smiles"),
        engines.alias("engines"),
        mode.alias("mode"),
        nucleus.alias("nucleus"),
        strategy.alias("conformer_strategy"),
        weights.alias("weights"),
    )
    quarantined = judged.where(F.size("_reasons") > 0).select(*own, F.array_join("_reasons", "; ").alias("reason"))
    return accepted, quarantined


def gate_strings(strings: DataFrame, *, text: str = "s") -> DataFrame:
    """Add the trimmed string and the reason against it."""
    return strings.withColumn("core", stripped(F.col(text))).withColumn("reason", string_gate(F.col(text)))
