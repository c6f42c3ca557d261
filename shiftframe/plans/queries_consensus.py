"""Registered queries: merging engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe.constants import DEFAULT_WEIGHTS
from shiftframe.operators import consensus as op
from shiftframe.plans.registry import query
from shiftframe.plans.views import Views

_MERGED_SQL = """
    SELECT mol_id, atom_index, round(sum(w * shift_ppm) / sum(w), 6) AS shift_ppm,
           round(CASE WHEN count(*) > 1 THEN stddev_pop(shift_ppm) END, 6) AS std_ppm,
           string_agg(engine, ',' ORDER BY engine_pos) AS contributing_engines
    FROM (SELECT mol_id, atom_index, shift_ppm, CASE WHEN mol_id % 6 = 0 AND engine = 'orca' THEN 'own' ELSE engine END AS engine,
                 CASE WHEN mol_id % 6 = 0 AND engine = 'orca' THEN 4 ELSE engine_pos END AS engine_pos,
                 CAST(CASE WHEN mol_id % 6 = 0 AND engine = 'orca' THEN 0.4 WHEN engine = 'cdk' THEN 0.5 WHEN engine = 'cascade' THEN 0.3 ELSE 0.2 END AS DOUBLE) AS w
          FROM predictions WHERE status = 'ok') p
    GROUP BY mol_id, atom_index
"""


def _merged(v: Views) -> DataFrame:
    """Every sixth molecule has a fourth engine with a weight of its own in place of the third."""
    own = (F.col("mol_id") % 6 == 0) & (F.col("engine") == "orca")
    rows = v.predictions().select(
        "mol_id",
        "atom_index",
        "status",
        "shift_ppm",
        F.when(own, "own").otherwise(F.col("engine")).alias("engine"),
        F.when(own, 4).otherwise(F.col("engine_pos")).alias("engine_pos"),
    )
    return op.consensus(rows, weight=op.weight_of(F.col("engine"), {**DEFAULT_WEIGHTS, "own": 0.4}))


@query("consensus", _MERGED_SQL)
def consensus(v: Views) -> DataFrame:
    """Merged value, spread and contributors per atom."""
    return _merged(v).select(
        "mol_id",
        "atom_index",
        F.round("shift_ppm", 6).alias("shift_ppm"),
        F.round("std_ppm", 6).alias("std_ppm"),
        F.array_join("contributing_engines", ",").alias("contributing_engines"),
    )


@query("consensus_std", f"SELECT mol_id, atom_index, std_ppm FROM ({_MERGED_SQL}) m")
def consensus_std(v: Views) -> DataFrame:
    return _merged(v).select("mol_id", "atom_index", F.round("std_ppm", 6).alias("std_ppm"))


@query(
    "contributors",
    """
    SELECT mol_id, atom_index, string_agg(engine, ',' ORDER BY engine_pos) AS contributing_engines
    FROM predictions WHERE status = 'ok' GROUP BY mol_id, atom_index
    """,
)
def contributors(v: Views) -> DataFrame:
    ok = v.predictions().where("status = 'ok'")
    return op.contributors(ok).select(
        "mol_id", "atom_index", F.array_join("contributing_engines", ",").alias("contributing_engines")
    )


@query(
    "consensus_template",
    """
    SELECT mol_id, atom_index, engine AS first_engine, round(shift_ppm, 6) AS first_shift_ppm
    FROM (SELECT *, row_number() OVER (PARTITION BY mol_id, atom_index ORDER BY engine_pos) AS rn
          FROM predictions WHERE status = 'ok') t
    WHERE rn = 1
    """,
)
def consensus_template(v: Views) -> DataFrame:
    ok = v.predictions().where("status = 'ok'")
    return op.consensus_template(ok, ["engine", "shift_ppm"]).select(
        "mol_id",
        "atom_index",
        F.col("engine").alias("first_engine"),
        F.round("shift_ppm", 6).alias("first_shift_ppm"),
    )


def _overrides(headers: DataFrame) -> DataFrame:
    return headers.where("mol_id % 5 = 0 AND engine <> 'orca'").select(
        "mol_id", "engine", F.when(F.col("engine") == "cdk", F.lit(0.0)).otherwise(F.lit(0.9)).alias("weight")
    )


def _with_unknown_engine(headers: DataFrame) -> DataFrame:
    extra = headers.where("engine = 'cdk'").select(
        "mol_id", F.lit("other").alias("engine"), F.lit(4).alias("engine_pos"), F.lit("ok").alias("status")
    )
    return headers.unionByName(extra)


_OVERLAY_SQL = """
    SELECT h.mol_id, h.engine, h.engine_pos, h.status,
           CAST(coalesce(CASE WHEN h.mol_id % 5 = 0 AND h.engine = 'cdk' THEN 0
                              WHEN h.mol_id % 5 = 0 AND h.engine = 'cascade' THEN 0.9 END,
                         CASE h.engine WHEN 'cdk' THEN 0.5 WHEN 'cascade' THEN 0.3 WHEN 'orca' THEN 0.2 END,
                         0) AS DOUBLE) AS weight
    FROM (SELECT mol_id, engine, engine_pos, status FROM engine_results
          UNION ALL SELECT DISTINCT mol_id, 'other', 4, 'ok' FROM engine_results) h
"""


@query("weight_overlay", _OVERLAY_SQL)
def weight_overlay(v: Views) -> DataFrame:
    headers = v.engine_results()
    return op.weight_overlay(_with_unknown_engine(headers), _overrides(headers))


@query(
    "weights_used",
    f"""
    WITH o AS ({_OVERLAY_SQL}), used AS (
        SELECT mol_id, engine, weight / sum(weight) OVER (PARTITION BY mol_id) AS weight
        FROM o WHERE status = 'ok' AND weight > 0)
    SELECT m.mol_id, u.engine, round(u.weight, 6) AS weight
    FROM (SELECT DISTINCT mol_id FROM o) m LEFT JOIN used u ON u.mol_id = m.mol_id
    """,
)
def weights_used(v: Views) -> DataFrame:
    """Scaled weights per molecule; a molecule with an empty map keeps one row without an engine."""
    headers = v.engine_results()
    used = op.weights_used(op.weight_overlay(_with_unknown_engine(headers), _overrides(headers)))
    return used.select("mol_id", F.explode_outer("weights_used").alias("engine", "weight")).select(
        "mol_id", "engine", F.round("weight", 6).alias("weight")
    )
