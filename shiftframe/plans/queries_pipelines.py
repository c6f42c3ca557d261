"""Registered queries: the end-to-end jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe.functions.workspace import new_path
from shiftframe.plans import pipelines
from shiftframe.plans.queries_signals import SPEC_NUCLEUS
from shiftframe.plans.queries_structure import _NEIGHBOR_SQL
from shiftframe.plans.registry import query
from shiftframe.plans.views import Views
from shiftframe.sources.logs import log_sections


@query(
    "merge_engines",
    f"""
    WITH n AS (SELECT mol_id, count(*) AS n_atoms FROM atoms GROUP BY mol_id),
    bad AS (SELECT DISTINCT p.mol_id, p.engine FROM predictions p JOIN n ON n.mol_id = p.mol_id WHERE p.atom_index >= n.n_atoms),
    ok AS (SELECT p.*, CAST(CASE engine WHEN 'cdk' THEN 0.5 WHEN 'cascade' THEN 0.3 ELSE 0.2 END AS DOUBLE) AS w FROM predictions p
           WHERE status = 'ok' AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.mol_id = p.mol_id AND bad.engine = p.engine)),
    merged AS (SELECT mol_id, atom_index, round(sum(w * shift_ppm) / sum(w), 6) AS shift_ppm,
                      round(CASE WHEN count(*) > 1 THEN stddev_pop(shift_ppm) END, 6) AS std_ppm,
                      string_agg(engine, ',' ORDER BY engine_pos) AS contributing_engines FROM ok GROUP BY mol_id, atom_index),
    h AS (SELECT *, CASE WHEN neighbor_count <= 0 THEN 's' WHEN is_aromatic OR NOT is_sp3 THEN 'm'
                 ELSE CASE neighbor_count WHEN 1 THEN 'd' WHEN 2 THEN 't' WHEN 3 THEN 'q' WHEN 4 THEN 'quint' WHEN 5 THEN 'sext' WHEN 6 THEN 'sept' ELSE 'm' END END AS multiplicity
          FROM ({_NEIGHBOR_SQL}) k)
    SELECT m.*, h.anchor AS attached_atom_index, h.multiplicity, h.neighbor_count
    FROM merged m LEFT JOIN h ON h.mol_id = m.mol_id AND h.atom_index = m.atom_index
    """,
)
def merge_engines(v: Views) -> DataFrame:
    atoms = v.atoms()
    shifts = v.predictions().select("mol_id", "engine", "atom_index", F.lit("H").alias("symbol"), "shift_ppm")
    _, merged, _ = pipelines.merge_engines(v.engine_results(), shifts, atoms, v.bonds(atoms))
    return merged.select(
        "mol_id",
        "atom_index",
        F.round("shift_ppm", 6).alias("shift_ppm"),
        F.round("std_ppm", 6).alias("std_ppm"),
        F.array_join("contributing_engines", ",").alias("contributing_engines"),
        "attached_atom_index",
        "multiplicity",
        "neighbor_count",
    )


@query(
    "draw_spectra",
    """
    WITH two AS (SELECT *, 'own' AS engine FROM protons UNION ALL SELECT mol_id, atom_index, assignment_group, shift_ppm + 0.05, multiplicity, coupling_hz, 'other' FROM protons),
    sig AS (SELECT mol_id % 32 AS spec_id, engine, avg(shift_ppm) AS shift FROM two GROUP BY mol_id, engine, assignment_group),
    dom AS (SELECT spec_id, least(200::DOUBLE, greatest(0::DOUBLE, min(shift) - 8)) AS low, least(200::DOUBLE, greatest(0::DOUBLE, max(shift) + 8)) AS high FROM sig GROUP BY spec_id),
    ax AS (SELECT spec_id, engine, CAST(i AS INTEGER) AS i, low + i * ((high - low) / 4095) AS x
           FROM (SELECT DISTINCT spec_id, engine FROM sig) JOIN dom USING (spec_id) CROSS JOIN range(4096) AS r(i)),
    raw AS (SELECT ax.spec_id, ax.engine, ax.i, any_value(ax.x) AS x, sum(0.0036::DOUBLE / ((ax.x - l.shift) * (ax.x - l.shift) + 0.0036::DOUBLE)) AS y
            FROM ax JOIN sig l ON l.spec_id = ax.spec_id AND l.engine = ax.engine GROUP BY ax.spec_id, ax.engine, ax.i)
    SELECT spec_id, engine, i, round(x, 6) AS x, round(y / max(y) OVER (PARTITION BY spec_id, engine), 6) AS y FROM raw
    """,
)
def draw_spectra(v: Views) -> DataFrame:
    """Molecules are mixed into 32 samples, each drawn for two engines on one domain."""
    protons = v.protons().withColumnRenamed("shift_ppm", "shift")
    both = F.array(
        F.struct(F.lit("own").alias("engine"), F.col("shift")),
        F.struct(F.lit("other").alias("engine"), (F.col("shift") + 0.05).alias("shift")),
    )
    two = protons.select(*[c for c in protons.columns if c != "shift"], F.inline(both))
    spectra_of = protons.select("mol_id").distinct().withColumn("spec_id", F.col("mol_id") % 32)
    _, points, _ = pipelines.draw_spectra(two, spectra_of, nucleus=SPEC_NUCLEUS)
    return points.select("spec_id", "engine", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_TARGETS_SQL = r"""
    targets AS (SELECT mol_id, atom_index, CASE atomic_num WHEN 1 THEN '1H' ELSE '13C' END AS nucleus, CASE WHEN mol_id % 10 = 9 THEN 3 ELSE mol_id % 3 END AS method FROM atoms WHERE atomic_num IN (1, 6)),
    sec AS (SELECT file_id AS mol_id, CAST(regexp_extract(line, 'Nucleus\s+(\d+)', 1) AS INTEGER) AS atom_index, CAST(regexp_extract(nxt, '(-?\d+\.\d+)', 1) AS DOUBLE) AS sigma
            FROM (SELECT *, lead(line) OVER (PARTITION BY file_id ORDER BY line_no) AS nxt FROM log_lines) l WHERE line LIKE ' Nucleus%' AND nxt LIKE '%Isotropic%'),
    ref AS (SELECT lower(trim(functional)) AS f, lower(trim(basis)) AS b, avg(sigma) FILTER (atomic_num = 1) AS h, avg(sigma) FILTER (atomic_num = 6) AS c
            FROM shieldings GROUP BY 1, 2),
    m AS (SELECT 0 AS method, 'pbe' AS f, 'def2-svp' AS b UNION ALL SELECT 1, 'pbe', 'def2-svp' UNION ALL SELECT 2, 'b3lyp', 'def2-tzvp' UNION ALL SELECT 3, 'new', 'def2-svp')
"""


@query(
    "calibrate_logs",
    f"""
    WITH {_TARGETS_SQL},
    j AS (SELECT t.*, s.sigma, m.f, m.b, CASE t.nucleus WHEN '1H' THEN ref.h ELSE ref.c END AS sigma_ref
          FROM targets t LEFT JOIN sec s ON s.mol_id = t.mol_id AND s.atom_index = t.atom_index JOIN m ON m.method = t.method
          LEFT JOIN ref ON ref.f = m.f AND ref.b = m.b AND ref.h IS NOT NULL AND ref.c IS NOT NULL),
    judged AS (SELECT mol_id, CASE
          WHEN bool_or(sigma IS NULL) THEN 'ORCA did not emit an isotropic shielding for atom ' || min(atom_index) FILTER (sigma IS NULL)
            || ' (' || min_by(ltrim(nucleus, '0123456789'), atom_index) FILTER (sigma IS NULL) || ')'
          WHEN bool_or(sigma_ref IS NULL) THEN 'No complete reference shieldings for ' || min(f) || ' / ' || min(b) END AS message FROM j GROUP BY mol_id)
    SELECT j.mol_id, j.atom_index, j.nucleus, round(sigma_ref - sigma, 6) AS shift_ppm, NULL::VARCHAR AS message
    FROM j JOIN judged USING (mol_id) WHERE message IS NULL
    UNION ALL SELECT mol_id, NULL, NULL, NULL, message FROM judged WHERE message IS NOT NULL
    """,
)
def calibrate_logs(v: Views) -> DataFrame:
    """Shifts of the molecules that can be calibrated, and one row with the reason for each of the others.

    All molecules serve as reference compounds; the method of every tenth molecule is one that they do not have.
    """
    number, kind = F.col("atomic_num"), F.when(F.col("mol_id") % 10 == 9, 3).otherwise(F.col("mol_id") % 3)
    targets = v.atoms().where(number.isin(1, 6)).select(
        "mol_id",
        "atom_index",
        F.when(number == 1, "1H").otherwise("13C").alias("nucleus"),
        F.when(kind == 0, " PBE ").when(kind == 1, "pbe").when(kind == 2, "B3LYP").otherwise("New").alias("functional"),
        F.when(kind == 2, "def2-TZVP").otherwise("def2-SVP").alias("basis"),
    )
    sections = log_sections(v.log_lines()).withColumnRenamed("file_id", "mol_id")
    table = new_path(v.spark, "reference")
    shifts, status = pipelines.calibrate_logs(v.spark, sections, targets, v.shieldings(), table)
    failed = status.where("status = 'error'").select("mol_id", "message")
    done = shifts.select("mol_id", "atom_index", "nucleus", F.round("shift_ppm", 6).alias("shift_ppm"))
    return done.unionByName(failed, allowMissingColumns=True)


@query("requested_spectra")
def requested_spectra(v: Views) -> DataFrame:
    """1H spectra on the full grid, from predictions to points: the engines of every third molecule are drawn one by one
    and those of the others merged; molecules are mixed into eight samples."""
    atoms = v.atoms()
    shifts = v.predictions().select(
        "mol_id", "engine", "atom_index", F.lit("H").alias("symbol"), F.pmod(F.col("shift_ppm"), F.lit(9.0)).alias("shift_ppm")
    )
    mol = F.col("mol_id")
    requests = v.engine_results().select("mol_id").distinct().withColumn("mode", F.when(mol % 3 == 0, "individual").otherwise("consensus"))
    spectra_of = requests.select("mol_id", (mol % 8).alias("spec_id"))
    _, points, _ = pipelines.requested_spectra(v.engine_results(), shifts, atoms, v.bonds(atoms), requests, spectra_of)
    return points.select("spec_id", "engine", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
