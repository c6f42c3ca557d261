"""Registered queries: ensembles, calibration, graphs, time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe.operators import calibration, ensemble, graph, temporal
from shiftframe.plans.registry import query
from shiftframe.plans.views import Views


@query(
    "boltzmann_mean",
    """
    WITH w AS (SELECT mol_id, conf_id, exp(-(energy_kcal - min(energy_kcal) OVER (PARTITION BY mol_id)) / CAST(0.001987 * 298.15 AS DOUBLE)) AS w
               FROM conformers)
    SELECT s.mol_id, s.atom_index, round(sum(w.w * s.shift_ppm) / sum(w.w), 6) AS shift_ppm, count(*) AS n_conformers, 'ok' AS status
    FROM conformer_shifts s JOIN w ON w.mol_id = s.mol_id AND w.conf_id = s.conf_id GROUP BY s.mol_id, s.atom_index
    """,
)
def boltzmann_mean(v: Views) -> DataFrame:
    mean = ensemble.boltzmann_mean(v.conformers(), v.conformer_shifts())
    return mean.withColumn("shift_ppm", F.round("shift_ppm", 6))


@query(
    "rank_conformers",
    """
    SELECT mol_id, conf_id, round(energy_kcal, 6) AS energy_kcal, flag,
           row_number() OVER (PARTITION BY mol_id ORDER BY energy_kcal, conf_id) AS rank FROM conformers
    """,
)
def rank_conformers(v: Views) -> DataFrame:
    return ensemble.rank_conformers(v.conformers()).withColumn("energy_kcal", F.round("energy_kcal", 6))


@query(
    "best_conformer",
    """
    SELECT mol_id, coalesce((min_by(conf_id, {'e': energy_kcal, 'c': conf_id}) FILTER (flag <> -1 AND mol_id % 7 <> 0)), min(conf_id)) AS conf_id
    FROM conformers GROUP BY mol_id
    """,
)
def best_conformer(v: Views) -> DataFrame:
    """In every seventh molecule all conformers failed."""
    rows = v.conformers().withColumn("flag", F.when(F.col("mol_id") % 7 == 0, -1).otherwise(F.col("flag")))
    return ensemble.best_conformer(rows)


_TARGET_SIGMA_SQL = "SELECT *, CASE atomic_num WHEN 1 THEN '1H' WHEN 6 THEN '13C' END AS nucleus FROM shieldings WHERE atomic_num IN (1, 6)"


def _target_sigma(v: Views) -> DataFrame:
    number = F.col("atomic_num")
    return v.shieldings().where(number.isin(1, 6)).withColumn("nucleus", F.when(number == 1, "1H").otherwise("13C"))


@query(
    "calibrate",
    f"""
    SELECT s.mol_id, s.atom_index, s.nucleus, round(r.sigma - s.sigma, 6) AS shift_ppm
    FROM ({_TARGET_SIGMA_SQL}) s LEFT JOIN reference_sigma r
      ON r.functional = lower(trim(s.functional)) AND r.basis = lower(trim(s.basis)) AND r.nucleus = s.nucleus
    """,
)
def calibrate(v: Views) -> DataFrame:
    return calibration.calibrate(_target_sigma(v), v.reference_sigma()).select(
        "mol_id", "atom_index", "nucleus", F.round("shift_ppm", 6).alias("shift_ppm")
    )


@query(
    "calibrate_complete",
    f"""
    SELECT mol_id, min(atom_index) FILTER (sigma IS NULL) AS first_missing,
           CASE WHEN count(*) FILTER (sigma IS NULL) > 0 THEN 'error' ELSE 'ok' END AS status,
           'ORCA did not emit an isotropic shielding for atom ' || min(atom_index) FILTER (sigma IS NULL) || ' ('
             || min_by(ltrim(nucleus, '0123456789'), atom_index) FILTER (sigma IS NULL) || ')' AS message,
           CASE WHEN count(*) FILTER (sigma IS NULL) > 0 THEN 0 ELSE count(*) END AS n_rows
    FROM ({_TARGET_SIGMA_SQL}) s GROUP BY mol_id
    """,
)
def calibrate_complete(v: Views) -> DataFrame:
    targets = _target_sigma(v)
    rows, status = calibration.calibrate_complete(targets.drop("sigma"), targets)
    counts = rows.groupBy("mol_id").agg(F.count(F.lit(1)).alias("n"))
    return status.join(counts, "mol_id", "left").select(
        "mol_id", "first_missing", "status", "message", F.coalesce("n", F.lit(0).cast("long")).alias("n_rows")
    )


@query(
    "reference_mean",
    """
    WITH m AS (SELECT lower(trim(functional)) AS functional, lower(trim(basis)) AS basis,
                      avg(sigma) FILTER (atomic_num = 1) AS h, avg(sigma) FILTER (atomic_num = 6) AS c FROM shieldings GROUP BY 1, 2)
    SELECT functional, basis, '1H' AS nucleus, round(h, 6) AS sigma FROM m WHERE h IS NOT NULL AND c IS NOT NULL
    UNION ALL SELECT functional, basis, '13C', round(c, 6) FROM m WHERE h IS NOT NULL AND c IS NOT NULL
    """,
)
def reference_mean(v: Views) -> DataFrame:
    return calibration.reference_mean(v.shieldings()).withColumn("sigma", F.round("sigma", 6))


@query(
    "missing_keys",
    """
    SELECT DISTINCT lower(p_brand) AS functional, lower(p_type) AS basis FROM part
    WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 50 = 0 AND lower(q.p_brand) = lower(part.p_brand) AND lower(q.p_type) = lower(part.p_type))
    """,
)
def missing_keys(v: Views) -> DataFrame:
    part = v.table("part")
    known = part.where("p_partkey % 50 = 0").select(
        F.col("p_brand").alias("functional"), F.col("p_type").alias("basis"), F.lit("1H").alias("nucleus"), F.lit(1.0).alias("sigma")
    )
    return calibration.missing_keys(part.select(F.col("p_brand").alias("functional"), F.col("p_type").alias("basis")), known)


# --- graphs -----------------------------------------------------------------------------------------------------


@query(
    "atom_map_reconcile",
    """
    WITH b AS (SELECT mol_id, atom_index, CASE WHEN mol_id % 11 = 0 AND atom_index = 2 THEN 'X' ELSE symbol END AS symbol
               FROM atoms WHERE NOT (mol_id % 13 = 0 AND atom_index = 3)),
    j AS (SELECT coalesce(a.mol_id, b.mol_id) AS mol_id, coalesce(a.atom_index, b.atom_index) AS atom_index,
                 a.mol_id IS NOT NULL AND b.mol_id IS NOT NULL AND a.symbol IS NOT DISTINCT FROM b.symbol AS same
          FROM atoms a FULL JOIN b ON a.mol_id = b.mol_id AND a.atom_index = b.atom_index)
    SELECT mol_id, bool_and(same) AS accepted, min(atom_index) FILTER (NOT same) AS first_difference FROM j GROUP BY mol_id
    """,
)
def atom_map_reconcile(v: Views) -> DataFrame:
    mol, atom = F.col("mol_id"), F.col("atom_index")
    atoms = v.atoms().select("mol_id", "atom_index", "symbol")
    other = atoms.where(~((mol % 13 == 0) & (atom == 3))).withColumn(
        "symbol", F.when((mol % 11 == 0) & (atom == 2), "X").otherwise(F.col("symbol"))
    )
    return graph.atom_map_reconcile(atoms, other)


_EDGES_SQL = "SELECT mol_id, bond_idx, a AS atom_index, b AS nbr FROM bonds UNION ALL SELECT mol_id, bond_idx, b, a FROM bonds"
_ANCHOR_SQL = f"""
    SELECT h.mol_id, h.atom_index, min_by(e.nbr, e.bond_idx) AS anchor
    FROM atoms h JOIN ({_EDGES_SQL}) e ON e.mol_id = h.mol_id AND e.atom_index = h.atom_index
    JOIN atoms n ON n.mol_id = e.mol_id AND n.atom_index = e.nbr AND n.atomic_num > 1
    WHERE h.atomic_num = 1 GROUP BY h.mol_id, h.atom_index
"""
_NEIGHBOR_SQL = f"""
    SELECT p.mol_id, p.atom_index, p.anchor, c.atomic_num, c.is_aromatic, c.is_sp3,
           CAST(CASE WHEN c.atomic_num = 6 THEN coalesce((
               SELECT count(*) FROM ({_EDGES_SQL}) e1 JOIN atoms n ON n.mol_id = e1.mol_id AND n.atom_index = e1.nbr AND n.atomic_num = 6
               JOIN ({_EDGES_SQL}) e2 ON e2.mol_id = n.mol_id AND e2.atom_index = n.atom_index
               JOIN atoms h ON h.mol_id = e2.mol_id AND h.atom_index = e2.nbr AND h.atomic_num = 1
               WHERE e1.mol_id = p.mol_id AND e1.atom_index = p.anchor), 0) ELSE 0 END AS BIGINT) AS neighbor_count
    FROM ({_ANCHOR_SQL}) p JOIN atoms c ON c.mol_id = p.mol_id AND c.atom_index = p.anchor
"""


@query(
    "anchor_join",
    f"SELECT a.mol_id, a.atom_index, a.atomic_num, p.anchor FROM atoms a LEFT JOIN ({_ANCHOR_SQL}) p ON p.mol_id = a.mol_id AND p.atom_index = a.atom_index",
)
def anchor_join(v: Views) -> DataFrame:
    atoms = v.atoms()
    return graph.anchor_join(atoms, v.bonds(atoms)).select("mol_id", "atom_index", "atomic_num", "anchor")


@query("neighbor_protons", f"SELECT mol_id, atom_index, anchor, neighbor_count FROM ({_NEIGHBOR_SQL}) n")
def neighbor_protons(v: Views) -> DataFrame:
    atoms = v.atoms()
    return graph.neighbor_protons(atoms, v.bonds(atoms)).select("mol_id", "atom_index", "anchor", "neighbor_count")


@query(
    "multiplicity_rule",
    f"""
    SELECT mol_id, atom_index, anchor AS attached_atom_index, 'h@' || anchor AS assignment_group,
           CASE WHEN neighbor_count <= 0 THEN 's' WHEN is_aromatic OR NOT is_sp3 THEN 'm'
                ELSE CASE neighbor_count WHEN 1 THEN 'd' WHEN 2 THEN 't' WHEN 3 THEN 'q' WHEN 4 THEN 'quint' WHEN 5 THEN 'sext' WHEN 6 THEN 'sept' ELSE 'm' END END AS multiplicity,
           CASE WHEN neighbor_count > 0 AND is_sp3 AND NOT is_aromatic THEN CAST(7 AS DOUBLE) END AS coupling_hz, neighbor_count
    FROM ({_NEIGHBOR_SQL}) n
    """,
)
def multiplicity_rule(v: Views) -> DataFrame:
    atoms = v.atoms()
    return graph.multiplicity_rule(atoms, v.bonds(atoms))


@query(
    "charge_spin",
    "SELECT mol_id, CAST(sum(formal_charge) AS BIGINT) AS charge, CAST(sum(radicals) + 1 AS BIGINT) AS spin_multiplicity FROM atoms GROUP BY mol_id",
)
def charge_spin(v: Views) -> DataFrame:
    return graph.charge_spin(v.atoms())


_PAIRS_SQL = """
    SELECT mol_id, atom_index, nbr, distance, CAST(rn AS INTEGER) AS rank FROM (
        SELECT a.mol_id, a.atom_index, b.atom_index AS nbr, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS distance,
               row_number() OVER (PARTITION BY a.mol_id, a.atom_index ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), b.atom_index) AS rn
        FROM atoms a JOIN atoms b ON a.mol_id = b.mol_id AND a.atom_index <> b.atom_index
        WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 3.0) p WHERE rn <= 4
"""
_ALL_PAIRS_SQL = f"""
    SELECT * FROM ({_PAIRS_SQL}) k UNION ALL
    SELECT mol_id, atom_index, atom_index, CAST(0 AS DOUBLE), 0 FROM atoms a
    WHERE NOT EXISTS (SELECT 1 FROM ({_PAIRS_SQL}) k WHERE k.mol_id = a.mol_id AND k.atom_index = a.atom_index)
"""


@query("radius_neighbors", f"SELECT mol_id, atom_index, nbr, round(distance, 6) AS distance, rank FROM ({_ALL_PAIRS_SQL}) p")
def radius_neighbors(v: Views) -> DataFrame:
    return graph.radius_neighbors(v.atoms(), cutoff=3.0, k=4).withColumn("distance", F.round("distance", 6))


_BOND_KEY_SQL = """
    SELECT b.*, b.bond_type || '|' || CAST(b.is_conjugated AS VARCHAR) || '|' || CAST(b.in_ring AS VARCHAR) || '|' ||
           least(x.symbol, y.symbol) || '-' || greatest(x.symbol, y.symbol) AS bond_key
    FROM bonds b JOIN atoms x ON x.mol_id = b.mol_id AND x.atom_index = b.a JOIN atoms y ON y.mol_id = b.mol_id AND y.atom_index = b.b
"""
_VOCABULARY = (
    ("unk", 1),
    ("SINGLE|false|false|C-C", 2),
    ("SINGLE|false|false|C-H", 3),
    ("AROMATIC|false|true|C-H", 4),
    ("DOUBLE|true|false|H-H", 5),
)
_VOCABULARY_SQL = "VALUES " + ", ".join(f"('{k}', {i})" for k, i in _VOCABULARY)
_TOKEN_SQL = f"""
    SELECT k.mol_id, k.bond_idx, k.a, k.b, k.bond_key, coalesce(t.class_id, 1) AS token
    FROM ({_BOND_KEY_SQL}) k LEFT JOIN ({_VOCABULARY_SQL}) AS t(key, class_id) ON t.key = k.bond_key
"""


def _tokens(v: Views, atoms: DataFrame) -> DataFrame:
    vocabulary = v.spark.sql(f"SELECT * FROM {_VOCABULARY_SQL} AS t(key, class_id)")
    return graph.vocab_encode(graph.keyed_bonds(atoms, v.bonds(atoms)), vocabulary, "bond_key")


@query("bond_key", f"SELECT mol_id, bond_idx, bond_key FROM ({_BOND_KEY_SQL}) k")
def bond_key(v: Views) -> DataFrame:
    atoms = v.atoms()
    return graph.keyed_bonds(atoms, v.bonds(atoms)).select("mol_id", "bond_idx", "bond_key")


@query("vocab_encode", f"SELECT mol_id, bond_idx, bond_key, token FROM ({_TOKEN_SQL}) t")
def vocab_encode(v: Views) -> DataFrame:
    return _tokens(v, v.atoms()).select("mol_id", "bond_idx", "bond_key", "token")


@query(
    "bond_feature_join",
    f"""
    SELECT p.mol_id, p.atom_index, p.nbr, coalesce(t.token, 0) AS bond_token
    FROM ({_ALL_PAIRS_SQL}) p LEFT JOIN ({_TOKEN_SQL}) t
      ON t.mol_id = p.mol_id AND least(t.a, t.b) = least(p.atom_index, p.nbr) AND greatest(t.a, t.b) = greatest(p.atom_index, p.nbr)
    """,
)
def bond_feature_join(v: Views) -> DataFrame:
    atoms = v.atoms()
    pairs = graph.radius_neighbors(atoms, cutoff=3.0, k=4)
    return graph.bond_feature_join(pairs, _tokens(v, atoms)).select("mol_id", "atom_index", "nbr", "bond_token")


@query(
    "edge_gather",
    """
    SELECT b.mol_id, b.bond_idx, x.symbol AS receiver, y.symbol AS sender
    FROM bonds b JOIN atoms x ON x.mol_id = b.mol_id AND x.atom_index = b.a JOIN atoms y ON y.mol_id = b.mol_id AND y.atom_index = b.b
    """,
)
def edge_gather(v: Views) -> DataFrame:
    atoms = v.atoms()
    received = graph.edge_gather(v.bonds(atoms), atoms, "symbol", end="a", name="receiver")
    return graph.edge_gather(received, atoms, "symbol", end="b", name="sender").select(
        "mol_id", "bond_idx", "receiver", "sender"
    )


@query(
    "segment_reduce",
    """
    SELECT a.mol_id, a.atom_index, 'sum' AS how, round(coalesce(sum(b.b * 1.5), 0), 6) AS value FROM atoms a LEFT JOIN bonds b ON b.mol_id = a.mol_id AND b.a = a.atom_index AND b.a <> -1 GROUP BY a.mol_id, a.atom_index
    UNION ALL SELECT a.mol_id, a.atom_index, 'mean', round(coalesce(avg(b.b * 1.5), 0), 6) FROM atoms a LEFT JOIN bonds b ON b.mol_id = a.mol_id AND b.a = a.atom_index GROUP BY a.mol_id, a.atom_index
    UNION ALL SELECT a.mol_id, a.atom_index, 'max', round(CAST(max(b.b * 1.5) AS DOUBLE), 6) FROM atoms a LEFT JOIN bonds b ON b.mol_id = a.mol_id AND b.a = a.atom_index GROUP BY a.mol_id, a.atom_index
    UNION ALL SELECT a.mol_id, a.atom_index, 'min', round(CAST(min(b.b * 1.5) AS DOUBLE), 6) FROM atoms a LEFT JOIN bonds b ON b.mol_id = a.mol_id AND b.a = a.atom_index GROUP BY a.mol_id, a.atom_index
    """,
)
def segment_reduce(v: Views) -> DataFrame:
    """Edge values into their receiving atoms; edges that point nowhere are added with index -1."""
    atoms = v.atoms()
    edges = v.bonds(atoms).select("mol_id", F.col("a").alias("atom_index"), (F.col("b") * F.lit(1.5)).alias("value"))
    edges = edges.unionByName(edges.withColumn("atom_index", F.lit(-1)))
    how = ["sum", "mean", "max", "min"]
    table = graph.segment_reduce(edges, atoms, "value", keys=["mol_id", "atom_index"], how=how)
    return table.unpivot(["mol_id", "atom_index"], how, "how", "value").withColumn("value", F.round("value", 6))


@query(
    "pair_distance",
    """
    SELECT b.mol_id, b.bond_idx, round(sqrt((x.x-y.x)*(x.x-y.x)+(x.y-y.y)*(x.y-y.y)+(x.z-y.z)*(x.z-y.z)), 6) AS distance
    FROM bonds b JOIN atoms x ON x.mol_id = b.mol_id AND x.atom_index = b.a JOIN atoms y ON y.mol_id = b.mol_id AND y.atom_index = b.b
    """,
)
def pair_distance(v: Views) -> DataFrame:
    atoms = v.atoms()
    return graph.bond_distances(atoms, v.bonds(atoms)).select(
        "mol_id", "bond_idx", F.round("distance", 6).alias("distance")
    )


@query(
    "prefix_offsets",
    """
    WITH n AS (SELECT mol_id, count(*) AS n_atoms, count(*) FILTER (atomic_num = 1) AS n_targets FROM atoms GROUP BY mol_id),
    o AS (SELECT mol_id, CAST(sum(n_atoms) OVER w - n_atoms AS BIGINT) AS oa, CAST(sum(n_targets) OVER w - n_targets AS BIGINT) AS ot FROM n WINDOW w AS (ORDER BY mol_id))
    SELECT a.mol_id, a.atom_index, a.atom_index + o.oa AS global_atom, CASE WHEN a.atomic_num = 1 THEN a.atom_index + o.ot ELSE -1 END AS global_target
    FROM atoms a JOIN o ON o.mol_id = a.mol_id
    """,
)
def prefix_offsets(v: Views) -> DataFrame:
    atoms = v.atoms()
    sizes = atoms.groupBy("mol_id").agg(
        F.count(F.lit(1)).alias("n_atoms"), F.count_if(F.col("atomic_num") == 1).alias("n_targets")
    )
    offsets = graph.prefix_offsets(sizes, sizes=["n_atoms", "n_targets"])
    target = F.when(F.col("atomic_num") == 1, F.col("atom_index")).otherwise(-1).cast("long")
    return atoms.join(offsets, "mol_id").select(
        "mol_id",
        "atom_index",
        graph.shifted_index(F.col("atom_index").cast("long"), F.col("offset_n_atoms")).alias("global_atom"),
        graph.shifted_index(target, F.col("offset_n_targets")).alias("global_target"),
    )


# --- time -------------------------------------------------------------------------------------------------------


@query(
    "debounce",
    """
    SELECT event_id, user_id, event_type, round(value, 6) AS value
    FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) e
    WHERE nxt IS NULL OR nxt - ts >= INTERVAL 1 HOUR
    """,
)
def debounce(v: Views) -> DataFrame:
    kept = temporal.debounce(v.table("events").drop("props"), delay_ms=3_600_000)
    return kept.select("event_id", "user_id", "event_type", F.round("value", 6).alias("value"))
