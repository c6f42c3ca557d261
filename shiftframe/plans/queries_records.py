"""Registered queries: checks, projections and filters on records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe import constants as C
from shiftframe.functions import text
from shiftframe.operators import normalize, summary, validate
from shiftframe.operators.consensus import consensus, weight_of, weights_used
from shiftframe.plans.registry import query
from shiftframe.plans.views import Views


# --- index checks -----------------------------------------------------------------------------------------------

_INDEXED_SQL = """
    SELECT mol_id, engine, engine_pos, shift_ppm, CASE WHEN mol_id % 4 = 0 THEN atom_index - 2 ELSE atom_index END AS atom_index,
           CASE WHEN atom_index % 5 = 1 THEN atom_index + 1 END AS attached_atom_index, mol_id % 3 + 4 AS n_atoms
    FROM predictions
"""


def _indexed(v: Views) -> DataFrame:
    return v.predictions().select(
        "mol_id",
        "engine",
        "engine_pos",
        "shift_ppm",
        F.when(F.col("mol_id") % 4 == 0, F.col("atom_index") - 2).otherwise(F.col("atom_index")).alias("atom_index"),
        F.when(F.col("atom_index") % 5 == 1, F.col("atom_index") + 1).alias("attached_atom_index"),
        (F.col("mol_id") % 3 + 4).alias("n_atoms"),
    )


@query(
    "index_check_strict",
    f"""
    WITH s AS MATERIALIZED ({_INDEXED_SQL}),
    f AS MATERIALIZED (SELECT DISTINCT mol_id, engine FROM s WHERE atom_index < 0 OR atom_index >= n_atoms
          OR attached_atom_index < 0 OR attached_atom_index >= n_atoms),
    n AS MATERIALIZED (SELECT mol_id, engine, count(*) AS n FROM s GROUP BY ALL)
    SELECT h.mol_id, h.engine, CASE WHEN f.mol_id IS NOT NULL THEN 'error' ELSE h.status END AS status,
           CASE WHEN f.mol_id IS NOT NULL THEN h.engine || ' prediction failed. Reference ID: '
                || substr(sha256(CAST(h.mol_id AS VARCHAR) || '|' || h.engine), 1, 12) END AS message,
           CASE WHEN f.mol_id IS NOT NULL THEN 0 ELSE coalesce(n.n, 0) END AS n_shifts
    FROM engine_results h LEFT JOIN f ON f.mol_id = h.mol_id AND f.engine = h.engine
    LEFT JOIN n ON n.mol_id = h.mol_id AND n.engine = h.engine
    """,
)
def index_check_strict(v: Views) -> DataFrame:
    headers, kept = validate.index_check_strict(v.engine_results(), _indexed(v))
    counts = kept.groupBy("mol_id", "engine").agg(F.count(F.lit(1)).alias("n"))
    return headers.join(counts, ["mol_id", "engine"], "left").select(
        "mol_id", "engine", "status", "message", F.coalesce("n", F.lit(0).cast("long")).alias("n_shifts")
    )


@query(
    "index_check_lenient",
    f"""
    WITH s AS (SELECT *, CASE WHEN mol_id % 10 = 3 THEN atom_index + CAST(0.5 AS DOUBLE) ELSE atom_index END AS ai FROM ({_INDEXED_SQL}) i),
    j AS (SELECT mol_id, ai = floor(ai) AND ai >= 0 AND ai < n_atoms
          AND (attached_atom_index IS NULL OR (attached_atom_index >= 0 AND attached_atom_index < n_atoms)) AS good FROM s)
    SELECT mol_id, count(*) FILTER (good) AS kept, count(*) FILTER (NOT good) AS dropped,
           CASE WHEN count(*) FILTER (NOT good) > 0
                THEN 'Dropped ' || CAST(count(*) FILTER (NOT good) AS VARCHAR) || ' invalid engine assignment(s).' END AS warning
    FROM j GROUP BY mol_id
    """,
)
def index_check_lenient(v: Views) -> DataFrame:
    rows = _indexed(v).withColumn(
        "atom_index",
        F.when(F.col("mol_id") % 10 == 3, F.col("atom_index") + 0.5).otherwise(F.col("atom_index").cast("double")),
    )
    return validate.index_check_lenient(rows)[1]


# --- values, payloads, strings ----------------------------------------------------------------------------------


@query(
    "drop_unusable",
    """
    SELECT mol_id, atom_index, engine, round(v, 6) AS shift_ppm
    FROM (SELECT *, CASE WHEN atom_index = 5 THEN NULL ELSE shift_ppm - 20 END AS v FROM predictions) p WHERE v >= 0
    """,
)
def drop_unusable(v: Views) -> DataFrame:
    rows = v.predictions().withColumn(
        "shift_ppm", F.when(F.col("atom_index") != 5, F.col("shift_ppm") - 20)
    )
    return validate.drop_unusable(rows).select("mol_id", "atom_index", "engine", F.round("shift_ppm", 6).alias("shift_ppm"))


@query(
    "payload_pick",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice,
           CASE l_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN l_extendedprice WHEN 2 THEN l_tax ELSE NULL END AS picked
    FROM lineitem
    """,
)
def payload_pick(v: Views) -> DataFrame:
    """Payload sizes 0 to 3; in the longest the second element is null."""
    kind = F.col("l_partkey") % 4
    payload = (
        F.when(kind == 0, F.array().cast("array<double>"))
        .when(kind == 1, F.array("l_extendedprice"))
        .when(kind == 2, F.array("l_discount", "l_tax"))
        .otherwise(F.array(F.col("l_discount"), F.lit(None).cast("double"), F.col("l_tax")))
    )
    return v.table("lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        "l_extendedprice",
        validate.payload_pick(payload).alias("picked"),
    )


@query(
    "string_gate",
    """
    SELECT id, trim(t, ' ' || chr(9) || chr(10) || chr(13)) AS core,
           CASE WHEN length(trim(t, ' ' || chr(9) || chr(10) || chr(13))) = 0 THEN 'SMILES is empty'
                WHEN length(trim(t, ' ' || chr(9) || chr(10) || chr(13))) > 256 THEN 'SMILES is too long (max 256 characters)' END AS reason
    FROM (SELECT id, CASE WHEN id % 17 = 0 THEN repeat(s, 30) ELSE s || chr(10) END AS t FROM raw_strings) r
    """,
)
def string_gate(v: Views) -> DataFrame:
    rows = v.raw_strings().select(
        "id", F.when(F.col("id") % 17 == 0, F.repeat("s", 30)).otherwise(F.concat("s", F.lit("\n"))).alias("s")
    )
    return validate.gate_strings(rows).drop("s")


@query(
    "string_lint",
    r"""
    WITH c AS (SELECT id, s, trim(s) AS core, regexp_replace(s, '[^()]', '', 'g') AS par FROM raw_strings),
    d AS (SELECT id, core, list_transform(range(1, length(par) + 1), lambda n:
                 length(replace(substr(par, 1, n), ')', '')) - length(replace(substr(par, 1, n), '(', ''))) AS depths FROM c)
    SELECT id, CASE WHEN core = '' THEN 'SMILES is empty'
                    WHEN NOT regexp_full_match(core, '[A-Za-z0-9@+\-\[\]\(\)=#$\/\\.%:*]+') THEN 'Invalid characters in SMILES'
                    WHEN len(depths) > 0 AND (list_min(depths) < 0 OR depths[-1] <> 0) THEN 'Unbalanced parentheses' END AS reason
    FROM d
    """,
)
def string_lint(v: Views) -> DataFrame:
    return v.raw_strings().select("id", text.string_lint(F.col("s")).alias("reason"))


@query(
    "token_estimate",
    r"""
    WITH p AS (SELECT id, regexp_replace(s, '\[[^\]]*\]', 'X', 'g') AS t FROM raw_strings),
    c AS (SELECT id, len(regexp_extract_all(t, '[CNOFPScnofps]')) AS h, len(regexp_extract_all(t, '[Cc]')) AS c,
                 len(regexp_extract_all(t, '[Nn]')) AS n, len(regexp_extract_all(t, 'F')) AS f, len(regexp_extract_all(t, 'P')) AS p FROM p)
    SELECT id, nucleus, CAST(CASE nucleus WHEN '1H' THEN greatest(2, least(40, floor(h * 1.5 + 0.5)))
        WHEN '13C' THEN greatest(1, least(40, c)) WHEN '15N' THEN greatest(1, n) WHEN '19F' THEN greatest(1, f)
        WHEN '31P' THEN greatest(1, p) ELSE 5 END AS BIGINT) AS estimate
    FROM c CROSS JOIN (VALUES ('1H'), ('13C'), ('15N'), ('19F'), ('31P'), ('2H')) AS k(nucleus)
    """,
)
def token_estimate(v: Views) -> DataFrame:
    nuclei = F.array(*[F.lit(n) for n in ("1H", "13C", "15N", "19F", "31P", "2H")])
    return v.raw_strings().select("id", "s", F.explode(nuclei).alias("nucleus")).select(
        "id", "nucleus", text.token_estimate(F.col("s"), F.col("nucleus")).alias("estimate")
    )


@query(
    "size_gate",
    """
    SELECT mol_id, n_heavy, n_atoms,
           CASE WHEN n_heavy > 4 THEN 'Molecule is too large (' || n_heavy || ' heavy atoms; max 4)'
                WHEN n_atoms > 6 THEN 'Molecule is too large after adding hydrogens (' || n_atoms || ' atoms; max 6)' END AS reason
    FROM (SELECT mol_id, count(*) FILTER (atomic_num > 1) AS n_heavy, count(*) AS n_atoms FROM atoms GROUP BY mol_id) t
    """,
)
def size_gate(v: Views) -> DataFrame:
    """Limits lowered to 4 and 6 so that the small molecules of the tables reach them."""
    return validate.size_gate(v.atoms(), max_heavy=4, max_atoms=6)


# --- requests ---------------------------------------------------------------------------------------------------

_REQUEST_CASES = (
    ('{"smiles": "CCO"}', None),
    ('{"smiles": "CCO", "engines": ["cdk", "orca"], "mode": "consensus", "weights": {"cdk": 0.2, "orca": 0}}', None),
    ('{"smiles": "", "engines": []}', "smiles; engines"),
    ('{"smiles": "C", "engines": ["cdk", "other"]}', "engines"),
    ('{"smiles": "C", "mode": "both", "nucleus": "15N"}', "mode; nucleus"),
    ('{"smiles": "C", "conformer_strategy": "slow"}', "conformer_strategy"),
    ('{"smiles": "C", "weights": {"cdk": -1}}', "weights"),
    ('{"smiles": "C", "weights": {"other": 1}}', "weights"),
    ('{"smiles": "C", "solvent": "D2O"}', "unknown: solvent"),
    ('{"smiles": "C", ', "malformed"),
    ('{"smiles": "C", "weights": null, "nucleus": "13C"}', None),
    ('{"smiles": "C", "engines": ["cdk", "cascade", "orca", "cdk"]}', "engines"),
)


def _requests(v: Views) -> DataFrame:
    which = F.col("o_orderkey") % len(_REQUEST_CASES)
    payload = F.lit(None).cast("string")
    for i, (case, _) in enumerate(_REQUEST_CASES):
        payload = F.when(which == i, case).otherwise(payload)
    label = F.concat(F.lit('"smiles": "'), F.repeat(F.lit("C"), (F.col("o_custkey") % 3).cast("int")))
    return v.table("orders").select(
        F.col("o_orderkey").alias("request_id"), F.replace(payload, F.lit('"smiles": "'), label).alias("payload")
    )


_REQUEST_REASON_SQL = " ".join(
    f"WHEN {i} THEN " + ("NULL" if reason is None else f"'{reason}'") for i, (_, reason) in enumerate(_REQUEST_CASES)
)


@query(
    "request_gate",
    f"""
    SELECT o_orderkey AS request_id, reason IS NULL AS accepted, reason
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 12 = 2 AND o_custkey % 3 > 0 THEN 'engines'
                 ELSE CASE o_orderkey % {len(_REQUEST_CASES)} {_REQUEST_REASON_SQL} END END AS reason FROM orders) o
    """,
)
def request_gate(v: Views) -> DataFrame:
    accepted, quarantined = validate.request_gate(_requests(v))
    return (
        accepted.select("request_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"))
        .unionByName(quarantined.select("request_id", F.lit(False).alias("accepted"), "reason"))
    )


# --- projections and filters ------------------------------------------------------------------------------------


@query(
    "target_atoms",
    """
    SELECT mol_id, atom_index, symbol, CASE WHEN mol_id % 2 = 0 THEN '1H' ELSE '13C' END AS nucleus
    FROM atoms WHERE atomic_num = CASE WHEN mol_id % 2 = 0 THEN 1 ELSE 6 END
    """,
)
def target_atoms(v: Views) -> DataFrame:
    from shiftframe.operators.graph import target_atoms as keep

    atoms = v.atoms().withColumn("nucleus", F.when(F.col("mol_id") % 2 == 0, "1H").otherwise("13C"))
    return keep(atoms).select("mol_id", "atom_index", "symbol", "nucleus")


@query(
    "shift_projection",
    """
    SELECT mol_id, atom_index, assignment_group, multiplicity, coupling_hz, 'H' AS element,
           round(shift_ppm, 6) AS shift, round(coalesce(coupling_hz / 10, 1), 6) AS intensity FROM protons
    """,
)
def shift_projection(v: Views) -> DataFrame:
    rows = v.protons().withColumn("symbol", F.lit("H")).withColumn("confidence", F.col("coupling_hz") / 10)
    return (
        normalize.shift_projection(rows)
        .withColumn("shift", F.round("shift", 6))
        .withColumn("intensity", F.round("intensity", 6))
    )


@query(
    "engine_filter",
    "SELECT mol_id, atom_index, engine, round(shift_ppm, 6) AS shift_ppm FROM predictions WHERE engine IN ('cdk', 'orca')",
)
def engine_filter(v: Views) -> DataFrame:
    return normalize.engine_filter(v.predictions(), ["cdk", "orca"]).select(
        "mol_id", "atom_index", "engine", F.round("shift_ppm", 6).alias("shift_ppm")
    )


@query(
    "source_filter",
    "SELECT mol_id, pos, round(center, 6) AS center FROM signals_1h WHERE mol_id % 3 = 1",
)
def source_filter(v: Views) -> DataFrame:
    tagged = v.signals_1h().withColumn("source_id", F.concat(F.lit("source "), (F.col("mol_id") % 3).cast("string")))
    return normalize.source_filter(tagged, "source 1").select("mol_id", "pos", F.round("center", 6).alias("center"))


_TARGET_SQL = """
    SELECT mol_id, pos, CASE WHEN mol_id % 3 = 0 THEN [pos % 4] ELSE list_sort(list_distinct([pos, pos % 3, 2])) END AS target
    FROM signals_1h
"""


def _targets(v: Views) -> DataFrame:
    anchor = F.when(F.col("mol_id") % 3 == 0, F.col("pos") % 4)
    atoms = F.array(F.col("pos"), F.col("pos") % 3, F.lit(2))
    return v.signals_1h().select("mol_id", "pos", normalize.selection_target("1H", atoms, anchor).alias("target"))


@query("selection_target", f"SELECT mol_id, pos, array_to_string(target, ',') AS target FROM ({_TARGET_SQL}) t")
def selection_target(v: Views) -> DataFrame:
    return _targets(v).withColumn("target", F.array_join(F.col("target").cast("array<string>"), ","))


@query(
    "atom_lookup",
    f"""
    SELECT t.mol_id, t.pos, w.atom_index FROM ({_TARGET_SQL}) t
    JOIN (SELECT DISTINCT l_orderkey AS mol_id, l_linenumber AS atom_index FROM lineitem) w
      ON w.mol_id = t.mol_id AND list_contains(t.target, w.atom_index)
    """,
)
def atom_lookup(v: Views) -> DataFrame:
    wanted = v.table("lineitem").select(F.col("l_orderkey").alias("mol_id"), F.col("l_linenumber").alias("atom_index"))
    return normalize.atom_lookup(_targets(v), wanted).select("mol_id", "pos", "atom_index")


_MODE_SQL = "CASE WHEN mol_id % 2 = 0 THEN 'consensus' ELSE 'individual' END"


def _mode(df: DataFrame) -> DataFrame:
    return df.withColumn("mode", F.when(F.col("mol_id") % 2 == 0, "consensus").otherwise("individual"))


@query(
    "mode_select",
    f"""
    SELECT mol_id, atom_index, engine, round(shift_ppm, 6) AS shift_ppm, CAST(NULL AS DOUBLE) AS std_ppm
    FROM predictions WHERE {_MODE_SQL} = 'individual'
    UNION ALL
    SELECT mol_id, atom_index, NULL, round(sum(w * shift_ppm) / sum(w), 6),
           round(CASE WHEN count(*) > 1 THEN stddev_pop(shift_ppm) END, 6)
    FROM (SELECT *, CAST(CASE engine WHEN 'cdk' THEN 0.5 WHEN 'cascade' THEN 0.3 ELSE 0.2 END AS DOUBLE) AS w
          FROM predictions WHERE status = 'ok' AND {_MODE_SQL} = 'consensus') p
    GROUP BY mol_id, atom_index
    """,
)
def mode_select(v: Views) -> DataFrame:
    rows = v.predictions()
    requests = _mode(v.table("lineitem").select(F.col("l_orderkey").alias("mol_id")).distinct())
    chosen = normalize.mode_select(
        rows.select("mol_id", "atom_index", "engine", "shift_ppm"),
        consensus(rows).select("mol_id", "atom_index", "shift_ppm", "std_ppm"),
        requests,
    )
    return chosen.withColumn("shift_ppm", F.round("shift_ppm", 6)).withColumn("std_ppm", F.round("std_ppm", 6))


# --- response level ---------------------------------------------------------------------------------------------


@query(
    "warnings",
    f"""
    WITH d AS (SELECT mol_id, count(*) FILTER (atom_index < 0 OR atom_index >= n_atoms OR attached_atom_index < 0
                                               OR attached_atom_index >= n_atoms) AS n FROM ({_INDEXED_SQL}) s GROUP BY mol_id),
    w AS (SELECT mol_id, engine_pos AS p, engine || ': ' || CASE WHEN status = 'error' THEN 'no ' || engine ELSE 'status ' || status END AS t
          FROM engine_results WHERE status <> 'ok'
          UNION ALL SELECT mol_id, 99, 'Dropped ' || n || ' invalid engine assignment(s).' FROM d WHERE n > 0)
    SELECT m.mol_id, coalesce(string_agg(w.t, ' | ' ORDER BY w.p), '') AS warnings
    FROM (SELECT DISTINCT mol_id FROM engine_results) m LEFT JOIN w ON w.mol_id = m.mol_id GROUP BY m.mol_id
    """,
)
def warnings(v: Views) -> DataFrame:
    headers = v.engine_results().withColumn(
        "message", F.when(F.col("status") == "error", F.concat(F.lit("no "), F.col("engine")))
    )
    listed = normalize.warnings(headers, validate.index_check_lenient(_indexed(v))[1])
    return listed.select("mol_id", F.array_join("warnings", " | ").alias("warnings"))


@query(
    "engines_used",
    f"""
    SELECT mol_id, CASE WHEN {_MODE_SQL} = 'individual' THEN 'cdk,cascade,orca'
           ELSE coalesce(string_agg(engine, ',' ORDER BY engine_pos) FILTER (status = 'ok'), 'cdk,cascade,orca') END AS engines_used
    FROM engine_results GROUP BY mol_id
    """,
)
def engines_used(v: Views) -> DataFrame:
    headers = v.engine_results().withColumn("weight", weight_of(F.col("engine"), C.DEFAULT_WEIGHTS))
    requests = _mode(v.table("lineitem").select(F.col("l_orderkey").alias("mol_id")).distinct()).withColumn(
        "engines", F.array(*[F.lit(e) for e in C.DEFAULT_WEIGHTS])
    )
    used = normalize.engines_used(requests, weights_used(headers))
    return used.select("mol_id", F.array_join("engines_used", ",").alias("engines_used"))


@query(
    "distinct_ordered",
    "SELECT user_id, event_type, min(event_id) AS first_pos FROM events GROUP BY user_id, event_type",
)
def distinct_ordered(v: Views) -> DataFrame:
    return normalize.distinct_ordered(v.table("events"), "event_type", "event_id", keys=["user_id"])


_COMPONENT_SQL = """
    SELECT DISTINCT mol_id // 4 AS mix_id, mol_id AS component_id, mol_id % 4 AS component_pos,
           'Component ' || (mol_id % 4 + 1) AS label, 'm' || mol_id AS smiles,
           CASE WHEN mol_id % 5 = 0 THEN '13C' ELSE '1H' END AS nucleus, CASE WHEN mol_id % 7 = 0 THEN 'consensus' ELSE 'individual' END AS mode
    FROM engine_results
"""
_ADMITTED_SQL = f"""
    SELECT c.* FROM ({_COMPONENT_SQL}) c
    JOIN (SELECT mix_id, nucleus, mode FROM (SELECT *, row_number() OVER (PARTITION BY mix_id ORDER BY component_pos) AS rn
          FROM ({_COMPONENT_SQL}) c1) x WHERE rn = 1) lead_row
      ON lead_row.mix_id = c.mix_id AND lead_row.nucleus = c.nucleus AND lead_row.mode = c.mode
"""


def _components(v: Views) -> DataFrame:
    mol = F.col("component_id")
    return v.table("lineitem").select(F.col("l_orderkey").alias("component_id")).distinct().select(
        F.floor(mol / 4).alias("mix_id"),
        mol,
        (mol % 4).alias("component_pos"),
        F.concat(F.lit("Component "), (mol % 4 + 1).cast("string")).alias("label"),
        F.concat(F.lit("m"), mol.cast("string")).alias("smiles"),
        F.when(mol % 5 == 0, "13C").otherwise("1H").alias("nucleus"),
        F.when(mol % 7 == 0, "consensus").otherwise("individual").alias("mode"),
    )


@query(
    "mix",
    f"""
    SELECT a.mix_id, p.atom_index, p.engine, round(p.shift_ppm, 6) AS shift_ppm, CAST(a.component_id AS VARCHAR) AS source_id,
           a.label AS source_label, a.smiles AS source_smiles
    FROM ({_ADMITTED_SQL}) a JOIN predictions p ON p.mol_id = a.component_id
    """,
)
def mix(v: Views) -> DataFrame:
    rows = v.predictions().select(
        F.col("mol_id").alias("component_id"), "atom_index", "engine", F.round("shift_ppm", 6).alias("shift_ppm")
    )
    return normalize.mix(rows, _components(v))


@query(
    "mix_warnings",
    f"""
    WITH a AS ({_ADMITTED_SQL}), n AS (SELECT mix_id, count(*) AS n FROM a GROUP BY mix_id)
    SELECT a.mix_id, a.component_pos, CAST(k.k AS INTEGER) AS warning_pos,
           CASE WHEN n.n > 1 THEN a.label || ': ' ELSE '' END || CASE k.k WHEN 0 THEN 'first' ELSE 'second' END AS warning
    FROM a JOIN n ON n.mix_id = a.mix_id CROSS JOIN (VALUES (0), (1)) AS k(k) WHERE k.k < a.component_id % 3
    """,
)
def mix_warnings(v: Views) -> DataFrame:
    texts = F.slice(F.array(F.lit("first"), F.lit("second")), F.lit(1), (F.col("component_id") % 3).cast("int"))
    return normalize.mix_warnings(_components(v).withColumn("warnings", texts))


# --- rosters and summaries --------------------------------------------------------------------------------------


@query(
    "roster_join",
    """
    SELECT mol_id, engine, CASE WHEN engine <> 'cdk' THEN 'pending' END AS status,
           CASE WHEN engine <> 'cdk' THEN engine || ' engine not yet wired up.' END AS message
    FROM engine_results
    """,
)
def roster_join(v: Views) -> DataFrame:
    roster = v.spark.sql("SELECT * FROM VALUES ('cdk', true), ('cascade', false) AS r(engine, implemented)")
    return summary.roster_join(v.engine_results().select("mol_id", "engine"), roster)


@query(
    "first_ready",
    "SELECT s_name AS engine, s_acctbal > 0 AS ready FROM supplier WHERE s_acctbal > 0 ORDER BY s_name LIMIT 2",
)
def first_ready(v: Views) -> DataFrame:
    roster = v.table("supplier").select(F.col("s_name").alias("engine"), (F.col("s_acctbal") > 0).alias("ready"))
    return summary.first_ready(roster)


@query(
    "engine_summary",
    """
    WITH s AS (SELECT mol_id % 100 AS grp, integration, CASE pos % 3 WHEN 0 THEN 'cdk' WHEN 1 THEN 'cascade' ELSE 'orca' END AS engine FROM signals_1h)
    SELECT grp, engine, count(*) AS n_signals, CAST(sum(integration) AS BIGINT) AS protons, 0 AS is_total FROM s GROUP BY grp, engine
    UNION ALL SELECT grp, NULL, count(*), CAST(sum(integration) AS BIGINT), 1 FROM s GROUP BY grp
    """,
)
def engine_summary(v: Views) -> DataFrame:
    kind = F.col("pos") % 3
    rows = v.signals_1h().select(
        (F.col("mol_id") % 100).alias("grp"),
        "integration",
        F.when(kind == 0, "cdk").when(kind == 1, "cascade").otherwise("orca").alias("engine"),
    )
    return summary.engine_summary(rows, keys=["grp"])
