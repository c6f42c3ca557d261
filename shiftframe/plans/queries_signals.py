"""Registered queries: signals, spectra and peak matching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe import constants as C
from shiftframe.functions import text
from shiftframe.functions.once import once
from shiftframe.operators import graph, match, signals, spectra
from shiftframe.plans.registry import query
from shiftframe.plans.views import Views

# Greedy clusters by recursion over the place in the walk, all groups at once.
_WALK_SQL = """
    base AS (SELECT mol_id, 'default:engine:' || assignment_group AS base_key, atom_index, shift_ppm AS v, multiplicity, coupling_hz,
                    row_number() OVER (PARTITION BY mol_id, assignment_group ORDER BY shift_ppm DESC, atom_index) AS rn FROM protons),
    walk AS (
        SELECT mol_id, base_key, atom_index, v, multiplicity, coupling_hz, rn, 0 AS signal_no, 1 AS n, v AS center FROM base WHERE rn = 1
        UNION ALL
        SELECT b.mol_id, b.base_key, b.atom_index, b.v, b.multiplicity, b.coupling_hz, b.rn,
               CASE WHEN abs(w.center - b.v) <= CAST(0.14 AS DOUBLE) THEN w.signal_no ELSE w.signal_no + 1 END,
               CASE WHEN abs(w.center - b.v) <= CAST(0.14 AS DOUBLE) THEN w.n + 1 ELSE 1 END,
               CASE WHEN abs(w.center - b.v) <= CAST(0.14 AS DOUBLE) THEN (w.center * w.n + b.v) / (w.n + 1) ELSE b.v END
        FROM walk w JOIN base b ON b.mol_id = w.mol_id AND b.base_key = w.base_key AND b.rn = w.rn + 1)
"""
_STATS_SQL = """
    lab AS (SELECT mol_id, base_key, signal_no, multiplicity, count(*) AS c, min(rn) AS f FROM walk GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY mol_id, base_key, signal_no ORDER BY c DESC, f) AS k FROM lab),
    sig AS (SELECT w.mol_id, w.base_key, w.signal_no, max_by(w.center, w.rn) AS center, count(DISTINCT w.atom_index) AS integration,
                   min_by(w.atom_index, w.rn) AS rep, avg(w.coupling_hz) AS coupling_hz,
                   avg(CASE WHEN (w.mol_id + w.atom_index) % 5 <> 0 THEN CAST(w.atom_index % 4 AS DOUBLE) END) AS neighbor_count,
                   avg(CAST((w.mol_id + w.atom_index) % 7 AS DOUBLE) / 100) AS std, min_by('src' || (w.atom_index % 3), w.rn) AS source_label,
                   CASE WHEN w.mol_id % 3 = 0 THEN CAST(w.mol_id % 7 AS INTEGER) END AS anchor
            FROM walk w GROUP BY w.mol_id, w.base_key, w.signal_no),
    stats AS (SELECT s.*, b.multiplicity FROM sig s JOIN best b ON b.mol_id = s.mol_id AND b.base_key = s.base_key AND b.signal_no = s.signal_no AND b.k = 1)
"""


def _members(v: Views, *, dealt: bool = False) -> DataFrame:
    mol, atom = F.col("mol_id"), F.col("atom_index")
    rows = v.protons().withColumnRenamed("shift_ppm", "shift").withColumns(
        {
            "attached_atom_index": F.when(mol % 3 == 0, mol % 7),
            "element": F.lit("H"),
            "neighbor_count": F.when((mol + atom) % 5 != 0, (atom % 4).cast("double")),
            "std": ((mol + atom) % 7).cast("double") / 100,
            "source_label": F.concat(F.lit("src"), (atom % 3).cast("string")),
        }
    )
    return signals.signal_group(rows, nucleus="1H", dealt=dealt)


def _stats(v: Views) -> DataFrame:
    return signals.signal_stats(_members(v, dealt=True), nucleus="1H")


@query(
    "signal_group",
    f"WITH RECURSIVE {_WALK_SQL} SELECT mol_id, base_key, signal_no, atom_index, CAST(rn - 1 AS BIGINT) AS walk_pos, round(center, 6) AS center_after FROM walk",
)
def signal_group(v: Views) -> DataFrame:
    return _members(v).select(
        "mol_id", "base_key", "signal_no", "atom_index", "walk_pos", F.round("center_after", 6).alias("center_after")
    )


@query(
    "signal_stats",
    f"""
    WITH RECURSIVE {_WALK_SQL}, {_STATS_SQL}
    SELECT mol_id, base_key || ':' || signal_no AS signal_id, round(center, 6) AS center, integration, multiplicity,
           round(coupling_hz, 6) AS coupling_hz, round(neighbor_count, 6) AS neighbor_count, round(std, 6) AS std,
           rep AS representative_atom_index, anchor AS attached_atom_index, 'H' AS element, source_label FROM stats
    """,
)
def signal_stats(v: Views) -> DataFrame:
    return _stats(v).select(
        "mol_id",
        "signal_id",
        F.round("center", 6).alias("center"),
        "integration",
        "multiplicity",
        F.round("coupling_hz", 6).alias("coupling_hz"),
        F.round("neighbor_count", 6).alias("neighbor_count"),
        F.round("std", 6).alias("std"),
        "representative_atom_index",
        "attached_atom_index",
        "element",
        "source_label",
    )


@query(
    "signal_atoms",
    f"""
    WITH RECURSIVE {_WALK_SQL} SELECT DISTINCT mol_id, base_key || ':' || signal_no AS signal_id, atom_index FROM walk
    """,
)
def signal_atoms(v: Views) -> DataFrame:
    return signals.signal_atoms(_members(v))


@query(
    "signals_per_nucleus",
    f"""
    WITH RECURSIVE {_WALK_SQL}, {_STATS_SQL}
    SELECT mol_id, '1H' AS nucleus, base_key || ':' || signal_no AS signal_id, round(center, 6) AS center, integration FROM stats WHERE mol_id % 3 = 0
    UNION ALL SELECT mol_id, CASE mol_id % 3 WHEN 1 THEN '31P' ELSE '77Se' END, 'default:engine:' || assignment_group || ':0', round(avg(shift_ppm), 6), NULL
    FROM protons WHERE mol_id % 3 <> 0 GROUP BY mol_id, assignment_group
    """,
)
def signals_per_nucleus(v: Views) -> DataFrame:
    """Every row names its nucleus; one of them is not listed and has the defaults of all others."""
    kind = F.col("mol_id") % 3
    rows = v.protons().withColumnRenamed("shift_ppm", "shift").withColumn(
        "nucleus", F.when(kind == 0, "1H").when(kind == 1, "31P").otherwise("77Se")
    )
    members = signals.signal_group(rows, nucleus=F.col("nucleus"), scope=["nucleus", "mol_id"], dealt=True)
    stats = signals.signal_stats(members, nucleus=F.col("nucleus"), scope=["nucleus", "mol_id"])
    return stats.select("mol_id", "nucleus", "signal_id", F.round("center", 6).alias("center"), "integration")


@query(
    "majority_label",
    """
    SELECT mol_id, assignment_group, multiplicity FROM (
        SELECT *, row_number() OVER (PARTITION BY mol_id, assignment_group ORDER BY c DESC, f) AS k FROM (
            SELECT mol_id, assignment_group, multiplicity, count(*) AS c, min(atom_index) AS f FROM protons GROUP BY ALL) l) r WHERE k = 1
    """,
)
def majority_label(v: Views) -> DataFrame:
    return signals.majority_label(v.protons(), keys=["mol_id", "assignment_group"], position="atom_index")


@query("sort_signals", "SELECT mol_id, pos, round(center, 6) AS center FROM signals_1h")
def sort_signals(v: Views) -> DataFrame:
    ordered = signals.sort_signals(v.signals_1h(), ties=["mol_id", "pos"])
    return ordered.select("mol_id", "pos", F.round("center", 6).alias("center"))


@query(
    "islands",
    """
    SELECT mol_id, assignment_group, CAST(min(v) AS BIGINT) AS first, CAST(max(v) AS BIGINT) AS last
    FROM (SELECT *, v - row_number() OVER (PARTITION BY mol_id, assignment_group ORDER BY v) AS g
          FROM (SELECT DISTINCT mol_id, assignment_group, atom_index + mol_id % 5000 AS v FROM protons) d) t
    GROUP BY mol_id, assignment_group, g
    """,
)
def islands(v: Views) -> DataFrame:
    rows = v.protons().withColumn("v", F.col("atom_index") + F.col("mol_id") % 5000)
    return signals.islands(rows, keys=["mol_id", "assignment_group"], value="v")


@query(
    "splitting_text",
    """
    WITH k AS (SELECT *, CASE WHEN atom_index % 4 = 3 THEN NULL ELSE atom_index * CAST(0.5 AS DOUBLE) END AS n, coupling_hz * (1 + atom_index) / 3 AS j FROM protons),
    p AS (SELECT *, CASE WHEN n > 0 THEN CAST(CAST(floor(n + 0.5) AS BIGINT) AS VARCHAR) || CASE WHEN floor(n + 0.5) = 1 THEN ' neighbor' ELSE ' neighbors' END
                              || ' (n+1 = ' || CAST(CAST(floor(n + 0.5) AS BIGINT) + 1 AS VARCHAR) || ' lines)'
                         WHEN multiplicity = 's' THEN 'no 1H neighbors' END AS a,
                 CASE WHEN j IS NOT NULL THEN printf('J ≈ %.1f Hz', j) WHEN multiplicity = 'm' THEN 'complex pattern (unresolved)' END AS b FROM k)
    SELECT mol_id, atom_index, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN
        CASE multiplicity WHEN 's' THEN 'singlet' WHEN 'd' THEN 'doublet' WHEN 't' THEN 'triplet' WHEN 'm' THEN 'multiplet' END || ': ' || concat_ws(' · ', a, b) END AS splitting
    FROM p
    """,
)
def splitting_text(v: Views) -> DataFrame:
    n = F.when(F.col("atom_index") % 4 != 3, F.col("atom_index") * 0.5)
    j = F.col("coupling_hz") * (F.col("atom_index") + 1) / 3
    return v.protons().select("mol_id", "atom_index", text.splitting_text(F.col("multiplicity"), n, j).alias("splitting"))


@query(
    "assignment_text",
    f"""
    WITH RECURSIVE {_WALK_SQL}, {_STATS_SQL},
    runs AS (SELECT mol_id, base_key, signal_no, min(atom_index) AS a, max(atom_index) AS b FROM (
                 SELECT *, atom_index - row_number() OVER (PARTITION BY mol_id, base_key, signal_no ORDER BY atom_index) AS g FROM walk) t
             GROUP BY mol_id, base_key, signal_no, g),
    txt AS (SELECT mol_id, base_key, signal_no, string_agg(CASE WHEN a = b THEN 'H' || a ELSE 'H' || a || '-H' || b END, ', ' ORDER BY a) AS t FROM runs GROUP BY ALL)
    SELECT s.mol_id, s.base_key || ':' || s.signal_no AS signal_id, t.t || CASE WHEN anchor IS NOT NULL THEN ' on atom #' || anchor ELSE '' END AS assignment_text
    FROM stats s JOIN txt t ON t.mol_id = s.mol_id AND t.base_key = s.base_key AND t.signal_no = s.signal_no
    """,
)
def assignment_text(v: Views) -> DataFrame:
    members = _members(v, dealt=True)
    stats = signals.signal_stats(members, nucleus="1H", with_atoms=True)
    return signals.assignment_text(stats, members, nucleus="1H").select("mol_id", "signal_id", "assignment_text")


_LINES_SQL = """
    pat AS (SELECT * FROM (VALUES ('s', 0, 1.0, 1, 1), ('d', 0, 1.0, 2, 1), ('d', 1, 1.0, 2, 1), ('t', 0, 1.0, 3, 2), ('t', 1, 2.0, 3, 2), ('t', 2, 1.0, 3, 2),
            ('m', 0, 1.0, 5, 3), ('m', 1, 2.0, 5, 3), ('m', 2, 3.0, 5, 3), ('m', 3, 2.0, 5, 3), ('m', 4, 1.0, 5, 3)) AS p(label, line_no, h, n, top)),
    lines AS (SELECT s.mol_id, s.base_key || ':' || s.signal_no AS signal_id, CAST(p.line_no AS INTEGER) AS line_no, s.center,
              s.center + (p.line_no - (p.n - 1) / CAST(2 AS DOUBLE)) * coalesce(s.coupling_hz, 7) / 400 AS shift,
              (0.8 + least(0.45, (s.integration - 1) * CAST(0.12 AS DOUBLE))) * CAST(p.h AS DOUBLE) / p.top AS intensity
              FROM stats s JOIN pat p ON p.label = s.multiplicity)
"""


@query(
    "multiplet_lines",
    f"""
    WITH RECURSIVE {_WALK_SQL}, {_STATS_SQL}, {_LINES_SQL}
    SELECT mol_id, signal_id, line_no, round(shift, 6) AS shift, round(intensity, 6) AS intensity FROM lines
    """,
)
def multiplet_lines(v: Views) -> DataFrame:
    rows = signals.line_rows(signals.add_lines(_stats(v), nucleus="1H"), keep=["mol_id", "signal_id"])
    return rows.withColumn("shift", F.round("shift", 6)).withColumn("intensity", F.round("intensity", 6))


@query(
    "highlight_range",
    f"""
    WITH RECURSIVE {_WALK_SQL}, {_STATS_SQL}, {_LINES_SQL}
    SELECT mol_id, signal_id, round(min(shift) - CAST(0.018 AS DOUBLE), 6) AS low, round(max(shift) + CAST(0.018 AS DOUBLE), 6) AS high
    FROM lines GROUP BY mol_id, signal_id
    """,
)
def highlight_range(v: Views) -> DataFrame:
    rows = signals.add_lines(_stats(v), nucleus="1H")
    low, high = signals.highlight_range("1H", F.col("lines.shift"), F.col("center"))
    return rows.select("mol_id", "signal_id", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(
    "integral_curve",
    """
    WITH s AS (SELECT *, sum(integration) OVER (PARTITION BY mol_id ORDER BY pos) AS c, sum(integration) OVER (PARTITION BY mol_id) AS t FROM signals_1h),
    k AS (SELECT mol_id, (pos - 1) * 4 AS b, center, (c - integration) / CAST(t AS DOUBLE) * 0.28 + 0.08 AS y0, c / CAST(t AS DOUBLE) * 0.28 + 0.08 AS y1 FROM s)
    SELECT mol_id, CAST(b + 1 AS BIGINT) AS seq, round(least(CAST(8 AS DOUBLE), center + 0.14), 6) AS x, round(y0, 6) AS y FROM k
    UNION ALL SELECT mol_id, b + 2, round(center, 6), round(y0, 6) FROM k
    UNION ALL SELECT mol_id, b + 3, round(center, 6), round(y1, 6) FROM k
    UNION ALL SELECT mol_id, b + 4, round(greatest(CAST(0.5 AS DOUBLE), center - 0.14), 6), round(y1, 6) FROM k
    UNION ALL SELECT DISTINCT mol_id, 0, CAST(8 AS DOUBLE), CAST(0.08 AS DOUBLE) FROM s
    UNION ALL SELECT mol_id, count(*) * 4 + 1, CAST(0.5 AS DOUBLE), CAST(0.36 AS DOUBLE) FROM s GROUP BY mol_id
    """,
)
def integral_curve(v: Views) -> DataFrame:
    curve = signals.integral_curve(v.signals_1h(), low=0.5, high=8.0)
    return curve.select("mol_id", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# --- spectra: one spectrum per supplier, one line per row --------------------------------------------------------

SPEC_NUCLEUS = "11B"  # has the defaults of an unlisted nucleus, whose grid a second engine can also draw
_POINTS = C.OTHER_SPECTRUM_POINTS
_SPEC_LINES_SQL = """
    SELECT l_suppkey AS spec_id, l_extendedprice % CAST(9 AS DOUBLE) AS shift, CAST(1 + l_linenumber % 3 AS DOUBLE) AS intensity,
           CAST(0.12 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), l_discount * CAST(0.35 AS DOUBLE)) AS width FROM lineitem
"""
_SPECS_SQL = "SELECT s_suppkey AS spec_id FROM supplier UNION ALL SELECT -s_suppkey FROM supplier WHERE s_suppkey % 10 = 7"
_DOMAIN_SQL = f"""
    SELECT s.spec_id, CASE WHEN d.lo IS NULL THEN 0 ELSE least(CAST(200 AS DOUBLE), greatest(CAST(0 AS DOUBLE), d.lo - 8)) END AS low,
           CASE WHEN d.hi IS NULL THEN 200 ELSE least(CAST(200 AS DOUBLE), greatest(CAST(0 AS DOUBLE), d.hi + 8)) END AS high
    FROM ({_SPECS_SQL}) s LEFT JOIN (SELECT spec_id, min(shift) AS lo, max(shift) AS hi FROM ({_SPEC_LINES_SQL}) x GROUP BY spec_id) d ON d.spec_id = s.spec_id
"""
_AXIS_SQL = f"SELECT spec_id, CAST(i AS INTEGER) AS i, low + i * ((high - low) / {_POINTS - 1}) AS x FROM ({_DOMAIN_SQL}) dom CROSS JOIN range({_POINTS}) AS r(i)"


def spectrum_lines(v: Views) -> DataFrame:
    """Every line of lineitem, and for every tenth order one without a place, which counts for nothing."""
    order = F.col("l_orderkey")
    places = F.array((F.col("l_extendedprice") % F.lit(9.0)), F.when(order % 20 == 0, F.lit(None)).otherwise(F.lit(float("nan"))))
    return v.table("lineitem").select(
        F.col("l_suppkey").alias("spec_id"),
        F.explode(F.slice(places, 1, F.when(order % 10 == 0, 2).otherwise(1))).alias("shift"),
        (1 + F.col("l_linenumber") % 3).cast("double").alias("intensity"),
        spectra.line_width(SPEC_NUCLEUS, F.col("l_discount")).alias("width"),
    )


def spectrum_domains(v: Views) -> DataFrame:
    """One spectrum per supplier, and for every tenth another one without lines."""
    key = F.col("s_suppkey")
    specs = v.table("supplier").select(F.explode(F.when(key % 10 == 7, F.array(key, -key)).otherwise(F.array(key))).alias("spec_id"))
    return spectra.shared_domain(spectrum_lines(v), specs, nucleus=SPEC_NUCLEUS)


@query("shared_domain", f"SELECT spec_id, round(low, 6) AS low, round(high, 6) AS high FROM ({_DOMAIN_SQL}) d")
def shared_domain(v: Views) -> DataFrame:
    """Spectra without lines keep the default."""
    return spectrum_domains(v).select("spec_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("spectrum_axis", f"SELECT spec_id, i, round(x, 6) AS x FROM ({_AXIS_SQL}) a")
def spectrum_axis(v: Views) -> DataFrame:
    return spectra.spectrum_axis(spectrum_domains(v), nucleus=SPEC_NUCLEUS).withColumn("x", F.round("x", 6))


_SPECTRUM_SQL = f"""
    SELECT spec_id, i, x, CASE WHEN max(y) OVER (PARTITION BY spec_id) > 0 THEN y / max(y) OVER (PARTITION BY spec_id) ELSE y END AS y
    FROM (SELECT a.spec_id, a.i, any_value(a.x) AS x,
                 coalesce(sum(l.intensity * ((l.width / 2) * (l.width / 2)) / ((a.x - l.shift) * (a.x - l.shift) + (l.width / 2) * (l.width / 2))), 0) AS y
          FROM ({_AXIS_SQL}) a LEFT JOIN ({_SPEC_LINES_SQL}) l ON l.spec_id = a.spec_id GROUP BY a.spec_id, a.i) s
"""


def synthesized(v: Views) -> DataFrame:
    return spectra.spectrum_synthesis(spectrum_lines(v), spectrum_domains(v), nucleus=SPEC_NUCLEUS)


@query("spectrum_synthesis", f"SELECT spec_id, i, round(x, 6) AS x, round(y, 6) AS y FROM ({_SPECTRUM_SQL}) s")
def spectrum_synthesis(v: Views) -> DataFrame:
    return synthesized(v).select("spec_id", "i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "spectrum_meta",
    f"""
    SELECT spec_id, '{SPEC_NUCLEUS}' AS nucleus, 'carbon' AS experiment, CAST(100 AS DOUBLE) AS base_frequency,
           round((low + high) * CAST(100 AS DOUBLE) / 2, 6) AS frequency_offset, round(high - low, 6) AS spectral_width FROM ({_DOMAIN_SQL}) d
    """,
)
def spectrum_meta(v: Views) -> DataFrame:
    meta = spectra.spectrum_meta(spectrum_domains(v), nucleus=SPEC_NUCLEUS)
    return meta.withColumn("frequency_offset", F.round("frequency_offset", 6)).withColumn(
        "spectral_width", F.round("spectral_width", 6)
    )


@query(
    "rbf_expand",
    """
    WITH d AS (SELECT b.mol_id, b.bond_idx, sqrt((x.x-y.x)*(x.x-y.x)+(x.y-y.y)*(x.y-y.y)+(x.z-y.z)*(x.z-y.z)) AS d
               FROM bonds b JOIN atoms x ON x.mol_id = b.mol_id AND x.atom_index = b.a JOIN atoms y ON y.mol_id = b.mol_id AND y.atom_index = b.b),
    e AS (SELECT mol_id, bond_idx, list_transform(range(256), lambda k: exp(-((d - 0.1::DOUBLE * k) * (d - 0.1::DOUBLE * k)) / 0.1::DOUBLE)) AS rbf FROM d)
    SELECT mol_id, bond_idx, len(rbf) AS n, round(rbf[1], 6) AS rbf_0, round(rbf[21], 6) AS rbf_20, round(rbf[256], 6) AS rbf_255, round(list_sum(rbf), 6) AS rbf_sum FROM e
    """,
)
def rbf_expand(v: Views) -> DataFrame:
    atoms = v.atoms()
    expanded = once(graph.bond_distances(atoms, v.bonds(atoms)), rbf=spectra.rbf_expand(F.col("distance")))
    total = spectra.array_total(F.col("rbf"))
    return expanded.select(
        "mol_id",
        "bond_idx",
        F.size("rbf").cast("long").alias("n"),
        *[F.round(F.get("rbf", F.lit(k)), 6).alias(f"rbf_{k}") for k in (0, 20, 255)],
        F.round(total, 6).alias("rbf_sum"),
    )


# --- peaks ------------------------------------------------------------------------------------------------------

_SCORE_SQL = """
    s AS (SELECT *, center - half_width - CAST(0.018 AS DOUBLE) AS lo, center + half_width + CAST(0.018 AS DOUBLE) AS hi FROM signals_1h),
    sc AS (SELECT p.mol_id, p.peak_id, p.ppm, s.pos, s.center,
           least(least(abs(s.center - s.half_width - p.ppm), abs(s.center + s.half_width - p.ppm)), abs(s.center - p.ppm) * CAST(0.85 AS DOUBLE))
             + 3 * CASE WHEN p.ppm < s.lo THEN s.lo - p.ppm WHEN p.ppm > s.hi THEN p.ppm - s.hi ELSE 0 END AS score,
           least(CAST(0.09 AS DOUBLE), greatest(CAST(0.03 AS DOUBLE), abs(s.hi - s.lo) * CAST(0.85 AS DOUBLE))) AS tol
           FROM observed_peaks p JOIN s ON s.mol_id = p.mol_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY peak_id ORDER BY score, pos) AS k FROM sc)
"""


@query(
    "peak_match",
    f"WITH {_SCORE_SQL} SELECT mol_id, peak_id, round(ppm, 6) AS ppm, pos, round(center, 6) AS center, round(score, 6) AS score FROM r WHERE k = 1 AND score <= tol",
)
def peak_match(v: Views) -> DataFrame:
    half = F.col("half_width")
    lined = v.signals_1h().withColumn("lines", F.array(F.col("center") - half, F.col("center") + half))
    found = match.peak_match(lined, v.observed_peaks())
    return found.select(
        "mol_id",
        "peak_id",
        F.round("ppm", 6).alias("ppm"),
        "pos",
        F.round("center", 6).alias("center"),
        F.round("score", 6).alias("score"),
    )
