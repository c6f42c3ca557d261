"""Small cases with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from shiftframe.functions import text
from shiftframe.operators import calibration, consensus, ensemble, graph, match, normalize, signals, spectra, summary, validate
from shiftframe.operators.engine_apply import apply_engine
from shiftframe.sources import coordinates, logs, manifest, reference, results

POSITION = {"cdk": 1, "cascade": 2, "orca": 3}


def merged(spark, rows, overrides=()):
    """rows: (engine, status, [(atom, value), ...]); returns ({atom: (value, std, engines)}, weights)."""
    headers = spark.createDataFrame(
        [(1, e, POSITION[e], s) for e, s, _ in rows], "mol_id long, engine string, engine_pos int, status string"
    )
    given = spark.createDataFrame([(1, e, w) for e, w in overrides], "mol_id long, engine string, weight double")
    weighted = consensus.weight_overlay(headers, given)
    shifts = spark.createDataFrame(
        [(1, e, a, float(x)) for e, _, values in rows for a, x in values],
        "mol_id long, engine string, atom_index int, shift_ppm double",
    ).join(weighted, ["mol_id", "engine"])
    out = consensus.consensus(shifts, weight=F.col("weight")).collect()
    used = consensus.weights_used(weighted).first()["weights_used"]
    return {r.atom_index: (r.shift_ppm, r.std_ppm, r.contributing_engines) for r in out}, used


def mean(pairs):
    return sum(w * x for w, x in pairs) / sum(w for w, _ in pairs)


def test_one_engine_is_taken_as_it_is(spark):
    atoms, used = merged(spark, [("cascade", "ok", [(7, 3.75)])])
    assert atoms == {7: (3.75, None, ["cascade"])} and used == {"cascade": 1.0}


def test_mean_and_spread_of_three(spark):
    values = {"cdk": 1.2, "cascade": 1.5, "orca": 0.9}
    atoms, _ = merged(spark, [(e, "ok", [(2, x)]) for e, x in values.items()])
    value, std, engines = atoms[2]
    assert value == pytest.approx(mean([(0.5, 1.2), (0.3, 1.5), (0.2, 0.9)]))
    assert std == pytest.approx(math.sqrt(0.06)) and engines == list(values)


def test_engines_that_failed_have_no_say(spark):
    atoms, used = merged(spark, [("cdk", "pending", [(1, 7.0)]), ("cascade", "ok", [(1, 4.0)]), ("orca", "ok", [(1, 6.0)])])
    assert atoms[1][0] == pytest.approx(4.8) and used == pytest.approx({"cascade": 0.6, "orca": 0.4})
    assert merged(spark, [("cascade", "error", [(1, 2.0)]), ("cdk", "pending", [])]) == ({}, {})


def test_overrides_go_before_defaults(spark):
    rows = [("cascade", "ok", [(3, 2.0)]), ("orca", "ok", [(3, 8.0)])]
    assert merged(spark, rows, [("cascade", 0.25), ("orca", 0.75)])[0][3][0] == pytest.approx(6.5)
    atoms, used = merged(spark, rows, [("orca", 0.0)])
    assert atoms[3] == (2.0, None, ["cascade"]) and used == {"cascade": 1.0}


def test_each_atom_uses_the_engines_that_have_it(spark):
    atoms, _ = merged(spark, [("cdk", "ok", [(0, 1.0), (4, 2.0)]), ("cascade", "ok", [(4, 6.0)]), ("orca", "ok", [(0, 8.0)])])
    assert atoms[0][0] == pytest.approx(3.0) and atoms[0][2] == ["cdk", "orca"]
    assert atoms[4][0] == pytest.approx(3.5) and atoms[4][2] == ["cdk", "cascade"]


def test_engines_are_named_in_request_order(spark):
    rows = [(1, 0, "orca", 1, "ok", 2.0, 0.2), (1, 0, "cdk", 2, "ok", 1.0, 0.5), (1, 0, "mine", 40, "ok", 3.0, 0.1)]
    shifts = spark.createDataFrame(rows, "mol_id long, atom_index int, engine string, engine_pos int, status string, shift_ppm double, weight double")
    assert consensus.consensus(shifts, weight=F.col("weight")).first().contributing_engines == ["orca", "cdk", "mine"]


def test_merge_keeps_faults_in_sight(spark):
    from shiftframe.plans.pipelines import merge_engines

    atoms, bonds = ethanol(spark)
    headers = spark.createDataFrame([(m, "cdk", 1, "ok") for m in (1, 2, 3)], "mol_id long, engine string, engine_pos int, status string")
    shifts = spark.createDataFrame(
        [(1, "cdk", 3, "H", 1.25, 0), (2, "cdk", 0, "H", 1.0, None)], "mol_id long, engine string, atom_index int, symbol string, shift_ppm double, attached_atom_index int"
    )
    checked, merged_rows, _ = merge_engines(headers, shifts, atoms, bonds)
    assert {r.mol_id: r.status for r in checked.collect()} == {1: "ok", 2: "error", 3: "ok"}  # 2 has no atoms
    assert [(r.mol_id, r.attached_atom_index) for r in merged_rows.collect()] == [(1, 0)]
    far = shifts.where("mol_id = 1").withColumn("attached_atom_index", F.lit(99))
    assert {r.status for r in merge_engines(headers.where("mol_id = 1"), far, atoms, bonds)[0].collect()} == {"error"}


def test_little_runs_while_a_plan_is_built(spark):
    """Reading a schema is a job, one per table; a range scan samples and writes what it has summed."""
    import __spark_entry__ as entry

    tracker = spark.sparkContext.statusTracker()
    scans = {"rank_conformers": 1, "integral_curve": 2, "spectrum_synthesis": 0, "calibrate_complete": 1, "consensus": 0, "islands": 1, "shared_domain": 0}
    for key, n in scans.items():
        spark.sparkContext.setJobGroup(f"build-{key}", key)
        try:
            entry.queries()[key](spark, "/root/testdata/sf0.001")
            assert len(tracker.getJobIdsForGroup(f"build-{key}")) <= 3 + 4 * n, key
        finally:
            spark.sparkContext._jsc.clearJobGroup()


def test_ok_engine_without_shifts_keeps_its_weight(spark):
    _, used = merged(spark, [("cdk", "ok", [(0, 1)]), ("cascade", "ok", []), ("orca", "error", [])])
    assert used == pytest.approx({"cdk": 0.625, "cascade": 0.375})


ETHANOL_ATOMS = [(1, i, z, s, False, True, 0, 0) for i, (z, s) in enumerate([(6, "C"), (6, "C"), (8, "O")] + [(1, "H")] * 6)]
ETHANOL_BONDS = [(0, 1), (1, 2), (0, 3), (0, 4), (0, 5), (1, 6), (1, 7), (2, 8)]


def ethanol(spark):
    atoms = spark.createDataFrame(
        ETHANOL_ATOMS,
        "mol_id long, atom_index int, atomic_num int, symbol string, is_aromatic boolean, is_sp3 boolean, formal_charge int, radicals int",
    )
    bonds = spark.createDataFrame(
        [(1, i, a, b, "SINGLE", False, False) for i, (a, b) in enumerate(ETHANOL_BONDS)],
        "mol_id long, bond_idx int, a int, b int, bond_type string, is_conjugated boolean, in_ring boolean",
    )
    return atoms, bonds


def test_ethanol_multiplicities(spark):
    rows = graph.multiplicity_rule(*ethanol(spark)).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.assignment_group, []).append((r.multiplicity, r.neighbor_count, r.coupling_hz))
    assert kinds == {"h@0": [("t", 2, 7.0)] * 3, "h@1": [("q", 3, 7.0)] * 2, "h@2": [("s", 0, None)]}


def test_charge_and_spin(spark):
    assert graph.charge_spin(ethanol(spark)[0]).first()[1:] == (0, 1)


def test_bond_key_ignores_direction(spark):
    frame = spark.createDataFrame([("C", "H"), ("H", "C")], "a string, b string")
    keys = frame.select(graph.bond_key(F.lit("SINGLE"), F.lit(False), F.lit(False), F.col("a"), F.col("b")).alias("k"))
    assert {r.k for r in keys.collect()} == {"SINGLE|false|false|C-H"}


def test_isolated_atom_gets_a_loop(spark):
    coords = spark.createDataFrame(
        [(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 90.0, 0.0, 0.0)],
        "mol_id long, atom_index int, x double, y double, z double",
    )
    for small in (0, 64):
        pairs = graph.radius_neighbors(coords, cutoff=5.0, k=3, small_group=small)
        assert sorted((r.atom_index, r.nbr, r.distance, r["rank"]) for r in pairs.collect()) == [
            (0, 1, 1.0, 1), (1, 0, 1.0, 1), (2, 2, 0.0, 0),
        ]


# --- signals ----------------------------------------------------------------------------------------------------


def proton_rows(spark, rows):
    return spark.createDataFrame(
        rows,
        "mol_id long, atom_index int, shift double, element string, engine string, assignment_group string, "
        "attached_atom_index int, multiplicity string, coupling_hz double, neighbor_count double, source_id string",
    )


def test_grouping(spark):
    rows = [(1, 8 + i, s, "H", "cdk", "h@2", 2, "t", 6.5, 2.0, None) for i, s in enumerate([3.5, 3.56, 3.53])]
    members = signals.signal_group(proton_rows(spark, rows), nucleus="1H")
    stats = signals.add_lines(
        signals.assignment_text(signals.signal_stats(members, nucleus="1H", with_atoms=True), members, nucleus="1H"), nucleus="1H"
    ).collect()
    assert len(stats) == 1
    signal = stats[0]
    assert signal.center == pytest.approx(3.53) and signal.integration == 3
    assert signal.assignment_text == "H8-H10 on atom #2"
    assert signal.atom_indices == [8, 9, 10] and len(signal.lines) == 3
    assert signal.signal_id == "default:cdk:h@2:0"


def test_sources_stay_apart(spark):
    rows = [(1, 4, 1.25, "H", "cdk", "h@0", 0, "s", None, 0.0, source) for source in ("a", "b")]
    members = signals.signal_group(proton_rows(spark, rows), nucleus="1H")
    assert sorted(r.source_id for r in signals.signal_stats(members, nucleus="1H").collect()) == ["a", "b"]


def test_repeated_atom_moves_the_centre_but_not_the_count(spark):
    rows = [(1, a, s, "H", "cdk", "g", None, "s", None, None, None) for a, s in [(1, 2.0), (2, 1.98), (2, 1.9)]]
    members = signals.signal_group(proton_rows(spark, rows), nucleus="1H")
    signal = signals.signal_stats(members, nucleus="1H").first()
    assert signal.integration == 2 and signal.center == pytest.approx((1.99 * 1 + 1.9) / 2)


def test_multiplicity_tie_goes_to_the_first(spark):
    rows = [(1, a, s, "H", "cdk", "g", None, m, None, None, None) for a, s, m in [(1, 2.0, "t"), (2, 1.99, "d"), (3, 1.98, "d"), (4, 1.97, "t")]]
    members = signals.signal_group(proton_rows(spark, rows), nucleus="1H")
    assert signals.signal_stats(members, nucleus="1H").first().multiplicity == "t"


def test_other_nuclei_form_one_cluster_per_key(spark):
    rows = [(1, 1, 20.0, "C", "cdk", "g", None, None, None, None, None), (1, 2, 90.0, "C", "cdk", "g", None, None, None, None, None)]
    members = signals.signal_group(proton_rows(spark, rows), nucleus="13C")
    stats = signals.signal_stats(members, nucleus="13C")
    signal = signals.assignment_text(stats, members, nucleus="13C").first()
    assert signal.center == pytest.approx(55.0) and signal.integration is None and signal.assignment_text == "C #2"


def lines_of(spark, label, coupling, integration, nucleus="1H"):
    frame = spark.createDataFrame([(1.24, label, coupling, integration)], "center double, label string, j double, n long")
    lines = signals.multiplet_lines(nucleus, F.col("center"), F.col("label"), F.col("j"), F.col("n"))
    return [(r.shift, r.intensity) for r in frame.select(F.inline(lines).alias("shift", "intensity")).collect()]


def test_lines(spark):
    assert lines_of(spark, "d", 0.0, 1) == [(1.24, 0.8)]
    assert lines_of(spark, None, None, 3) == [(1.24, pytest.approx(1.04))]
    quartet = lines_of(spark, "q", None, 1)
    assert [round(s, 5) for s, _ in quartet] == [1.21375, 1.23125, 1.24875, 1.26625]
    assert [h for _, h in quartet] == pytest.approx([0.8 / 3, 0.8, 0.8, 0.8 / 3])
    assert len(lines_of(spark, "strange", 5.0, 1)) == 5
    assert lines_of(spark, "t", 7.0, 1, "13C") == [(1.24, 1.0)]


def test_integral_curve(spark):
    rows = spark.createDataFrame(
        [(1, 1, 3.5, 2), (1, 2, 1.2, 3), (2, 1, 5.0, None)], "mol_id long, pos int, center double, integration int"
    )
    points = sorted((r.seq, r.x, r.y) for r in signals.integral_curve(rows, low=0.5, high=12.0).collect())
    assert len(points) == 10 and points[0] == (0, 12.0, 0.08)
    assert points[-1] == (9, 0.5, pytest.approx(0.36))
    assert [y for _, _, y in points[1:9]] == pytest.approx([0.08, 0.08, 0.192, 0.192, 0.192, 0.192, 0.36, 0.36])


def test_islands_with_gaps_and_range_edges(spark):
    values = [4, 5, 6, 9, 0, -1, 12, 13, 14, 15, 16, 17]
    rows = spark.createDataFrame([(1, v) for v in values], "mol_id long, v int")
    want = [(-1, 0), (4, 6), (9, 9), (12, 17)]
    for width in (1, 2, 3, 5, 4096):
        runs = signals.islands(rows, keys=["mol_id"], value="v", width=width)
        assert sorted((r.first_, r.last_) for r in runs.toDF("mol_id", "first_", "last_").collect()) == want
    label = signals.island_text(signals.islands(rows.where("v > 3 AND v < 10"), keys=["mol_id"], value="v"), keys=["mol_id"])
    assert label.first().ranges == "H4-H6, H9"


def test_selection_target(spark):
    frame = spark.createDataFrame([([4, 3, 4], 0)], "atoms array<int>, anchor int")
    pick = lambda nucleus: frame.select(normalize.selection_target(nucleus, F.col("atoms"), F.col("anchor")).alias("t")).first().t
    assert pick("1H") == [0] and pick("13C") == [3, 4]


def test_splitting_text(spark):
    frame = spark.createDataFrame(
        [("t", 2.0, 7.0), ("d", 1.0, None), ("s", 0.0, None), ("m", 3.5, None), ("x", 1.0, 7.0), ("d", None, None), (None, 2.0, 7.0)],
        "m string, n double, j double",
    )
    texts = [r.t for r in frame.select(text.splitting_text(F.col("m"), F.col("n"), F.col("j")).alias("t")).collect()]
    assert texts == [
        "triplet: 2 neighbors (n+1 = 3 lines) · J ≈ 7.0 Hz",
        "doublet: 1 neighbor (n+1 = 2 lines)",
        "singlet: no 1H neighbors",
        "multiplet: 4 neighbors (n+1 = 5 lines) · complex pattern (unresolved)",
        None,
        None,
        None,
    ]


# --- spectra and peaks ------------------------------------------------------------------------------------------


def test_single_line_spectrum_at_full_size(spark):
    lines = spark.createDataFrame([(1, 6.0, 2.0, 0.004)], "spec_id long, shift double, intensity double, width double")
    domains = spectra.shared_domain(lines, spark.createDataFrame([(1,), (2,)], "spec_id long"), nucleus="1H")
    found = {r.spec_id: (r.low, r.high) for r in domains.collect()}
    assert found[1] == pytest.approx((5.1, 6.9)) and found[2] == (0.0, 12.0)
    points = spectra.spectrum_synthesis(lines, domains, nucleus="1H")
    stats = {r.spec_id: r for r in points.groupBy("spec_id").agg(F.count("i").alias("n"), F.max("y").alias("top"), F.max_by("x", "y").alias("at")).collect()}
    assert stats[1].n == 32768 and stats[1].top == 1.0 and stats[1].at == pytest.approx(6.0, abs=1e-4)
    assert stats[2].n == 32768 and stats[2].top == 0.0


def test_metadata_experiment(spark):
    domains = spark.createDataFrame([(1, 0.0, 12.0)], "spec_id long, low double, high double")
    proton = spectra.spectrum_meta(domains, nucleus="1H").first()
    assert proton.experiment == "proton" and proton.frequency_offset == pytest.approx(12 * 400.13 / 2)
    assert spectra.spectrum_meta(domains, nucleus="15N").first().experiment == "carbon"


def test_rbf(spark):
    values = spark.range(1).select(spectra.rbf_expand(F.lit(1.05)).alias("r")).first().r
    assert len(values) == 256
    assert values == pytest.approx([math.exp(-((1.05 - 0.1 * k) ** 2) / 0.1) for k in range(256)])


def test_peak_match_without_key_and_ties(spark):
    rows = spark.createDataFrame(
        [(1, 3.0, [3.0]), (2, 2.9, [2.9]), (3, 1.0, [0.99, 1.01])], "pos int, center double, lines array<double>"
    )
    peaks = spark.createDataFrame([(1, 2.95), (2, 1.005), (3, 2.0), (4, 3.01)], "peak_id int, ppm double")
    found = {r.peak_id: r.pos for r in match.peak_match(rows, peaks, keys=[]).collect()}
    assert found == {2: 3, 4: 1}


# --- records ----------------------------------------------------------------------------------------------------


def test_index_checks(spark):
    headers = spark.createDataFrame([(1, "cdk", "ok"), (1, "orca", "ok")], "mol_id long, engine string, status string")
    shifts = spark.createDataFrame(
        [(1, "cdk", 999, None, 9), (1, "cdk", 0, None, 9), (1, "orca", 0, 3, 9), (1, "orca", 1, None, 9)],
        "mol_id long, engine string, atom_index int, attached_atom_index int, n_atoms int",
    )
    checked, kept = validate.index_check_strict(headers, shifts)
    by = {r.engine: r for r in checked.collect()}
    assert by["cdk"].status == "error" and by["cdk"].message.startswith("cdk prediction failed. Reference ID: ")
    assert by["orca"].status == "ok" and by["orca"].message is None
    assert {r.engine for r in kept.collect()} == {"orca"}
    valid, counts = validate.index_check_lenient(shifts)
    assert valid.count() == 3
    assert counts.first().warning == "Dropped 1 invalid engine assignment(s)."


def test_values_that_cannot_be_used(spark):
    rows = spark.createDataFrame([(1.0,), (-0.5,), (None,), (0.0,), (float("nan"),)], "shift_ppm double")
    assert sorted(r.shift_ppm for r in validate.drop_unusable(rows).collect()) == [0.0, 1.0]


def test_payload_pick(spark):
    rows = spark.createDataFrame([([],), ([1.0],), ([1.0, 2.0, 3.0],), ([1.0, None],), (None,)], "p array<double>")
    assert [r.v for r in rows.select(validate.payload_pick(F.col("p")).alias("v")).collect()] == [None, 1.0, 2.0, None, None]


def test_strings(spark):
    rows = spark.createDataFrame([(" \t",), ("C" * 257,), (" CCO ",), ("C(C",), ("C)(",), ("C C",), (None,)], "s string")
    out = rows.select(text.string_gate(F.col("s")).alias("g"), text.string_lint(F.col("s")).alias("l")).collect()
    assert [r.g for r in out] == ["SMILES is empty", "SMILES is too long (max 256 characters)", None, None, None, None, "SMILES is empty"]
    assert [r.l for r in out] == [
        "SMILES is empty", None, None, "Unbalanced parentheses", "Unbalanced parentheses", "Invalid characters in SMILES", "SMILES is empty",
    ]


def test_response_flattening(spark, tmp_path):
    (tmp_path / "r.json").write_text(
        '{"mol_id": 1, "canonical_smiles": "CCO", "atom_symbols": ["C", "C", "O"], "engines": {'
        '"cdk": {"engine": "cdk", "status": "ok", "shifts": [{"atom_index": 0, "symbol": "C", "shift_ppm": 17.5}]}, '
        '"orca": {"engine": "orca", "status": "error", "message": "ORCA executable not configured", "shifts": []}}, '
        '"consensus": {"shifts": [{"atom_index": 0, "symbol": "C", "shift_ppm": 17.5, "std_ppm": 0.2, "contributing_engines": ["cdk"]}], "weights_used": {"cdk": 1.0}}}'
    )
    responses = results.read_responses(spark, str(tmp_path))
    headers = results.engine_headers(responses, "mol_id").withColumn("engine_pos", F.when(F.col("engine") == "cdk", 1).otherwise(3))
    none = spark.createDataFrame([], "mol_id long, warning string")
    assert normalize.warnings(headers, none).first().warnings == ["orca: ORCA executable not configured"]
    rows = results.engine_shifts(responses, "mol_id").collect()
    assert [(r.engine, r.shift_ppm) for r in rows] == [("cdk", 17.5), ("orca", None)]
    assert results.consensus_shifts(responses, "mol_id").first().std_ppm == 0.2


def test_filters(spark):
    rows = spark.createDataFrame([("cdk",), ("orca",), (None,)], "engine string")
    assert normalize.engine_filter(rows, []).count() == 0
    assert normalize.engine_filter(rows, ["cdk"]).count() == 1
    assert normalize.engine_filter(rows, ["cdk"], mode="consensus").count() == 3
    tagged = spark.createDataFrame([("a",), ("b",)], "source_id string")
    assert [normalize.source_filter(tagged, s).count() for s in ("a", None)] == [1, 2]
    assert normalize.source_filter(tagged, "a", enabled=False).count() == 0


def test_summary(spark):
    rows = spark.createDataFrame([("cdk", 2), ("cdk", 3), ("orca", 1)], "engine string, integration long")
    table = {r.engine: (r.n_signals, r.protons) for r in summary.engine_summary(rows).collect()}
    assert table == {"cdk": (2, 5), "orca": (1, 1), None: (3, 6)}
    assert {r.protons for r in summary.engine_summary(rows, nucleus="13C").collect()} == {None}


# --- ensembles and calibration ----------------------------------------------------------------------------------


def test_boltzmann(spark):
    conformers = spark.createDataFrame([(1, 0, 5.0), (1, 1, 5.5)], "mol_id long, conf_id int, energy_kcal double")
    shifts = spark.createDataFrame([(1, 0, 0, 10.0), (1, 1, 0, 20.0)], "mol_id long, conf_id int, atom_index int, shift_ppm double")
    w = math.exp(-0.5 / (0.001987 * 298.15))
    row = ensemble.boltzmann_mean(conformers, shifts).first()
    assert row.shift_ppm == pytest.approx((10 + 20 * w) / (1 + w)) and row.status == "ok"


def test_best_conformer(spark):
    rows = spark.createDataFrame(
        [(1, 0, 3.0, 0), (1, 1, 1.0, -1), (1, 2, 2.0, 1), (2, 5, 1.0, -1), (2, 4, None, 0)],
        "mol_id long, conf_id int, energy_kcal double, flag int",
    )
    assert {r.mol_id: r.conf_id for r in ensemble.best_conformer(rows).collect()} == {1: 2, 2: 4}


def test_calibration(spark):
    reference_rows = spark.createDataFrame([("pbe", "def2-svp", "1H", 31.8)], "functional string, basis string, nucleus string, sigma double")
    rows = spark.createDataFrame([(1, " PBE", "Def2-SVP ", "1H", 30.0), (2, "other", "x", "1H", 1.0)], "mol_id long, functional string, basis string, nucleus string, sigma double")
    assert [(r.mol_id, r.shift_ppm) for r in calibration.calibrate(rows, reference_rows).orderBy("mol_id").collect()] == [(1, pytest.approx(1.8)), (2, None)]
    targets = spark.createDataFrame([(1, 0, "1H"), (1, 1, "13C"), (1, 2, "1H"), (2, 0, "1H")], "mol_id long, atom_index int, nucleus string")
    sigmas = spark.createDataFrame([(1, 0, 3.0), (1, 1, None), (2, 0, 4.0)], "mol_id long, atom_index int, sigma double")
    complete, status = calibration.calibrate_complete(targets, sigmas)
    assert {r.mol_id: (r.status, r.first_missing) for r in status.collect()} == {1: ("error", 1), 2: ("ok", None)}
    assert [r.message for r in status.where("mol_id = 1").collect()] == ["ORCA did not emit an isotropic shielding for atom 1 (C)"]
    assert [r.mol_id for r in complete.collect()] == [2]


# --- files ------------------------------------------------------------------------------------------------------

BLOCKS = """
 Nucleus   5N :
   Total isotropic shielding:   -42.5000 ppm
   Isotropic shielding:   7.0000 ppm
 Nucleus  11F :
   Isotropic shielding:    402.1250
 ****ORCA TERMINATED NORMALLY****
"""
TABLE = """
CHEMICAL SHIFT LIST (ppm)
  Nucleus  Element    Isotropic     Anisotropy
      2       P          311.2500         1.0000
      3       F          402.1250         2.0000
      9       N          -42.5000         3.0000
"""


def test_logs(spark, tmp_path):
    for name, content in (("blocks", BLOCKS), ("table", TABLE), ("none", "nothing to see\n")):
        (tmp_path / f"{name}.out").write_text(content)
    name = F.regexp_extract("file_id", r"(\w+)\.out$", 1).alias("name")
    status = {r.name: (r.n_lines, r.finished) for r in logs.scan_logs(spark, str(tmp_path)).select(name, "n_lines", "finished").collect()}
    assert status == {"blocks": (7, True), "table": (6, False), "none": (1, False)}
    found = {}
    for r in logs.read_log_sections(spark, str(tmp_path)).select(name, "atom_index", "sigma").collect():
        found.setdefault(r.name, {})[r.atom_index] = r.sigma
    assert found == {"blocks": {5: -42.5, 11: 402.125}, "table": {2: 311.25, 3: 402.125, 9: -42.5}}


def test_lines_of_a_split_file_stay_in_order(spark, tmp_path):
    (tmp_path / "long.out").write_text("".join(f"{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines = logs.read_lines(spark, str(tmp_path)).orderBy("block_start", "row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({r.block_start for r in lines}) > 5
    assert [int(r.line) for r in lines] == list(range(20000))


def test_coordinates(spark, tmp_path):
    files = {
        "good": "\n3\nnote\nC 0 1 2\nH 1.5 0 -1 extra\n\nH 1 2\n",
        "short": "3\nnote\n",
        "bare": "3\nnote\nC 1 2\n",
        "broken": "1\nnote\nC 1 2 three\n",
    }
    for name, content in files.items():
        (tmp_path / f"{name}.xyz").write_text(content)
    rows = coordinates.parse_coordinates(coordinates.read_files(spark, str(tmp_path))).collect()
    out = {}
    for r in rows:
        out.setdefault(r.file_id.rsplit("/", 1)[1], []).append((r.status, r.symbol, r.x, r.y, r.z))
    assert out == {
        "good.xyz": [("ok", "C", 0.0, 1.0, 2.0), ("ok", "H", 1.5, 0.0, -1.0)],
        "short.xyz": [("malformed", None, None, None, None)],
        "bare.xyz": [("no coordinates", None, None, None, None)],
        "broken.xyz": [("bad number", None, None, None, None)],
    }


def test_decks(spark):
    atoms = spark.createDataFrame(
        [(1, 1, 1, "H", 0, 0, 1.0, 0.0, 0.0), (1, 0, 6, "C", 0, 0, 0.0, -1.5, 0.0)],
        "mol_id long, atom_index int, atomic_num int, symbol string, formal_charge int, radicals int, x double, y double, z double",
    )
    deck = coordinates.render_decks(atoms, functional="PBE", basis="def2-SVP", cpus=4, ram_mb=2000).first().deck
    lines = deck.split("\n")
    assert lines[0] == "! PBE def2-SVP NMR TightSCF" and "%maxcore 2000" in lines and "  nprocs 4" in lines
    at = lines.index("* xyz 0 1")
    assert lines[at + 1] == "  C       0.00000000     -1.50000000      0.00000000"
    assert lines[at + 2].startswith("  H       1.00000000") and deck.rstrip().endswith("*")
    search = coordinates.render_decks(atoms, kind="search", cpus=2).first().deck
    assert search.startswith("! XTB2 GOAT") and "  NWorkers 2" in search


def test_manifest(spark, tmp_path):
    import hashlib

    for name in ("a", "b", "c"):
        (tmp_path / name).write_bytes(name.encode())
    files = manifest.read_binary(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", r"([^/]+)$", 1))
    listed = spark.createDataFrame([("a", hashlib.sha256(b"a").hexdigest().upper()), ("b", "0" * 64)], "path string, sha256 string")
    status = {r.path: (r.status, r.accepted) for r in manifest.manifest_check(files, listed).collect()}
    assert status == {"a": ("ok", True), "b": ("mismatch", False), "c": ("unlisted", True)}


def test_digests_of_files_in_chunks(spark, tmp_path):
    import hashlib
    import os

    contents = {"long name %20.bin": os.urandom(3_000_001), "edge": b"x" * 4096, "one": b"\x00", "empty": b""}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    for chunk in (1 << 20, 4096, 7919):
        rows = manifest.digest_files(spark, str(tmp_path), chunk_bytes=chunk).collect()
        found = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in rows}
        assert found == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items() if c}
        named = [(str(tmp_path / n),) for n in contents] + [(None,), (str(tmp_path / "one"),)]
        rows = manifest.digest_paths(spark.createDataFrame(named, "path string"), chunk_bytes=chunk).collect()
        wanted = [(len(c), hashlib.sha256(c).hexdigest()) for c in contents.values()]
        assert [(r.read_bytes, r.sha256) for r in rows] == [*wanted, (None, None), wanted[2]]
    (tmp_path / "none").mkdir()
    assert manifest.digest_files(spark, str(tmp_path / "none")).count() == 0
    # a cell limit far below the file does not matter, as no file becomes a cell
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        assert len(manifest.digest_files(spark, str(tmp_path)).collect()) == 3
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_reference_documents(spark, tmp_path):
    assert reference.load_reference(spark, str(tmp_path / "missing")).count() == 0
    (tmp_path / "good.json").write_text('{\n  "pbe|def2-svp": {"1H": 31.8, "13C": 188.1}\n}')
    (tmp_path / "bad.json").write_text('{"pbe|x": ')
    rows = reference.load_reference(spark, str(tmp_path)).collect()
    assert sorted((r.functional, r.basis, r.nucleus, r.sigma) for r in rows) == [
        ("pbe", "def2-svp", "13C", 188.1), ("pbe", "def2-svp", "1H", 31.8),
    ]


def test_reference_additions_survive_each_other(spark, tmp_path):
    path = str(tmp_path / "table")
    kinds = "functional string, basis string, nucleus string, sigma double"
    first = spark.createDataFrame([("PBE", "a", "1H", 1.0)], kinds)
    other = spark.createDataFrame([("B3LYP", "a", "1H", 2.0), ("pbe ", "A", "1H", 9.0)], kinds)
    # Both saw an empty table: the second one writes its own value for the shared method too.
    reference.upsert_reference(spark, path, first, batch="1")
    fresh = other.select(F.lower(F.trim("functional")).alias("functional"), F.lower("basis").alias("basis"), "nucleus", "sigma")
    fresh.withColumn("batch", F.lit("2")).write.mode("append").parquet(path)
    table = reference.upsert_reference(spark, path, other)
    assert sorted((r.functional, r.sigma) for r in table.collect()) == [("b3lyp", 2.0), ("pbe", 1.0)]


def test_failing_predictor_becomes_a_row(spark):
    molecules = spark.createDataFrame([(1, "1H", 3), (2, "1H", 3), (3, "1H", 3), (4, "1H", 3)], "mol_id long, nucleus string, n_atoms int")

    def predictor(molecule, nucleus):
        if molecule["mol_id"] == 1:
            raise RuntimeError("secret path /opt/x")
        if molecule["mol_id"] == 2:
            return [{"atom_index": 999, "symbol": "H", "shift_ppm": 1.0}]
        if molecule["mol_id"] == 3:
            return []
        return [{"atom_index": 0, "symbol": "H", "shift_ppm": 1.0, "neighbor_count": 2}]

    rows = {r.mol_id: r for r in apply_engine(molecules, predictor, engine="mine").collect()}
    assert [rows[i].status for i in (1, 2, 3, 4)] == ["error", "error", "ok", "ok"]
    assert "secret" not in rows[1].message and "Reference ID" in rows[1].message
    assert rows[3].atom_index is None and (rows[4].atom_index, rows[4].neighbor_count) == (0, 2)
    again = {r.mol_id: r.message for r in apply_engine(molecules, predictor, engine="mine").collect()}
    assert again[1] == rows[1].message


def test_rows_to_draw(spark):
    from shiftframe.plans.pipelines import flat_rows

    kinds = "mol_id long, atom_index int, attached_atom_index int, n_atoms int, symbol string, shift_ppm double, confidence double"
    individual = spark.createDataFrame(
        [(1, 0, None, 3, "C", 10.0, 0.5, "cdk"), (1, 7, None, 3, "C", 11.0, None, "orca"), (2, 0, None, 3, "C", 12.0, None, "cdk")],
        kinds + ", engine string",
    )
    merged = spark.createDataFrame([(2, 1, 0, 3, "C", 20.0, None, 0.4), (1, 1, 0, 3, "C", 21.0, None, 0.4)], kinds + ", std_ppm double")
    requests = spark.createDataFrame([(1, "individual"), (2, "consensus")], "mol_id long, mode string")
    drawn = flat_rows(individual, merged, requests).collect()
    assert sorted((r.mol_id, r.atom_index, r.engine, r.element, r["shift"], r.intensity, r.std_ppm) for r in drawn) == [
        (1, 0, "cdk", "C", 10.0, 0.5, None), (2, 1, None, "C", 20.0, 1.0, 0.4),
    ]


def test_engines_by_name(spark):
    from shiftframe.operators.engine_apply import Engine, apply_engines

    def counted(molecule, nucleus, scale=1):
        return [{"atom_index": 0, "symbol": "H", "shift_ppm": float(scale * molecule["mol_id"])}]

    molecules = spark.createDataFrame(
        [(1, "1H", 3, ["slow", "fast"]), (2, "1H", 3, ["fast", "none", "fast"]), (3, "1H", 3, [])],
        "mol_id long, nucleus string, n_atoms int, engines array<string>",
    )
    known = {"fast": Engine(counted, options={"scale": 2}), "slow": Engine(None, ready=False)}
    rows = apply_engines(molecules, known).collect()
    assert sorted((r.mol_id, r.engine_pos, r.engine, r.status, r.shift_ppm) for r in rows) == [
        (1, 1, "slow", "pending", None), (1, 2, "fast", "ok", 2.0), (2, 1, "fast", "ok", 4.0), (2, 2, "none", "error", None),
    ]


def test_rbf_of_no_distance(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, None), (2, float("nan"))], "i int, d double")
    found = {r.i: (r.rbf, r.total) for r in rows.select("i", spectra.rbf_expand(F.col("d"), size=4).alias("rbf")).select("*", spectra.array_total(F.col("rbf")).alias("total")).collect()}
    assert found[1] == ([None] * 4, 0.0) and len(found[0][0]) == 4 and abs(sum(found[0][0]) - found[0][1]) < 1e-12
    ragged = spark.createDataFrame([(0, [1.0, 2.0]), (1, []), (2, None), (3, [None, 4.0])], "i int, v array<double>")
    assert {r.i: r.t for r in ragged.select("i", spectra.array_total(F.col("v")).alias("t")).collect()} == {0: 3.0, 1: 0.0, 2: None, 3: 4.0}


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_frames_of_files_split_over_blocks(spark, tmp_path, batch):
    import random

    draw, want = random.Random(3), set()
    for f in range(6):
        text = []
        for n in range(draw.choice([1, 30, 60])):
            atoms = draw.randint(1, 9)
            title = str(draw.randint(0, 99)) if n % 3 == 0 else f"frame {n}"
            body = [f"C {n}.5 {i}.0 -1.25" for i in range(atoms)]
            text += [f" {atoms} " if n or f % 2 else "any header", title, *body]
            want |= {(f, n, i, n + 0.5, float(i)) for i in range(atoms)}
        (tmp_path / f"{f}.xyz").write_text("\n".join([*text, "", ""]))
    settings = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = coordinates.parse_coordinates(coordinates.read_frames(spark, str(tmp_path))).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert all(r.status == "ok" for r in rows)
    assert {(int(r.file_id.rsplit("/", 1)[1].split(".")[0]), int(r.x - 0.5), r.atom_index, r.x, r.y) for r in rows} == want


def test_atom_ranges(spark):
    rows = spark.createDataFrame([(0, [1, 2, 3, 7, 9, 10]), (1, [4]), (2, []), (3, [0, 2])], "i int, a array<int>")
    assert {r.i: r.t for r in rows.select("i", signals.atom_ranges(F.col("a")).alias("t")).collect()} == {0: "H1-H3, H7, H9-H10", 1: "H4", 2: "", 3: "H0, H2"}


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from shiftframe.functions.workspace import shared_folder

    def session(master, **settings):
        get = lambda key, default=None: settings.get(key, default)
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key: None), getCheckpointDir=lambda: None)
        return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=context)

    local = {"spark.sql.warehouse.dir": "file:/work/warehouse"}
    assert shared_folder(session("local[4]", **local)) == "file:/work/warehouse/_intermediate"
    assert shared_folder(session("yarn", **{"spark.sql.warehouse.dir": "hdfs://a/w"})) == "hdfs://a/w/_intermediate"
    assert shared_folder(session("yarn", **local, **{"spark.checkpoint.dir": "hdfs://a/c/"})) == "hdfs://a/c"
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(session("yarn", **local))
