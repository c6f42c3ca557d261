"""Predictions to 1H spectra, against a plain computation of every step."""

import math

import numpy as np
from pyspark.sql import functions as F

from shiftframe import constants as C
from shiftframe.operators import spectra
from shiftframe.plans.pipelines import requested_spectra

ENGINES = ("cdk", "cascade", "orca")
# molecule: symbols and bonds; the heavy atoms are sp3
MOLECULES = {
    1: (["C", "C", "O", "H", "H", "H", "H", "H", "H"], [(0, 1), (1, 2), (0, 3), (0, 4), (0, 5), (1, 6), (1, 7), (2, 8)]),
    2: (["C", "H", "H", "H", "H"], [(0, 1), (0, 2), (0, 3), (0, 4)]),
    3: (["C", "C", "H", "H", "H", "H"], [(0, 1), (0, 2), (0, 3), (1, 4), (1, 5)]),
}
MODE = {1: "consensus", 2: "individual", 3: "individual"}
SPECTRUM = {1: 10, 2: 10, 3: 11}


def predictions():
    rows = []
    for mol, (symbols, _) in MOLECULES.items():
        for e, engine in enumerate(ENGINES):
            if (mol, engine) == (3, "orca"):
                continue
            rows += [(mol, engine, i, "H", 1.0 + (i * 7 % 5) * 0.35 + e * 0.02 + mol * 0.5 + i * 0.011) for i, s in enumerate(symbols) if s == "H"]
    return rows + [(2, "cascade", 99, "H", 5.0)]  # one bad index rejects that engine


def annotation(mol, atom):
    symbols, bonds = MOLECULES[mol]
    near = lambda i: [b if a == i else a for a, b in bonds if i in (a, b)]
    anchor = next(i for i in near(atom) if symbols[i] != "H")
    n = sum(symbols[h] == "H" for c in near(anchor) if symbols[c] == "C" for h in near(c)) if symbols[anchor] == "C" else 0
    return f"h@{anchor}", anchor, "s" if n == 0 else {1: "d", 2: "t", 3: "q"}.get(n, "m"), 7.0 if n else None


def slow_points(points):
    weights = {"cdk": 0.5, "cascade": 0.3, "orca": 0.2}
    usable = [r for r in predictions() if (r[0], r[1]) != (2, "cascade")]
    drawn = []  # spectrum, engine, molecule, atom, shift, std
    for mol, mode in MODE.items():
        own = [r for r in usable if r[0] == mol]
        if mode == "individual":
            drawn += [(SPECTRUM[mol], e, mol, i, v, None) for _, e, i, _, v in own]
            continue
        for atom in sorted({r[2] for r in own}):
            found = [(weights[e], v) for _, e, i, _, v in own if i == atom]
            mean = sum(w * v for w, v in found) / sum(w for w, _ in found)
            drawn.append((SPECTRUM[mol], "consensus", mol, atom, mean, float(np.std([v for _, v in found])) if len(found) > 1 else None))
    groups = {}
    for spec, engine, mol, atom, value, std in drawn:
        group, anchor, label, coupling = annotation(mol, atom)
        groups.setdefault((spec, engine, mol, group), []).append((value, atom, label, coupling, std))
    lines = {}
    for (spec, engine, _, _), members in groups.items():
        clusters = []
        for value, atom, label, coupling, std in sorted(members, key=lambda m: (-m[0], m[1])):
            if clusters and abs(clusters[-1]["center"] - value) <= C.GROUP_TOLERANCE_1H_PPM:
                own = clusters[-1]
                own["n"] += 1
                own["center"] = (own["center"] * (own["n"] - 1) + value) / own["n"]
                own["std"].append(std)
            else:
                clusters.append({"center": value, "n": 1, "label": label, "coupling": coupling, "std": [std]})
        for own in clusters:
            height = C.LINE_BASE_HEIGHT + min(C.LINE_HEIGHT_MAX_EXTRA, (own["n"] - 1) * C.LINE_HEIGHT_STEP)
            pattern = C.MULTIPLET_PATTERNS.get(own["label"], C.MULTIPLET_PATTERNS["m"]) if own["label"] != "s" else [1]
            spacing = (own["coupling"] if own["coupling"] is not None else C.DEFAULT_COUPLING_HZ) / C.SPECTROMETER_MHZ
            stds = [s for s in own["std"] if s is not None]
            width = C.LINE_WIDTH_PPM["1H"] + max(0.0, (sum(stds) / len(stds) if stds else 0.0) * C.STD_BROADENING)
            for i, h in enumerate(pattern):
                at = own["center"] + (i - (len(pattern) - 1) / 2) * spacing
                lines.setdefault((spec, engine), []).append((at, height * h / max(pattern), width))
    result = {}
    for spec, engine in lines:
        places = [at for (s, _), own in lines.items() if s == spec for at, _, _ in own]
        least, most = C.DOMAIN_PPM["1H"]
        low, high = (min(most, max(least, x)) for x in (min(places) - C.DOMAIN_MARGIN_1H_PPM, max(places) + C.DOMAIN_MARGIN_1H_PPM))
        x = low + np.arange(points) * ((high - low) / (points - 1))
        y = sum(h * (w / 2) ** 2 / ((x - at) ** 2 + (w / 2) ** 2) for at, h, w in lines[spec, engine])
        result[spec, engine] = (x, y / y.max())
    return result


def test_requested_spectra(spark):
    atoms = [(m, i, {"C": 6, "O": 8, "H": 1}[s], s, False, s != "H") for m, (symbols, _) in MOLECULES.items() for i, s in enumerate(symbols)]
    bonds = [(m, n, a, b) for m, (_, own) in MOLECULES.items() for n, (a, b) in enumerate(own)]
    headers = [(m, e, p + 1, "pending" if (m, e) == (3, "orca") else "ok") for m in MOLECULES for p, e in enumerate(ENGINES)]
    _, points, meta = requested_spectra(
        spark.createDataFrame(headers, "mol_id long, engine string, engine_pos int, status string"),
        spark.createDataFrame(predictions(), "mol_id long, engine string, atom_index int, symbol string, shift_ppm double"),
        spark.createDataFrame(atoms, "mol_id long, atom_index int, atomic_num int, symbol string, is_aromatic boolean, is_sp3 boolean"),
        spark.createDataFrame(bonds, "mol_id long, bond_idx int, a int, b int"),
        spark.createDataFrame(list(MODE.items()), "mol_id long, mode string"),
        spark.createDataFrame(list(SPECTRUM.items()), "mol_id long, spec_id long"),
    )
    n = C.SPECTRUM_POINTS["1H"]
    want = slow_points(n)
    assert n == 32768 and set(want) == {(10, "consensus"), (10, "cdk"), (10, "orca"), (11, "cdk"), (11, "cascade")}
    found = points.toPandas()
    assert len(found) == n * len(want) and meta.count() == len(want)
    for (spec, engine), (x, y) in want.items():
        own = found[(found.spec_id == spec) & (found.engine == engine)].sort_values("i")
        assert np.allclose(own.x, x, atol=1e-9) and np.allclose(own.y, y, atol=1e-9)


def test_a_spectrum_of_very_many_lines(spark):
    n, points = 200_000, 512
    lines = spark.range(n).select(F.lit(1).alias("spec_id"), (F.col("id") % 997 / 100).alias("shift"), F.lit(1.0).alias("intensity"), F.lit(0.02).alias("width"))
    domains = spark.createDataFrame([(1, 0.0, 10.0), (2, 0.0, 1.0)], "spec_id int, low double, high double")
    drawn = spectra.spectrum_synthesis(lines, domains, nucleus="1H", points=points).toPandas()
    x = np.arange(points) * (10 / (points - 1))
    counts = np.bincount(np.arange(n) % 997)
    y = sum(c * 1e-4 / ((x - i / 100) ** 2 + 1e-4) for i, c in enumerate(counts))
    own = drawn[drawn.spec_id == 1].sort_values("i")
    assert np.allclose(own.y, y / y.max(), atol=1e-9) and math.isclose(own.y.max(), 1.0)
    assert (drawn[drawn.spec_id == 2].y == 0).all() and len(drawn) == 2 * points
