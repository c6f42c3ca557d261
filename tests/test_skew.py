"""The paths for very large groups give what the ordinary paths give."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shiftframe import constants as C
from shiftframe.functions import ranges, skew
from shiftframe.functions.workspace import materialize
from shiftframe.operators import ensemble, graph, match, signals, spectra
from shiftframe.plans import queries_files
from shiftframe.plans.views import Views
from shiftframe.sources import coordinates, logs

FOLDER = "/root/testdata/sf0.001"


def rows(df, digits=9):
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v + 1e-11, digits)
        return v

    return sorted((tuple(cell(c) for c in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def one_hot(spark):
    """A third of all rows under one key, with ties."""
    random.seed(7)
    data = [(1 if i % 3 == 0 else i % 50 + 2, round(random.random() * 3, 2), i, i % 7) for i in range(900)]
    return spark.createDataFrame(data, "mol_id long, v double, id long, w long").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, NaN, both zeros and ties in the order column, and a null key."""
    values = [None, float("nan"), 0.0, -0.0, 1.5, 1.5, -2.0, None, float("nan"), 7.25]
    data = [(k, v, i, i % 3) for k in (1, 2, None) for i, v in enumerate(values * (3 if k == 1 else 1))]
    return spark.createDataFrame(data, "mol_id long, v double, id long, w long").cache()


@pytest.fixture(params=[1, 4, 40])
def range_count(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("descending", [False, True])
def test_numbered_and_running(one_hot, odd, range_count, descending):
    from pyspark.sql import Window

    order = [F.col("v").desc() if descending else F.col("v"), F.col("id")]
    window = Window.partitionBy("mol_id").orderBy(*order)
    for table in (one_hot, odd):
        plain = table.withColumn("n", F.row_number().over(window).cast("long"))
        assert rows(plain) == rows(ranges.numbered(table, ["mol_id"], order, "n"))
        upto = window.rowsBetween(Window.unboundedPreceding, 0)
        plain = table.select("*", F.sum("w").over(upto).alias("s"), F.count(F.lit(1)).over(upto).alias("c"))
        assert rows(plain) == rows(ranges.running(table, ["mol_id"], order, {"s": F.col("w"), "c": F.lit(1)}))


def test_running_with_nulls_and_doubles(spark, range_count):
    data = [(k, i, None if i % 4 == 0 else i / 8, None if i % 3 else i) for k in ("a", None) for i in range(30)]
    table = spark.createDataFrame(data, "k string, i long, d double, n int")
    got = ranges.running(table, ["k"], [F.col("i").desc()], {"sd": F.col("d"), "sn": F.col("n")})
    want, sums = [], {}
    for k, i, d, n in sorted(data, key=lambda r: -r[1]):
        sd, sn = sums.get(k, (0.0, 0))
        sums[k] = sd + (d or 0.0), sn + (n or 0)
        want.append((d, i, k, n, *sums[k]))
    assert rows(got) == sorted(want, key=str)
    assert rows(ranges.numbered(table.where("false"), ["k"], [F.col("i")], "at")) == []


def test_ranges_are_even_where_a_value_holds_a_third_of_the_rows(spark, range_count):
    data = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 40).alias("mol_id"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.rand(3)).alias("v"), "id",
    )
    sizes = [r["count"] for r in ranges.in_ranges(data, ["mol_id"], [F.col("v")]).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == range_count and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


def test_rank_conformers(odd, range_count):
    from pyspark.sql import Window

    table = odd.select("mol_id", F.col("id").alias("conf_id"), F.col("v").alias("energy_kcal"))
    window = Window.partitionBy("mol_id").orderBy("energy_kcal", "conf_id")
    assert rows(ensemble.rank_conformers(table)) == rows(table.withColumn("rank", F.row_number().over(window)))


def test_integral_curve(one_hot, range_count):
    table = one_hot.select("mol_id", F.col("v").alias("center"), F.col("id").alias("pos"), F.col("w").alias("integration"))
    got = signals.integral_curve(table, low=0.5, high=8.0)
    want = []
    for mol in {r["mol_id"] for r in table.collect()}:
        own = sorted((r for r in table.where(F.col("mol_id") == mol).collect()), key=lambda r: (-r["center"], r["pos"]))
        total, reached = sum(r["integration"] for r in own), 0
        height = lambda s: s / total * C.INTEGRAL_AMPLITUDE + C.INTEGRAL_BASELINE
        points = [(8.0, C.INTEGRAL_BASELINE)]
        for r in own:
            before, reached = reached, reached + r["integration"]
            shoulder = C.INTEGRAL_SHOULDER_PPM
            points += [(min(8.0, r["center"] + shoulder), height(before)), (r["center"], height(before))]
            points += [(r["center"], height(reached)), (max(0.5, r["center"] - shoulder), height(reached))]
        points.append((0.5, C.INTEGRAL_BASELINE + C.INTEGRAL_AMPLITUDE))
        want += [(mol, i, round(x + 1e-11, 9), round(y + 1e-11, 9)) for i, (x, y) in enumerate(points) if total > 0]
    assert rows(got) == sorted(want, key=str)


def slow_sections(lines):
    """One log after the other, line by line."""
    import re

    found, table, opened, titled = {}, {}, None, False
    for line in lines:
        if m := re.search(C.LOG_HEADER_PATTERN, line):
            opened = int(m[1])
        elif m := re.search(C.LOG_VALUE_PATTERN, line):
            if opened is not None:
                found[opened] = float(m[1])
            opened = None
        elif any(t in line.upper() for t in C.LOG_TABLE_TITLES):
            titled = True
        elif titled and (m := re.search(C.LOG_TABLE_ROW_PATTERN, line)):
            table[int(m[1])] = float(m[3])
    return found or table


def drawn_logs(seed, files, length):
    draw = random.Random(seed)
    title = C.LOG_TABLE_TITLES[0]
    logs_ = []
    for f in range(files):
        values = f % 3
        kinds = ["header", "value", "noise", "title", "row", "row"] if values else ["header", "noise", "noise", "title", "row", "row", "row"]
        text = []
        for _ in range(draw.randint(0, length)):
            n, x = draw.randint(0, 9), f"{draw.randint(1, 99)}.{draw.randint(100, 999)}"
            text.append({
                "header": f" Nucleus  {n} H :", "value": f"   Isotropic shielding:    {x} ppm", "noise": "cycle done", "title": title,
                "row": f"  {n}  H  {x}  1.5",
            }[draw.choice(kinds)])
        logs_.append(text)
    return logs_


@pytest.mark.parametrize("block_lines", [1, 2, 5, 1000])
def test_log_sections(spark, block_lines):
    texts = drawn_logs(block_lines, 40, 30)
    data = [(f, i, t) for f, text in enumerate(texts) for i, t in enumerate(text)]
    lines = spark.createDataFrame(data, "file_id long, line_no long, line string").repartition(5)
    got = {(r.file_id, r.atom_index): r.sigma for r in logs.log_sections(lines, block_lines=block_lines).collect()}
    assert got == {(f, a): v for f, text in enumerate(texts) for a, v in slow_sections(text).items()} and got


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_log_files_split_over_blocks(spark, tmp_path, batch):
    texts = drawn_logs(3, 9, 400)
    for f, text in enumerate(texts):
        (tmp_path / f"{f}.log").write_text("\n".join([*text, ""]))
    settings = {"spark.sql.files.maxPartitionBytes": "1500", "spark.sql.files.openCostInBytes": "1", "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        assert logs.read_lines(spark, str(tmp_path)).select("block_start").distinct().count() > 3
        found = logs.read_log_sections(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {(int(r.file_id.rsplit("/", 1)[1].split(".")[0]), r.atom_index): r.sigma for r in found}
    assert got == {(f, a): v for f, text in enumerate(texts) for a, v in slow_sections(text).items()}


def test_broken_log_line(spark):
    text = [" Nucleus  99999999999 H :", "   Isotropic:  1.5", " Nucleus  3 H :", "   Isotropic shielding:   2.5 ppm"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "file_id long, line_no long, line string")
    assert [(r.atom_index, r.sigma) for r in logs.log_sections(lines).collect()] == [(3, 2.5)]


def test_rows_without_a_number_have_no_signal(spark):
    data = [(1, i, v, "g") for i, v in enumerate([1.0, None, float("nan"), 1.05, 3.0, 1.1, 0.2])]
    table = spark.createDataFrame(data, "mol_id long, atom_index int, shift double, assignment_group string")
    keep = ["walk_pos", "atom_index", "signal_no", "center_after"]
    folded, walked = (rows(signals.signal_group(table, nucleus="1H", fold_rows=n, block_rows=2).select(*keep)) for n in (100, 2))
    assert folded == walked and len(folded) == 5


@pytest.mark.parametrize("repeats", [False, True])
def test_signal_walk(spark, repeats):
    random.seed(11)
    data = []
    for i in range(160):
        atom = random.randrange(12) if repeats else i
        value = random.choice([round(random.random() * 0.6, 2), round(random.random() * 0.2, 3)])
        data.append((1, atom, value, "g", random.choice(["s", "d", None]), 7.0))
    data += [(2, i, i * 0.1, "g", "t", None) for i in range(5)]
    table = spark.createDataFrame(
        data, "mol_id long, atom_index int, shift double, assignment_group string, multiplicity string, coupling_hz double"
    )
    for nucleus in ("1H", "13C"):
        folded = signals.signal_group(table, nucleus=nucleus)
        walked = signals.signal_group(table, nucleus=nucleus, fold_rows=10, block_rows=16)
        keep = ["mol_id", "walk_pos", "shift", "signal_id", "n_after", "center_after"]
        assert rows(folded.select(*keep), 7) == rows(walked.select(*keep), 7)
        stats = [signals.signal_stats(m, nucleus=nucleus) for m in (folded, walked)]
        shown = ["signal_id", "center", "integration", "coupling_hz", "representative_atom_index"]
        assert rows(stats[0].select(*shown), 7) == rows(stats[1].select(*shown), 7)


def test_radius_neighbors(spark):
    random.seed(5)
    data = [(1, i, *[round(random.random() * 4, 1) for _ in "xyz"]) for i in range(150)]
    data += [(1, 150 + i, 1.5, 1.5, 1.5) for i in range(60)]
    data += [(1, 210 + i, *[round(random.random() * 0.2, 3) for _ in "xyz"]) for i in range(60)]
    data += [(1, 400, 90.0, 0.0, 0.0), (2, 0, 0.0, 0.0, 0.0), (2, 1, 0.0, 0.0, -1.0)]
    table = spark.createDataFrame(data, "mol_id long, atom_index int, x double, y double, z double")
    for cutoff, k in ((1.5, 3), (4.0, 10)):
        direct = graph.radius_neighbors(table, cutoff=cutoff, k=k, small_group=1000)
        cells = graph.radius_neighbors(table, cutoff=cutoff, k=k, small_group=0)
        assert rows(direct) == rows(cells)


def test_spectrum_chunks(spark):
    random.seed(3)
    data = [(s, round(random.random() * 9, 2), 1.0 + i % 3, 0.05) for s in (1, 2) for i in range(60 if s == 1 else 4)]
    lines = spark.createDataFrame(data, "spec_id long, shift double, intensity double, width double")
    domains = spectra.shared_domain(lines, lines, nucleus="1H")
    whole = spectra.spectrum_synthesis(lines, domains, nucleus="1H", points=64)
    cut = spectra.spectrum_synthesis(lines, domains, nucleus="1H", points=64, chunk_lines=7)
    assert rows(whole) == rows(cut)


def test_prefix_offsets(spark):
    random.seed(2)
    data = sorted((random.randrange(-(2**62), 2**62), i % 5) for i in range(3000))  # ids far apart
    want, total = [], 0
    for key, n in data:
        want.append((key, n, total))
        total += n
    sizes = spark.createDataFrame(random.sample(data, len(data)), "mol_id long, n_atoms long")
    for partitions in (1, 7):
        got = graph.prefix_offsets(sizes, partitions=partitions).select("mol_id", "n_atoms", "offset_n_atoms")
        assert sorted(tuple(r) for r in got.collect()) == want


def test_peak_match_bins(spark):
    v = Views(spark, FOLDER)
    half = F.col("half_width")
    lined = v.signals_1h().withColumn("lines", F.array(F.col("center") - half, F.col("center") + half))
    peaks = v.observed_peaks()
    assert rows(match.peak_match(lined, peaks)) == rows(match.peak_match(lined, peaks, bin_ppm=0.011))


def test_equal_signals_are_one(spark):
    same = spark.range(100_000).select(F.lit(1).alias("mol_id"), F.col("id").alias("pos"), F.lit(2.0).alias("center"), F.array(F.lit(2.0)).alias("lines"))
    peaks = spark.range(20_000).select(F.lit(1).alias("mol_id"), F.col("id").alias("peak_id"), (2 + F.col("id") % 7 / 1000).alias("ppm"))
    found = match.peak_match(same, peaks)
    assert found.count() == 20_000 and found.where("pos <> 0").count() == 0


def test_nucleus_per_row(spark):
    data = [(n, i, v, "g", n) for i, v in enumerate([1.0, 1.1, 9.0]) for n in ("1H", "13C", "77Se")]
    table = spark.createDataFrame(data, "mol_id string, atom_index int, shift double, assignment_group string, nucleus string")
    members = signals.per_nucleus(table, signals.signal_group, nuclei=("1H", "13C"))
    got = {(r.nucleus, r.n) for r in members.groupBy("nucleus").agg(F.count_distinct("signal_no").alias("n")).collect()}
    assert got == {("1H", 2), ("13C", 1), ("77Se", 1)}


@pytest.mark.parametrize("fold_rows", [1_000_000, 3])
def test_nuclei_share_one_plan(spark, fold_rows):
    data = [(n, i, v, g) for n in ("1H", "13C", None) for g in ("g", "k") for i, v in enumerate([1.0, 1.1, 9.0, 9.05, 20.0][: 5 if g == "g" else 2])]
    table = spark.createDataFrame(data, "nucleus string, atom_index int, shift double, assignment_group string")
    found = signals.signal_group(table, nucleus=F.col("nucleus"), scope=["nucleus"], fold_rows=fold_rows, block_rows=2)
    stats = signals.signal_stats(found, nucleus=F.col("nucleus"), scope=["nucleus"])
    apart = signals.per_nucleus(table, signals.signal_group, nuclei=("1H",), scope=[], fold_rows=1_000_000)
    wanted = signals.per_nucleus(apart, signals.signal_stats, nuclei=("1H",), scope=[])
    told = lambda df: sorted(((r.nucleus or "", r.signal_id, round(r.center, 9), r.integration or 0) for r in df.collect()))
    assert told(stats) == told(wanted) and len(told(stats)) == 8


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_partitions_do_not_matter(spark, partitions):
    import __spark_entry__ as entry

    keys = ("consensus", "signal_stats", "debounce")
    want = {k: rows(entry.queries()[k](spark, FOLDER)) for k in keys}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert {k: rows(entry.queries()[k](spark, FOLDER)) for k in keys} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_invariants(spark):
    import __spark_entry__ as entry

    used = entry.queries()["weights_used"](spark, FOLDER).where("engine IS NOT NULL").groupBy("mol_id").agg(F.sum("weight").alias("w"))
    assert used.where(F.abs(F.col("w") - 1) > 1e-5).count() == 0
    v = Views(spark, FOLDER)
    from shiftframe.operators.consensus import consensus

    ok = v.predictions().where("status = 'ok'")
    bounds = ok.groupBy("mol_id", "atom_index").agg(F.min("shift_ppm").alias("lo"), F.max("shift_ppm").alias("hi"))
    outside = consensus(ok).join(bounds, ["mol_id", "atom_index"]).where("shift_ppm < lo - 1e-9 OR shift_ppm > hi + 1e-9")
    assert outside.count() == 0
    total = entry.queries()["signal_stats"](spark, FOLDER).agg(F.sum("integration")).first()[0]
    assert total == v.protons().count()


def slow_match(signals_, peaks_):
    """Every peak with every signal of its molecule."""
    found = []
    for mol, peak, ppm in peaks_:
        scored = []
        for m, pos, center, lines in signals_:
            if m != mol:
                continue
            half, pad = C.HIGHLIGHT_HALF_WIDTH_PPM["1H"], C.HIGHLIGHT_PAD_1H_PPM
            low, high = (min(lines) - pad, max(lines) + pad) if lines else (center - half, center + half)
            outside = low - ppm if ppm < low else ppm - high if ppm > high else 0.0
            near = min([abs(x - ppm) for x in lines or ()] + [abs(center - ppm) * C.CENTER_DISTANCE_FACTOR])
            tolerance = min(C.MATCH_TOLERANCE_PPM["1H"], max(C.TOLERANCE_FLOOR_PPM[0], abs(high - low) * C.TOLERANCE_SPAN_FACTOR[0]))
            scored.append((near + outside * C.BOUNDARY_DISTANCE_FACTOR, pos, center, tolerance))
        if scored and min(scored)[0] <= min(scored)[3]:
            found.append((min(scored)[2], mol, peak, min(scored)[1], ppm, min(scored)[0]))
    return found


@pytest.mark.parametrize("bin_ppm", [None, 0.02])
def test_peak_match_against_brute_force(spark, bin_ppm):
    draw = random.Random(17)
    signals_, peaks_ = [], []
    for pos in range(150):
        center = round(draw.random() * 4, draw.choice([1, 2, 6]))
        lines = draw.choice([None, [], [center], [center - 0.01, center + 0.01], [center - 0.3, center, center + 0.2], [center + 0.4, center + 0.9]])
        signals_.append((draw.choice([1, 1, 2]), pos, center, lines))
    for i in range(400):
        peaks_.append((draw.choice([1, 2, 3]), i, round(draw.random() * 4.4 - 0.2, draw.choice([1, 2, 7]))))
    found = match.peak_match(
        spark.createDataFrame(signals_, "mol_id long, pos int, center double, lines array<double>"),
        spark.createDataFrame([*peaks_, (None, 900, 1.0), (1, 901, None), (1, 902, float("nan"))], "mol_id long, peak_id long, ppm double"),
        bin_ppm=bin_ppm,
    )
    cut = lambda r: tuple(round(x + 1e-11, 9) if isinstance(x, float) else x for x in r)
    assert rows(found) == sorted((cut(r) for r in slow_match(signals_, peaks_)), key=str)


def test_one_crowded_bin_is_matched_without_pairs(spark):
    import time

    n = 100_000
    signals_ = spark.range(n).select(F.lit(1).alias("mol_id"), "id", (2 + F.rand(1) / 20).alias("center")).select(
        "mol_id", F.col("id").alias("pos"), "center", F.array(F.col("center") - 0.001, F.col("center") + 0.001).alias("lines")
    )
    peaks_ = spark.range(n).select(F.lit(1).alias("mol_id"), F.col("id").alias("peak_id"), (2 + F.rand(2) / 20).alias("ppm"))
    start = time.perf_counter()
    found = match.peak_match(signals_.cache(), peaks_.cache())
    assert found.count() == n and time.perf_counter() - start < 60
    centers = sorted(r["center"] for r in signals_.collect())
    import bisect

    lines = sorted(x for c in centers for x in (c - 0.001, c + 0.001))
    for r in found.sample(0.005, seed=1).collect():
        i = bisect.bisect(lines, r.ppm)
        nearest = min(abs(x - r.ppm) for x in lines[max(i - 1, 0) : i + 1])
        assert r.score <= nearest + 1e-12


def test_lines_far_away_are_summed_by_cell(monkeypatch):
    """As exact as the sum over all lines and points, without visiting every point for every line."""
    draw = np.random.default_rng(5)
    n, m, low, step = 8192, 24_000, -1.0, 0.002
    center, height = draw.uniform(-4, 20, m), draw.uniform(0.1, 2, m)
    half = draw.choice([0.001, 0.03, 0.2, 6.0], m)
    visited, near = [], spectra._add_near

    def counted(y, x, c, *given):
        visited.append(len(x) * len(c))
        near(y, x, c, *given)

    monkeypatch.setattr(spectra, "_add_near", counted)
    y = np.zeros(n)
    spectra._add_lines(y, low, step, center, height, half)
    x = low + np.arange(n) * step
    want = sum(h * g * g / ((x - c) ** 2 + g * g) for c, h, g in zip(center, height, half))
    assert np.abs(y / want - 1).max() < 1e-12 and sum(visited) < n * m / 2
    for few in (0, 1, 9):
        y = np.zeros(n)
        spectra._add_lines(y, low, 0.0, center[:few], height[:few], half[:few])
        assert y == pytest.approx(float(np.sum(height[:few] * half[:few] ** 2 / ((low - center[:few]) ** 2 + half[:few] ** 2))), rel=1e-12)


def test_frames_inside_a_block_are_not_taken_apart(spark, tmp_path, monkeypatch):
    (tmp_path / "many.xyz").write_text("".join(f"2\nframe {n}\nC 0.0 0.0 {n}.0\nH 1.0 0.0 0.0\n" for n in range(500)))
    written = []

    def kept(df, name):
        written.append(materialize(df, name))
        return written[-1]

    monkeypatch.setattr(coordinates, "materialize", kept)
    frames = coordinates.read_frames(spark, str(tmp_path)).collect()
    assert sorted(r.content for r in frames) == sorted(f"2\nframe {n}\nC 0.0 0.0 {n}.0\nH 1.0 0.0 0.0" for n in range(500))
    assert [w.count() for w in written] == [500]


def test_responses_are_written_compressed_and_cut(spark, tmp_path, monkeypatch):
    rows_ = [(k, k % 7, k % 4 + 1, k * 1.5) for k in range(1, 41)]
    spark.createDataFrame(rows_, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(queries_files, "new_path", lambda session, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(queries_files, "RESPONSES_PER_FILE", 3, raising=False)
    found = queries_files.read_results(Views(spark, str(tmp_path)))
    assert found.where("shift_ppm is not null").select("mol_id").distinct().count() == 40
    files = [f for f in os.listdir(tmp_path / "responses") if f.startswith("part-")]
    assert len(files) >= 14 and all(f.endswith(".json.gz") for f in files)
