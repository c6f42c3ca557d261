"""Work that must not grow faster than its table: parts by rows, columns and keys that travel, files and folders."""

import hashlib
from pathlib import Path

from pyspark.sql import functions as F

from shiftframe.functions import ranges, skew
from shiftframe.functions.parts import BYTES_PER_TASK, ROWS_PER_TASK, parts_by_size, parts_of
from shiftframe.operators import signals
from shiftframe.plans import pipelines
from shiftframe.plans.catalog import QUERIES
from shiftframe.plans.views import Views


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def usual(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_parts_grow_with_the_rows(spark):
    assert parts_of(spark, 0) == parts_of(spark, 5) == 1
    assert parts_of(spark, ROWS_PER_TASK * usual(spark) * 6) == usual(spark) * 6


def test_f6_ranges_grow_with_the_files(spark, tmp_path):
    spark.range(1_200_000).select((F.col("id") % 7).alias("k"), F.xxhash64("id").alias("v")).coalesce(2).write.parquet(f"{tmp_path}/a b")
    size = sum(p.stat().st_size for p in (tmp_path / "a b").glob("*.parquet"))
    rows = spark.read.parquet(f"{tmp_path}/a b")
    assert parts_by_size(rows, size // 9) in (9, 10)
    assert parts_by_size(rows, size) == parts_by_size(spark.range(9)) == usual(spark)
    assert ranges.in_ranges(rows.unionAll(rows), ["k"], [F.col("v")]).rdd.getNumPartitions() == max(usual(spark), -(-size // BYTES_PER_TASK))


def test_f6_sums_are_carried_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "parts_by_size", lambda *_: 9)
    rows = spark.range(500).select(F.when(F.col("id") < 400, 1).when(F.col("id") < 401, 2).alias("k"), F.col("id").alias("v"))
    got = {r.v: r.n for r in ranges.numbered(rows, ["k"], [F.col("v")], "n").collect()}
    assert got == {v: v + 1 if v < 400 else 1 if v == 400 else v - 400 for v in range(500)}


def test_f6_no_keys_are_written_where_no_bucket_is_large(spark, monkeypatch):
    def never(*_):
        raise AssertionError("keys were written")

    rows = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), "id")
    monkeypatch.setattr(skew, "materialize", never)
    small, large, count = skew.sized_split(rows, ["k"], 100)
    assert (small, large, count) == (rows, None, 300)
    monkeypatch.setattr(skew, "materialize", lambda df, name: df)
    small, large, count = skew.sized_split(rows.unionAll(rows.where("k is null")), ["k"], 100)
    assert (small.count(), large.count(), count) == (200, 200, 400)


def shifts(spark):
    rows = [(m, a, 3.0 - 0.1 * a, ("d", "t", "")[a % 3], 7.0) for m in (1, 2, None) for a in range(6)]
    return spark.createDataFrame(rows, "mol_id int, atom_index int, shift double, multiplicity string, coupling_hz double")


def test_f6_f12_f13_members_that_are_dealt_are_not_shuffled_again(spark, monkeypatch, capsys):
    monkeypatch.setattr(signals, "parts_of", lambda *_: 3)
    told = {}
    for dealt in (False, True):
        members = signals.signal_group(shifts(spark), nucleus="1H", dealt=dealt)
        stats = signals.signal_stats(members, nucleus="1H", with_atoms=True)
        told[dealt] = plan(stats, capsys).count("Exchange hashpartitioning"), sorted(map(str, stats.collect()))
        assert set(signals.OPTIONAL) < set(members.columns)
        assert "source_smiles" not in plan(members, capsys).split("MapInArrow")[-1]
    assert told[True][1] == told[False][1] and (told[True][0], told[False][0]) == (2, 3)


def test_f12_lines_are_made_once(spark, capsys):
    stats = signals.signal_stats(signals.signal_group(shifts(spark), nucleus="1H"), nucleus="1H")
    rows = signals.line_rows(signals.add_lines(stats, nucleus="1H"), keep=["signal_id"])
    assert plan(rows, capsys).count("transform(") == 1


def test_f10_f15_atoms_are_merged_in_the_tasks_that_predict_them(spark, tmp_path, capsys):
    rows = [(1, 1, 10.0, 0.1, 0.0), (1, 1, 9.0, 0.2, 0.1), (1, 2, 5.0, 0.0, 0.0), (None, 1, 4.0, 0.0, None)]
    table = "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double"
    spark.createDataFrame(rows, table).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert Views(spark, str(tmp_path)).predictions().rdd.getNumPartitions() == usual(spark)
    for key in ("consensus_std", "consensus_template"):
        assert plan(QUERIES[key](spark, str(tmp_path)), capsys).count("Exchange") == 1
    assert {(r.mol_id, r.atom_index) for r in QUERIES["consensus_std"](spark, str(tmp_path)).collect()} >= {(1, 0), (1, 1)}


def test_f7_one_folder_per_task_and_one_digest_per_file(spark, tmp_path, capsys):
    texts = {i: None if i == 3 else f"text {i}\nä" for i in range(70)}
    rows = spark.createDataFrame([*texts.items(), (None, "x")], "doc_id long, text string")
    rows.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob("bundles-*"))
    found = QUERIES["manifest_files"](spark, str(tmp_path))
    assert plan(found, capsys).count("MapInArrow") == 1
    (made,) = set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob("bundles-*")) - before
    assert len([p for p in made.iterdir() if p.is_dir()]) == 1
    want = {}
    for b in range(5):
        whole = "".join((texts[i] or "") + "\n" for i in range(b * 16, min(b * 16 + 16, 70))).encode()
        want[b] = (hashlib.sha256(whole).hexdigest(), "unlisted" if b == 0 else "ok", True, len(whole))
    assert found.columns == ["bundle", "sha256", "status", "accepted", "length"]
    assert {r.bundle: (r.sha256, r.status, r.accepted, r.length) for r in found.collect()} == want


def test_f14_targets_are_joined_once(spark, tmp_path, monkeypatch):
    written = []
    keep = pipelines.materialize
    monkeypatch.setattr(pipelines, "materialize", lambda df, name: written.append(name) or keep(df, name))
    sections = spark.createDataFrame([(1, 0, 30.0), (1, 1, 100.0)], "mol_id int, atom_index int, sigma double")
    target = "mol_id int, atom_index int, nucleus string, functional string, basis string"
    targets = spark.createDataFrame([(1, 0, "1H", "A", "b"), (1, 1, "13C", "A", "b"), (2, 0, "1H", "A", "b")], target)
    compounds = spark.createDataFrame([("a", "B", 1, 31.0), ("a", "B", 6, 188.0)], "functional string, basis string, atomic_num int, sigma double")
    done, status = pipelines.calibrate_logs(spark, sections, targets, compounds, f"{tmp_path}/reference")
    assert "targets" in written
    assert sorted((r.atom_index, r.shift_ppm) for r in done.collect()) == [(0, 1.0), (1, 88.0)]
    assert sorted((r.mol_id, r.status) for r in status.collect()) == [(1, "ok"), (2, "error")]


def test_f8_predictions_are_not_shuffled_again_by_atom(spark, tmp_path, monkeypatch, capsys):
    table = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    rows = [(m, n, 3 * m + n, m, 5.0, 10.0 * n + m, 0.1, 0.0, "A", "O") for m in (1, 2, 3) for n in (1, 2, 3)]
    spark.createDataFrame(rows, table).write.parquet(f"{tmp_path}/lineitem.parquet")
    plans = {}
    keep = pipelines.materialize
    monkeypatch.setattr(pipelines, "materialize", lambda df, name: plans.update({name: plan(df, capsys)}) or keep(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES["merge_engines"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the predictions reach the join by atom as they are, and are dealt by molecule after it
    assert plans["annotated"].index("hashpartitioning(mol_id") < plans["annotated"].index("_found")
