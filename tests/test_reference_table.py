"""The growing reference table: batches, snapshots, and both at once."""

from concurrent.futures import ThreadPoolExecutor

from shiftframe.sources.reference import compact_reference, complete_folders, read_reference_table, upsert_reference

ROWS = "functional string, basis string, nucleus string, sigma double"


def added(spark, names, sigma):
    return spark.createDataFrame([(n, "b", "1H", sigma) for n in names], ROWS)


def values(df):
    return {r.functional: r.sigma for r in df.collect()}


def test_snapshots_give_what_the_batches_give(spark, tmp_path):
    path = str(tmp_path / "table")
    assert values(read_reference_table(spark, path)) == {}
    compact_reference(spark, path)
    assert values(read_reference_table(spark, path)) == {}
    upsert_reference(spark, path, added(spark, ["a", "b"], 1.0))
    upsert_reference(spark, path, added(spark, ["b", "c"], 2.0))
    compact_reference(spark, path)
    want = {"a": 1.0, "b": 1.0, "c": 2.0}
    table = read_reference_table(spark, path)
    assert values(table) == want and not any("/batches/" in f for f in table.inputFiles())
    assert values(upsert_reference(spark, path, added(spark, ["c", "d"], 3.0))) == {**want, "d": 3.0}
    compact_reference(spark, path)
    assert values(read_reference_table(spark, path)) == {**want, "d": 3.0}


def test_a_batch_that_ends_after_a_snapshot_counts(spark, tmp_path):
    path = str(tmp_path / "table")
    upsert_reference(spark, path, added(spark, ["a", "z"], 1.0), batch="0005")
    compact_reference(spark, path)
    added(spark, ["a", "b"], 9.0).write.parquet(f"{path}/batches/batch=0001")  # begun before, ended now
    assert values(read_reference_table(spark, path)) == {"a": 9.0, "b": 9.0, "z": 1.0}
    (tmp_path / "table/snapshots/9-broken/rows").mkdir(parents=True)  # a snapshot that was not finished
    assert values(read_reference_table(spark, path)) == {"a": 9.0, "b": 9.0, "z": 1.0}
    assert len(complete_folders(spark, f"{path}/batches")) == 2


def test_writers_and_compactions_at_once(spark, tmp_path):
    path = str(tmp_path / "table")
    upsert_reference(spark, path, added(spark, ["first"], 0.0))
    with ThreadPoolExecutor(4) as pool:
        runs = [pool.submit(upsert_reference, spark, path, added(spark, [f"w{i}", "both"], float(i))) for i in range(4)]
        runs += [pool.submit(compact_reference, spark, path) for _ in range(2)]
        for run in runs:
            run.result()
    compact_reference(spark, path)
    found = values(read_reference_table(spark, path))
    assert set(found) == {"first", "both", "w0", "w1", "w2", "w3"} and found["both"] in (0.0, 1.0, 2.0, 3.0)
