"""Time limits, stored results and readiness of engines."""

import time

import pytest
from pyspark.sql import functions as F

from shiftframe.operators.engine_apply import Engine, apply_engine, apply_engines, engine_roster, stored_engine

MOLECULES = "mol_id long, nucleus string, n_atoms int, s string"


def table(spark, rows):
    return spark.createDataFrame(rows, MOLECULES)


@pytest.mark.parametrize("wait", ["sleep", "loop"])
def test_a_prediction_past_its_limit_is_an_error(spark, wait):
    def predict(molecule, nucleus):
        if molecule["s"] == "hang":
            end = time.monotonic() + 60
            while time.monotonic() < end:
                if wait == "sleep":
                    time.sleep(30)
        return [{"atom_index": 0, "symbol": "H", "shift_ppm": 1.0}]

    rows = table(spark, [(1, "1H", 2, "ok"), (2, "1H", 2, "hang"), (3, "1H", 2, "ok")]).coalesce(1)
    start = time.monotonic()
    found = {r.mol_id: r for r in apply_engine(rows, predict, engine="e", seconds=0.5).collect()}
    assert time.monotonic() - start < 30
    assert {m: r.status for m, r in found.items()} == {1: "ok", 2: "error", 3: "ok"} and "Reference ID" in found[2].message


def test_a_rerun_computes_only_what_is_missing(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def predict(molecule, nucleus):
        (calls / f"{molecule['mol_id']}-{nucleus}-{time.time_ns()}").touch()
        if molecule["s"] == "bad" and not (calls / "mended").exists():
            raise ValueError("bad")
        return [{"atom_index": i, "symbol": "H", "shift_ppm": float(i)} for i in range(molecule["n_atoms"])]

    def called():
        found = sorted(x.name.rsplit("-", 1)[0] for x in calls.iterdir() if x.name != "mended")
        for x in calls.iterdir():
            if x.name != "mended":
                x.unlink()
        return found

    store = str(tmp_path / "store")
    first = table(spark, [(1, "1H", 2, "a"), (1, "13C", 1, "a"), (2, "1H", 1, "bad"), (3, "1H", 0, "none")])
    shown = lambda df: sorted((r.mol_id, r.nucleus, r.status, r.atom_index is not None) for r in df.collect())
    want = [(1, "13C", "ok", True), (1, "1H", "ok", True), (1, "1H", "ok", True), (2, "1H", "error", False), (3, "1H", "ok", False)]
    assert shown(stored_engine(first, predict, store, engine="e")) == want and called() == ["1-13C", "1-1H", "2-1H", "3-1H"]
    more = first.unionByName(table(spark, [(4, "1H", 1, "a"), (4, "1H", 1, "a")]))
    assert shown(stored_engine(more, predict, store, engine="e")) == [*want, (4, "1H", "ok", True)] and called() == ["4-1H"]
    (calls / "mended").touch()
    again = stored_engine(more, predict, store, engine="e", retry_errors=True)
    assert {r.mol_id: r.status for r in again.collect()} == {i: "ok" for i in (1, 2, 3, 4)} and called() == ["2-1H"]
    assert shown(stored_engine(table(spark, [(2, "1H", 1, "bad")]), predict, store, engine="e")) == [(2, "1H", "ok", True)] and called() == []
    stored_engine(first, predict, store, engine="other").count()
    assert len(called()) == 4


def test_two_runs_at_once_leave_one_result_each(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def predict(molecule, nucleus):
        time.sleep(0.2)
        return [{"atom_index": 0, "symbol": "H", "shift_ppm": 1.0}]

    rows = table(spark, [(i, "1H", 1, "a") for i in range(4)])
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(lambda: stored_engine(rows, predict, str(tmp_path / "s"), engine="e").count()) for _ in range(2)]
        assert all(r.result() >= 4 for r in runs)
    assert stored_engine(rows, predict, str(tmp_path / "s"), engine="e").count() == 4


def test_readiness_has_a_reason(spark):
    def predict(molecule, nucleus):
        return [{"atom_index": 0, "symbol": "H", "shift_ppm": 1.0}]

    engines = {
        "cdk": Engine(predict, check=lambda: (True, None)), "orca": Engine(predict, check=lambda: (False, "no program")), "later": Engine(None),
        "off": Engine(predict, ready=False),
    }
    roster = {r.engine: r for r in engine_roster(spark, engines).collect()}
    assert [(n, roster[n].implemented, roster[n].ready, roster[n].message) for n in ("cdk", "later", "off", "orca")] == [
        ("cdk", True, True, None), ("later", False, False, "later engine not yet wired up."), ("off", True, False, None), ("orca", True, False, "no program"),
    ]
    assert roster["cdk"].default_weight == 0.5 and roster["later"].default_weight == 0
    asked = table(spark, [(1, "1H", 1, "a")]).withColumn("engines", F.array(*[F.lit(e) for e in ("orca", "cdk", "later", "off", "new")]))
    found = {r.engine: (r.engine_pos, r.status, r.message) for r in apply_engines(asked, engines).collect()}
    assert found["orca"] == (1, "pending", "no program") and found["cdk"] == (2, "ok", None)
    assert found["later"][1:] == ("pending", "later engine not yet wired up.") and found["off"][1] == "pending" and found["new"][1] == "error"
