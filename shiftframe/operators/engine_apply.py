"""User-supplied predictors over a table of molecules."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftframe.constants import DEFAULT_WEIGHTS, MESSAGE_ENGINE_FAILED, MESSAGE_ENGINE_PENDING
from shiftframe.functions.skew import join_on
from shiftframe.functions.text import reference_id
from shiftframe.schemas import SHIFT

Predict = Callable[..., Iterable[Mapping[str, Any]]]


def _runner(predict: Predict, engine: str, mol: str, nucleus: str, n_atoms: str, options: Mapping[str, Any], fields: Sequence[str], template: str,
            seconds: float | None, keep: Sequence[str]):
    """mapInPandas function. Everything it needs is in this closure and travels to the workers by value."""

    def run(batches: Iterator) -> Iterator:
        import contextlib
        import hashlib
        import signal

        import pandas as pd

        @contextlib.contextmanager
        def limited() -> Iterator[None]:
            """Raise in the running prediction when its time is up; a worker runs predictions in its main thread."""
            if seconds is None:
                yield
                return

            def stop(*_: Any) -> None:
                raise TimeoutError(f"no result after {seconds} seconds")

            before = signal.signal(signal.SIGALRM, stop)
            signal.setitimer(signal.ITIMER_REAL, seconds)
            try:
                yield
            finally:
                signal.setitimer(signal.ITIMER_REAL, 0)
                signal.signal(signal.SIGALRM, before)

        def outside(index: Any, count: int) -> bool:
            return not 0 <= index < count

        for batch in batches:
            rows: list[dict[str, Any]] = []
            for record in batch.to_dict("records"):
                header = {mol: record[mol], **{c: record[c] for c in keep}, "engine": engine}
                try:
                    with limited():
                        shifts = [dict(s) for s in predict(record, record[nucleus], **options)]
                    for s in shifts:
                        attached = s.get("attached_atom_index")
                        if outside(s["atom_index"], record[n_atoms]) or (
                            attached is not None and outside(attached, record[n_atoms])
                        ):
                            raise ValueError("atom index outside the molecule")
                except Exception:  # noqa: BLE001
                    token = hashlib.sha256(f"{record[mol]}|{engine}".encode()).hexdigest()[:12]
                    rows.append({**header, "status": "error", "message": template % (engine, token)})
                    continue
                rows.extend({**header, "status": "ok", **s} for s in shifts)
                if not shifts:
                    rows.append({**header, "status": "ok"})
            frame = pd.DataFrame(rows, columns=[mol, *keep, "engine", "status", "message", *fields], dtype=object)
            yield frame.where(frame.notna(), None)

    return run


def apply_engine(
    molecules: DataFrame,
    predict: Predict,
    *,
    engine: str,
    options: Mapping[str, Any] | None = None,
    mol: str = "mol_id",
    nucleus: str = "nucleus",
    n_atoms: str = "n_atoms",
    seconds: float | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Run ``predict(molecule, nucleus, **options)`` on every row and return its shifts in long form.

    A molecule whose prediction fails, or names an atom it does not have, becomes one row with status ``error`` and a
    reference id; nothing of the failure itself is shown and the job goes on. An ok molecule without shifts keeps one
    row without an atom. A prediction that takes longer than ``seconds`` fails; one that never leaves compiled code is
    stopped when it returns to Python. A slow set-up belongs in a lazily filled default argument of ``predict``: a worker keeps it.
    """
    schema = T.StructType(
        [
            *[T.StructField(name, molecules.schema[name].dataType) for name in (mol, *keep)],
            *[T.StructField(name, T.StringType()) for name in ("engine", "status", "message")],
            *SHIFT.fields,
        ]
    )
    names = [f.name for f in SHIFT.fields]
    run = _runner(predict, engine, mol, nucleus, n_atoms, dict(options or {}), names, MESSAGE_ENGINE_FAILED, seconds, list(keep))
    return molecules.mapInPandas(run, schema)


RESULT_STORE = "batch"


def read_results(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Rows of the result store; of results stored twice for a key the first good one, else the first failed one.

    No store gives no rows.
    """
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    batch = T.StructField(RESULT_STORE, T.StringType())
    stored = spark.read.schema(T.StructType([*schema.fields, batch])).parquet(path)
    order = F.struct((F.col("status") != "ok").alias("failed"), F.col(RESULT_STORE).alias("batch"))
    first = stored.groupBy(*keys).agg(F.min(order).alias("_first"))
    kept = join_on(stored, first, keys)
    return kept.where(F.col(RESULT_STORE) == F.col("_first.batch")).select(*schema.names)


def stored_engine(
    molecules: DataFrame,
    predict: Predict,
    path: str,
    *,
    engine: str,
    mol: str = "mol_id",
    nucleus: str = "nucleus",
    retry_errors: bool = False,
    **given: Any,
) -> DataFrame:
    """Rows of ``apply_engine`` with the nucleus, from the store of ``engine`` under ``path``; only molecules that it
    lacks are computed, and added.

    A result belongs to (mol, nucleus); other options need another path. Molecules are written in one batch, so a run
    that fails adds nothing, and of two runs at once that compute the same molecule one result counts. With
    ``retry_errors`` failed results count as lacking.
    """
    spark, keys = molecules.sparkSession, [mol, nucleus]
    own = dict(engine=engine, mol=mol, nucleus=nucleus, keep=[nucleus], **given)
    schema = apply_engine(molecules, predict, **own).schema
    folder = f"{path}/{engine}"
    known = read_results(spark, folder, schema, keys)
    held = (known.where("status = 'ok'") if retry_errors else known).select(*keys).distinct()
    missing = join_on(molecules, held, keys, "left_anti").dropDuplicates(keys)
    batch = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    # a folder of its own for each batch: runs at once do not meet
    apply_engine(missing, predict, **own).write.parquet(f"{folder}/{RESULT_STORE}={batch}")
    return join_on(read_results(spark, folder, schema, keys), molecules.select(*keys).distinct(), keys, "left_semi")


@dataclass(frozen=True)
class Engine:
    """A predictor under a name. One that is not ready answers every request with status ``pending``.

    ``check`` says at any time whether the engine is ready and why not; without it ``ready`` holds. Its predictions fail
    after ``seconds``.
    """

    predict: Predict | None
    ready: bool = True
    options: Mapping[str, Any] = field(default_factory=dict)
    check: Callable[[], tuple[bool, str | None]] | None = None
    seconds: float | None = None

    def readiness(self) -> tuple[bool, str | None]:
        if self.predict is None:
            return False, None
        return (self.ready, None) if self.check is None else self.check()


def engine_roster(spark: SparkSession, engines: Mapping[str, Engine], *, defaults: Mapping[str, float] = DEFAULT_WEIGHTS) -> DataFrame:
    """(engine, default_weight, implemented, ready, message) of every registered engine; the message says why it is not
    ready. An engine without a default weight has weight 0."""
    rows = []
    for name, engine in sorted(engines.items()):
        ready, message = engine.readiness()
        if engine.predict is None:
            message = MESSAGE_ENGINE_PENDING % name
        rows.append((name, float(defaults.get(name, 0.0)), engine.predict is not None, ready, message))
    return spark.createDataFrame(rows, "engine string, default_weight double, implemented boolean, ready boolean, message string")


def apply_engines(molecules: DataFrame, engines: Mapping[str, Engine], *, wanted: str = "engines", mol: str = "mol_id", **names: str) -> DataFrame:
    """Run on every molecule the engines that its ``wanted`` array names: rows of ``apply_engine`` with ``engine_pos``.

    ``engine_pos`` is the place in the request, from 1. An engine that is registered but not ready, or has no function,
    gives one pending row, with the reason if it has one; a name that is not registered gives one error row.
    """
    asked = molecules.select("*", F.posexplode(F.array_distinct(wanted)).alias("_at", "_engine")).withColumn("engine_pos", F.col("_at") + 1)
    places = asked.select(mol, F.col("_engine").alias("engine"), "engine_pos")
    state = {name: e.readiness() for name, e in engines.items()}
    ready = {name: e for name, e in engines.items() if state[name][0]}
    result = None
    for name, engine in ready.items():
        own = asked.where(F.col("_engine") == name).select(molecules.columns)
        rows = apply_engine(own, engine.predict, engine=name, options=engine.options, mol=mol, seconds=engine.seconds, **names)
        result = rows if result is None else result.unionByName(rows)
    others = places.where(~F.col("engine").isin(list(ready))) if ready else places
    pending = F.col("engine").isin(list(engines)) if engines else F.lit(False)
    why = F.lit(None).cast("string")
    for name, (_, message) in state.items():
        why = F.when(F.col("engine") == name, F.lit(message)).otherwise(why)
    waiting = others.select(
        mol, "engine",
        F.when(pending, "pending").otherwise("error").alias("status"),
        F.when(pending, F.coalesce(why, F.format_string(MESSAGE_ENGINE_PENDING, "engine")))
        .otherwise(F.format_string(MESSAGE_ENGINE_FAILED, "engine", reference_id(F.col(mol).cast("string"), F.col("engine")))).alias("message"),
    )
    result = waiting if result is None else result.unionByName(waiting, allowMissingColumns=True)
    return result.join(places, [mol, "engine"])
