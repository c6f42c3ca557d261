"""Run registered queries next to their SQL twins: ``python tests/compare.py [scale] [key ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean",
         "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


def make_spark(partitions: int = 8, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("shiftframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value + 0.0, 6)
    return value


def _sorted(rows):
    return sorted((tuple(_cell(c) for c in r) for r in rows), key=lambda r: tuple((c is None, str(c)) for c in r))


def compare(spark: SparkSession, con, folder: str, key: str, run, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = run(spark, folder)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return len(got) > 0, f"{key}: rows only, {len(got)} rows, {took:.2f}s"
    start = time.time()
    relation = con.sql(sql)
    theirs = sorted(relation.columns)
    if columns != theirs:
        return False, f"{key}: columns {columns} vs {theirs}"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    other = {n: TYPES.get(str(t), str(t)) for n, t in zip(relation.columns, relation.types)}
    if types != other:
        return False, f"{key}: types " + str({n: (types[n], other[n]) for n in types if types[n] != other[n]})
    position = [relation.columns.index(c) for c in columns]
    want = [tuple(r[i] for i in position) for r in relation.fetchall()]
    took_sql = time.time() - start
    left, right = _sorted(got), _sorted(want)
    if left != right:
        if len(left) != len(right):
            a, b = set(left), set(right)
            return False, f"{key}: rows {len(left)} vs {len(right)}; {list(a - b)[:3]} vs {list(b - a)[:3]} in {columns}"
        wrong = [(x, y) for x, y in zip(left, right) if x != y]
        return False, f"{key}: {len(wrong)} of {len(left)} rows differ, {wrong[:3]} in {columns}"
    return True, f"{key}: ok, {len(left)} rows, {took:.2f}s (sql {took_sql:.2f}s)"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    scale = argv[1] if len(argv) > 1 else "0.001"
    folder = f"/root/testdata/sf{scale}"
    wanted = argv[2:]
    spark, con = make_spark(), open_tables(folder)
    bad = 0
    oracle = entry.oracle_sql()
    for key, run in entry.queries().items():
        if wanted and key not in wanted:
            continue
        try:
            ok, text = compare(spark, con, folder, key, run, oracle.get(key))
        except Exception as error:  # noqa: BLE001
            ok, text = False, f"{key}: {type(error).__name__} {str(error)[:1500]}"
        bad += not ok
        print(("  " if ok else "X ") + text, flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv))
