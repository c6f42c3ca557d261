"""Reference tables: reading the document form, and a table that only grows.

The table is a folder of ``batches``, one folder each, and of ``snapshots``. A snapshot holds the settled values of some
batches and their names. Readers take the newest complete snapshot and the batches that it does not name, so a batch
that ends while a snapshot is made is in the one or read next to it.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftframe.operators.calibration import method_key, missing_keys
from shiftframe.schemas import REFERENCE_DOCUMENT, REFERENCE_SIGMA


def path_exists(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def load_reference(spark: SparkSession, path: str, *, whole_files: bool = True) -> DataFrame:
    """Rows (functional, basis, nucleus, sigma) of documents {"functional|basis": {nucleus: sigma}}.

    A missing path is an empty table, and a document that cannot be parsed counts as empty. ``whole_files`` takes a
    file as one document, otherwise each line is one.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], REFERENCE_SIGMA)
    text = spark.read.text(path, wholetext=whole_files)
    methods = text.select(F.explode(F.from_json("value", REFERENCE_DOCUMENT)).alias("key", "values"))
    rows = methods.select(F.split("key", r"\|", 2).alias("key"), F.explode("values").alias("nucleus", "sigma"))
    return rows.select(
        method_key(F.get("key", F.lit(0))).alias("functional"),
        method_key(F.get("key", F.lit(1))).alias("basis"),
        "nucleus",
        "sigma",
    )


BATCH_ROWS = "functional string, basis string, nucleus string, sigma double, batch string"


def complete_folders(spark: SparkSession, path: str, done: str = "_SUCCESS") -> list[str]:
    """Names of the folders under ``path`` in which the mark ``done`` shows that writing has ended, in order."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    system = jvm_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(jvm_path(path)):
        return []
    names = [f.getPath().getName() for f in system.listStatus(jvm_path(path)) if f.isDirectory()]
    return sorted(n for n in names if system.exists(jvm_path(f"{path}/{n}/{done}")))


def _rows_and_names(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Rows with their batch of the newest snapshot and the complete batches after it, and the names of all of them."""
    snapshots = complete_folders(spark, f"{path}/snapshots", "included/_SUCCESS")
    rows, names = spark.createDataFrame([], BATCH_ROWS), []
    if snapshots:
        newest = f"{path}/snapshots/{snapshots[-1]}"
        rows = spark.read.schema(BATCH_ROWS).parquet(f"{newest}/rows")
        names = [r["batch"] for r in spark.read.schema("batch string").parquet(f"{newest}/included").collect()]
    later = [n for n in complete_folders(spark, f"{path}/batches") if n.removeprefix("batch=") not in set(names)]
    if later:
        folders = [f"{path}/batches/{n}" for n in later]
        rows = rows.unionByName(spark.read.schema(BATCH_ROWS).option("basePath", f"{path}/batches").parquet(*folders))
    return rows, names + [n.removeprefix("batch=") for n in later]


def _settled(rows: DataFrame) -> DataFrame:
    """One value per method and nucleus: that of the first batch by name, with the batch."""
    first = F.min_by(F.struct("sigma", "batch"), F.struct("batch", "sigma"))
    return rows.groupBy("functional", "basis", "nucleus").agg(first.alias("_f")).select(
        "functional", "basis", "nucleus", "_f.sigma", "_f.batch"
    )


def read_reference_table(spark: SparkSession, path: str) -> DataFrame:
    """The growing table, one value per method and nucleus: the one that was written first. No table has no rows."""
    return _settled(_rows_and_names(spark, path)[0]).drop("batch")


def compact_reference(spark: SparkSession, path: str) -> str:
    """Write a snapshot of the table as it is now and return its name. Batches and older snapshots stay for readers."""
    rows, names = _rows_and_names(spark, path)
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    _settled(rows).write.parquet(f"{path}/snapshots/{name}/rows")
    # the list of batches is written last: a snapshot without it does not count
    spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.parquet(f"{path}/snapshots/{name}/included")
    return name


def upsert_reference(spark: SparkSession, path: str, computed: DataFrame, *, batch: str | None = None) -> DataFrame:
    """Add the methods that the table does not have yet, as a batch, and return the table.

    Nothing is rewritten and every batch has a folder of its own, so additions made at the same time all survive; the
    reader settles double ones.
    """
    batch = batch or f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    known = read_reference_table(spark, path)
    rows = computed.select(
        method_key(F.col("functional")).alias("functional"),
        method_key(F.col("basis")).alias("basis"),
        "nucleus",
        F.col("sigma").cast("double").alias("sigma"),
    )
    fresh = rows.join(missing_keys(rows, known), ["functional", "basis"], "left_semi")
    fresh.write.parquet(f"{path}/batches/batch={batch}")
    return read_reference_table(spark, path)
