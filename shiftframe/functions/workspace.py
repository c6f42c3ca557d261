"""Where intermediate tables go: the shared folder named by the session."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
WAREHOUSE_SETTING = "spark.sql.warehouse.dir"

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, else a folder in its warehouse; both are shared by driver and executors.

    A warehouse on a local disk will do for a session that runs in one process only.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getConf().get(CHECKPOINT_SETTING)
    current = configured or spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    warehouse = spark.conf.get(WAREHOUSE_SETTING, None)
    own_disk = (warehouse or "file:").startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local[")
    if not warehouse or own_disk:
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that driver and executors share")
    return f"{warehouse.rstrip('/')}/_intermediate"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; it is removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(remove_made)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through the file system that Spark uses for it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def remove_made() -> None:
    """Delete every path handed out by ``new_path`` whose session still runs."""
    while _made:
        spark, path = _made.pop()
        if spark.sparkContext._jsc is not None:
            try:
                remove(spark, path)
            except Exception as error:  # noqa: BLE001 - the session may be closing; the folder is the caller's to clear
                print(f"left behind: {path} ({type(error).__name__})")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later plans see fixed rows."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
