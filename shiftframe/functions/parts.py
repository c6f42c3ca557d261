"""How many tasks share a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What a task sorts, walks or aggregates at most, one large group aside.
ROWS_PER_TASK = 250_000
#: Below this a task is not worth its start.
LEAST_ROWS = 20_000
#: About as many rows of a narrow table in parquet files.
BYTES_PER_TASK = 4 << 20


def parts_of(spark: SparkSession, rows: int, most: int = ROWS_PER_TASK) -> int:
    """As many parts as the session's shuffles have, fewer for small tables, and more where a part would exceed ``most`` rows."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(usual, -(-rows // LEAST_ROWS)), -(-rows // most))


def parts_by_size(df: DataFrame, most: int = BYTES_PER_TASK) -> int:
    """As many parts as the session's shuffles have, and more where a part would exceed ``most`` bytes of the files that
    ``df`` reads. No job runs; rows that come from no file have the usual number."""
    spark = df.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return max(usual, -(-size // most))
