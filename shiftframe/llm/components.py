"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe.functions.workspace import new_path, remove

MOST_ROUNDS = 64


def _contracted(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step; each row points from the larger to the smaller id."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(lowest, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: for every id on an edge ``a, b`` the smallest id that it reaches.

    Every round is written to the shared folder and replaces the one before; only its number of rows and a checksum
    come to the driver. Loops and repeated edges are allowed. No edges give no rows.
    """
    spark = edges.sparkSession
    current, held, before = edges.where(F.col("a") != F.col("b")).select("a", "b"), None, None
    for _ in range(MOST_ROUNDS):
        path = new_path(spark, "stars")
        _contracted(current).write.parquet(path)
        current = spark.read.schema(current.schema).parquet(path)
        mark = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if held:
            remove(spark, held)
        held = path
        if mark == before or not mark[0]:
            roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            return current.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
        before = mark
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
