"""Ordered work inside a group, without giving one task a group of unbounded size.

The order column of every group is cut into buckets. Each bucket is handled on its own, and a table of bucket totals,
one row per bucket, carries the state from bucket to bucket. There is one path for groups of every size, and nothing
runs while the plan is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftframe.functions.workspace import materialize

HASH_BUCKETS = 65536


def bucket_of(value: Column, width: float, *, descending: bool = False) -> Column:
    """Bucket of an order value, rising with ``value`` (or falling, for an order by ``value.desc()``).

    Nulls and NaN have buckets of their own, where Spark's ascending (nulls first, NaN last) or descending order
    (NaN first, nulls last) puts them. A bucket is never null, so it can be joined.
    """
    number = value.cast("double")
    null, nan = (2, 0) if descending else (0, 2)
    kind = F.when(value.isNull(), null).when(F.isnan(number), nan).otherwise(1)
    at = F.when(kind == 1, F.floor((-number if descending else number) / width)).otherwise(0)
    return F.struct(kind.alias("kind"), at.cast("long").alias("at"))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that takes nulls in the keys as equal; the keys come from ``left``."""
    named = right.select(*[F.col(k).alias(f"_right_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(named[f"_right_{i}"]) for i, k in enumerate(keys)])
    return left.join(named, same, how).drop(*[f"_right_{i}" for i in range(len(keys))])


def sized_split(df: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None, int]:
    """``split_hot`` and the number of all rows.

    Rows are first counted by a hash of their keys: where no such bucket is larger than ``hot_rows``, no group is, and keys
    are neither shuffled nor written.
    """
    buckets = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(HASH_BUCKETS)).alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = buckets.agg(F.sum("_rows"), F.max("_rows")).first()
    if (largest or 0) <= hot_rows:
        return df, None, total or 0
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows).select(*keys)
    hot = materialize(hot, "hot-keys")
    if hot.isEmpty():
        return df, None, total
    return join_on(df, hot, keys, "left_anti"), join_on(df, hot, keys, "left_semi"), total


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups up to ``hot_rows``, rows of larger groups or None), for work that needs another method then.

    Where a group may be that large the keys are counted and written down, at most rows / hot_rows of them. A null is a
    key like any other.
    """
    return sized_split(df, keys, hot_rows)[:2]


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: Mapping[str, Column], *, bucket: Column
) -> DataFrame:
    """Add inclusive running sums over each group in ``order``; ``bucket`` must rise with it (see ``bucket_of``)."""
    cut = df.withColumn("_bucket", bucket)
    totals = cut.groupBy(*keys, "_bucket").agg(*[F.sum(value).alias(f"_in_{name}") for name, value in sums.items()])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_in_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return join_on(cut, carried, [*keys, "_bucket"]).select(
        *df.columns,
        *[(F.sum(value).over(inside) + F.col(f"_before_{name}")).alias(name) for name, value in sums.items()],
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, *, start: int = 1, bucket: Column
) -> DataFrame:
    """Consecutive numbers from ``start`` within each group, in ``order``; ``bucket`` must rise with it."""
    counted = running(df, keys, order, {name: F.lit(1).cast("long")}, bucket=bucket)
    return counted.withColumn(name, F.col(name) + (start - 1))
