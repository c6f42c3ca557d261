"""Columns that are computed one time per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps use several times.

    The optimizer copies a projected expression into every place that uses it, also below filters, which repeats
    costly parsing. It does not do so across a generator, so the columns come out of one with a single row.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
