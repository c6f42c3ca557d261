"""Clustering of groups that are too large for one row.

The walk over a group is sequential only from one cluster to the next. Where a cluster begins fixes where it ends, and
every proton cluster spans more than the tolerance, so the number of rounds is bounded by the range of shifts over the
tolerance, whatever the number of rows. Within one round all blocks of a group are looked at in parallel:

1. count the atoms that are new since the start of the cluster, block by block, and add them up;
2. with these counts a block turns the running centre it receives into ``a * centre + b``; find a and b;
3. pass the centre through the blocks' (a, b), one row per block;
4. each block finds its first shift that is too far from the running centre.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftframe.functions.skew import bucket_of, numbered
from shiftframe.functions.workspace import materialize

BLOCK_ROWS = 65536
BUCKET_PPM = 0.001


def _placed(rows: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Rows with their place in the walk, their block and the last earlier place of the same atom (-1: none)."""
    payload = [c for c in rows.columns if c not in (*keys, "shift", "atom_index")]
    order = [F.col("shift").desc(), F.col("atom_index"), *[F.col(c) for c in payload]]
    placed = numbered(
        rows, keys, order, "walk_pos", start=0, bucket=bucket_of(F.col("shift"), BUCKET_PPM, descending=True)
    ).withColumn("_block", F.floor(F.col("walk_pos") / block_rows))
    placed = materialize(placed, "walk")
    atom = [*keys, "atom_index"]
    last = placed.groupBy(*atom, "_block").agg(F.max("walk_pos").alias("_end"))
    earlier = Window.partitionBy(*atom).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*atom, "_block", F.max("_end").over(earlier).alias("_carried"))
    inside = Window.partitionBy(*atom, "_block").orderBy("walk_pos")
    joined = placed.join(carried, [*atom, "_block"])
    before = F.coalesce(F.lag("walk_pos").over(inside), F.col("_carried"), F.lit(-1).cast("long"))
    return materialize(joined.withColumn("_before", before).drop("_carried"), "walk")


def _scanner():
    """Scan of one block; kept in a closure so that it travels to the workers by value."""

    def scan(block, start, n_in, center_in):
        import numpy as np

        block = block.sort_values("walk_pos")
        n = n_in + np.cumsum(block["_before"].to_numpy() < start)
        values = block["shift"].to_numpy()
        centers = np.empty(len(values))
        center = center_in
        for i, (value, count) in enumerate(zip(values.tolist(), n.tolist())):
            center = (center * (count - 1) + value) / count
            centers[i] = center
        return block, n, values, centers

    return scan


def walk_large(rows: DataFrame, keys: Sequence[str], tolerance: float, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Member rows of large groups, equal to folding each group from its highest shift down."""
    scan = _scanner()
    keys = list(keys)
    columns = [c for c in rows.columns if c not in keys]
    walk = _placed(rows, keys, block_rows)
    names = walk.columns
    kinds = {f.name: f.dataType for f in walk.schema.fields}
    key_fields = [T.StructField(k, kinds[k]) for k in keys]
    affine_type = T.StructType([*key_fields, T.StructField("_block", T.LongType()), T.StructField("_a", T.DoubleType()), T.StructField("_b", T.DoubleType())])
    center_type = T.StructType([*key_fields, T.StructField("_block", T.LongType()), T.StructField("_center_in", T.DoubleType())])
    break_type = T.StructType([*key_fields, T.StructField("_next", T.LongType())])
    member_type = T.StructType(
        [*walk.schema.fields, T.StructField("signal_no", T.IntegerType()), T.StructField("n_after", T.LongType()), T.StructField("center_after", T.DoubleType())]
    )

    def affine(block):
        # The centre leaving a block is linear in the centre entering it: two probes give both coefficients.
        start, n_in = int(block["_start"].iloc[0]), int(block["_n_in"].iloc[0])
        zero = scan(block, start, n_in, 0.0)[3][-1]
        out = block[[*keys, "_block"]].iloc[:1].copy()
        out["_a"], out["_b"] = scan(block, start, n_in, 1.0)[3][-1] - zero, zero
        return out

    def pass_center(blocks):
        blocks = blocks.sort_values("_block")
        centers, center = [], 0.0
        for a, b in zip(blocks["_a"].tolist(), blocks["_b"].tolist()):
            centers.append(center)
            center = a * center + b
        return blocks[[*keys, "_block"]].assign(_center_in=centers)

    def first_break(block):
        import numpy as np

        start, entering = int(block["_start"].iloc[0]), float(block["_center_in"].iloc[0])
        block, _, values, centers = scan(block, start, int(block["_n_in"].iloc[0]), entering)
        before = np.concatenate([[entering], centers[:-1]])
        place = block["walk_pos"].to_numpy()
        hit = np.flatnonzero((np.abs(before - values) > tolerance) & (place > start))
        out = block[keys].iloc[:1].copy()
        out["_next"] = [int(place[hit[0]])] if len(hit) else [None]
        out["_next"] = out["_next"].astype("Int64")
        return out

    def members_of(block):
        start = int(block["_start"].iloc[0])
        rest, n, _, centers = scan(block, start, int(block["_n_in"].iloc[0]), float(block["_center_in"].iloc[0]))
        return rest[names].assign(
            signal_no=rest["_no"].astype("int32"), n_after=n, center_after=centers
        )

    front = walk.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("_start"), F.lit(0).alias("_no"))
    front = materialize(front, "walk-front")
    finished: list[DataFrame] = []
    by_block = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    slim = walk.select(*keys, "_block", "walk_pos", "shift", "_before")
    while not front.isEmpty():
        ahead = slim.join(front, keys).where(F.col("walk_pos") >= F.col("_start"))
        fresh = ahead.groupBy(*keys, "_block").agg(F.count_if(F.col("_before") < F.col("_start")).alias("_fresh"))
        counts = fresh.select(*keys, "_block", F.coalesce(F.sum("_fresh").over(by_block), F.lit(0)).alias("_n_in"))
        counted = ahead.join(counts, [*keys, "_block"])
        centers = counted.groupBy(*keys, "_block").applyInPandas(affine, affine_type).groupBy(*keys).applyInPandas(
            pass_center, center_type
        )
        blocks = materialize(counts.join(centers, [*keys, "_block"]), "walk-blocks")
        ready = ahead.join(blocks, [*keys, "_block"])
        if tolerance == float("inf"):
            breaks = front.select(*keys, F.lit(None).cast("long").alias("_next"))
        else:
            breaks = ready.groupBy(*keys, "_block").applyInPandas(first_break, break_type).groupBy(*keys).agg(
                F.min("_next").alias("_next")
            )
        ended = materialize(front.join(breaks, keys), "walk-ends")
        finished.append(ended.join(blocks, keys))
        front = ended.where(F.col("_next").isNotNull()).select(
            *keys, F.col("_next").alias("_start"), (F.col("_no") + 1).alias("_no")
        )
    spans = finished[0]
    for part in finished[1:]:
        spans = spans.unionByName(part)
    last = F.coalesce("_next", F.lit(2**62))
    inside = (F.col("walk_pos") >= F.col("_start")) & (F.col("walk_pos") < last)
    placed = walk.join(spans, [*keys, "_block"]).where(inside)
    members = placed.groupBy(*keys, "_block", "_no").applyInPandas(members_of, member_type)
    return members.select(*keys, "walk_pos", *columns, "signal_no", "n_after", "center_after")
