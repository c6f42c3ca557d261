"""Hard negatives by a vertical scan of the vectors' dimensions.

Vectors are held in blocks, one column per dimension. An anchor reads the columns of a block in order of its own
components' size and adds up each row's inner product; what the columns not yet read can still add lies between two
bounds from the columns' smallest and largest values. Rows that these bounds rule out leave the anchor's candidate
bitmap, and columns are read for the others only. A first scan finds each anchor's positives over all blocks. Their scores
fix exact windows, and a second scan finds the rows of other labels inside each window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shiftframe.functions.workspace import materialize

POSITIVES = 5
NEGATIVES = 5
LEAST_PERCENT = 80  # of the positive's score
SCALE = 256
ANCHOR_EVERY = 100
BLOCK_ROWS = 65_536
LEAST_BLOCKS = 16
GROUP_ANCHORS = 4096
COLUMNS_AT_ONCE = 8
LARGEST = float(1 << 62)  # a vector's own score from which on 64 bits may not hold its scores
SLACK = 2.0**-40  # share by which bounds, which are doubles, are widened
BLOCK_TYPE = "width int, block int, rows int, ids binary, labels binary, columns binary, low binary, high binary"


def longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


def participants(vectors: DataFrame, key: str, column: str, label: str) -> DataFrame:
    """``vec_id, label, v``: one row per id, components as whole numbers, labels after their change.

    Left out are rows with a null id, label or vector, with null or non-finite components, and with a score by
    themselves of 2^62 or more. Of rows with one id that with the smallest label, then vector, stays.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(column).alias("given"))
    odd = F.exists("given", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = rows.where("vec_id is not null and label is not null and given is not null").where(~odd)
    v = F.transform("given", lambda x: F.floor(x.cast("double") * SCALE).cast("double"))
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = sound.select("vec_id", changed.alias("label"), v.alias("v"))
    fits = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < LARGEST
    return whole.where(fits).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("own")).select("vec_id", "own.label", "own.v")


def vertical_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows of one length by hashed id in ``blocks`` blocks, each with one array per dimension and its bounds."""

    def build(key: tuple, group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("vec_id").to_numpy())
        ids, labels = (np.ascontiguousarray(group.column(c).to_numpy()[order]) for c in ("vec_id", "label"))
        width = key[0].as_py()
        flat = pa.concat_arrays(group.column("v").chunks).flatten().to_numpy() if width else np.zeros(0)
        columns = np.ascontiguousarray(flat.reshape(len(ids), width).astype(np.int64)[order].T)
        low, high = (f(axis=1) if width else np.zeros(0, dtype=np.int64) for f in (columns.min, columns.max))
        return pa.table({
            "width": [width], "block": [key[1].as_py()], "rows": [len(ids)],
            **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("ids", "labels", "columns", "low", "high"), (ids, labels, columns, low, high))},
        }).cast(pa.schema([("width", pa.int32()), ("block", pa.int32()), ("rows", pa.int32()), *[(n, pa.binary()) for n in ("ids", "labels", "columns", "low", "high")]]))

    placed = rows.withColumn("width", F.size("v")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return placed.groupBy("width", "block").applyInArrow(build, BLOCK_TYPE)


class Scan:
    """One anchor's way through one block: candidates (places in the block), their sums so far, and what is left."""

    def __init__(self, anchor: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, candidates: np.ndarray):
        self.anchor, self.columns = anchor, columns
        self.order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[self.order].astype(float)
        ends = np.stack([a * low[self.order], a * high[self.order]])
        self.least, self.most = (np.concatenate([f(ends, axis=0)[::-1].cumsum()[::-1], [0.0]]) for f in (np.minimum.reduce, np.maximum.reduce))
        self.slack = SLACK * np.abs(ends).max(axis=0, initial=0).sum()
        self.candidates, self.sums, self.read = candidates, np.zeros(len(candidates), dtype=np.int64), 0

    @property
    def open(self) -> bool:
        return self.read < len(self.order) and len(self.candidates) > 0

    def step(self) -> tuple[np.ndarray, np.ndarray]:
        """Read some columns; the bounds of every candidate's score."""
        at = self.order[self.read : self.read + COLUMNS_AT_ONCE]
        whole = len(self.candidates) == self.columns.shape[1]
        self.sums = self.sums + self.anchor[at] @ (self.columns[at] if whole else self.columns[np.ix_(at, self.candidates)])
        self.read += len(at)
        if self.read == len(self.order):
            return self.sums.astype(float), self.sums.astype(float)
        return self.sums + (self.least[self.read] - self.slack), self.sums + (self.most[self.read] + self.slack)

    def keep(self, mask: np.ndarray) -> None:
        if not mask.all():
            self.candidates, self.sums = self.candidates[mask], self.sums[mask]


def first(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` by falling score, then rising id."""
    return np.lexsort((ids, -scores))[:n]


def kth(values: np.ndarray, k: int) -> float:
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def scan_positives(scan: Scan, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the ``k`` candidates with the highest scores."""
    while scan.open:
        low, high = scan.step()
        if scan.read < len(scan.order):
            scan.keep(high >= kth(low, k))
    best = first(scan.sums, ids[scan.candidates], k)
    return ids[scan.candidates[best]], scan.sums[best]


def scan_window(scan: Scan, ids: np.ndarray, positives: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every positive's score (ids, scores) of the first ``k`` candidates inside its window.

    All windows share one candidate set: a row stays while some window may hold it and it may be among that window's
    first ``k``.
    """
    floor = [float(-((-LEAST_PERCENT * p) // 100)) for p in positives.tolist()]  # smallest whole score inside
    while scan.open:
        low, high = scan.step()
        if scan.read == len(scan.order):
            break
        needed = np.zeros(len(low), dtype=bool)
        for top, bottom in zip(positives.tolist(), floor):
            possible = (low <= top) & (high >= bottom)
            sure = low[possible & (high <= top) & (low >= bottom)]
            needed |= possible & (high >= kth(sure, k))
        scan.keep(needed)
    found = []
    for top in positives.tolist():
        inside = np.flatnonzero((scan.sums <= top) & (scan.sums >= -((-LEAST_PERCENT * top) // 100)))
        best = inside[first(scan.sums[inside], ids[scan.candidates[inside]], k)]
        found.append((ids[scan.candidates[best]], scan.sums[best]))
    return found


def by_block(blocks: DataFrame, anchors: DataFrame, groups: int, scan, schema: str) -> DataFrame:
    """Every block with every group of anchors of its length; ``scan(block, anchors)`` returns a table."""
    sent = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    places = blocks.select(F.col("width").alias("of_width"), F.col("block").alias("of_block"))
    wanted = anchors.withColumn("of_part", F.pmod(F.xxhash64("anchor_id"), F.lit(groups)).cast("int"))
    told = wanted.join(places, F.col("width") == F.col("of_width")).drop("width")
    empty = pa.schema([(n, pa.int64()) for n in (c.split(" ")[0] for c in schema.split(", "))]).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return empty
        row = left.to_pylist()[0]
        block = {c: longs(row[c]) for c in ("ids", "labels", "columns", "low", "high")}
        block["columns"] = block["columns"].reshape(row["width"], row["rows"])
        parts = [scan(block, anchor) for anchor in right.to_pylist()]
        return pa.concat_tables([p for p in parts if p is not None] or [empty])

    return sent.groupBy("width", "block", "part").cogroup(told.groupBy("of_width", "of_block", "of_part")).applyInArrow(run, schema)


def hard_negatives(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", *, every: int = ANCHOR_EVERY,
    positives: int = POSITIVES, negatives: int = NEGATIVES, block_rows: int = BLOCK_ROWS, least_blocks: int = LEAST_BLOCKS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, exact.

    Anchors are the rows whose id is divisible by ``every``; they meet all rows of their length, block by block.
    Rows with a null id, label or vector, with null or non-finite components, or with components so large that scores
    leave 64 bits take no part; of rows with one id the one with the smallest label, then vector, does. Vectors of
    different lengths are not compared. Equal scores go by the smaller id. A window without rows, an anchor without
    positives and an empty table give no rows. Other columns are not read.
    """
    rows = materialize(participants(vectors, key, column, label), "negatives-rows")
    blocks = materialize(vertical_blocks(rows, max(least_blocks, -(-rows.count() // block_rows))), "negatives-blocks")
    anchors = rows.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.transform("v", lambda x: x.cast("long")).alias("v"), F.size("v").alias("width")
    )
    anchors = materialize(anchors, "negatives-anchors")
    groups = max(1, -(-anchors.count() // GROUP_ANCHORS))

    def near(block: dict, anchor: dict) -> pa.Table | None:
        same = np.flatnonzero((block["labels"] == anchor["anchor_label"]) & (block["ids"] != anchor["anchor_id"]))
        scan = Scan(np.array(anchor["v"], dtype=np.int64), block["columns"], block["low"], block["high"], same)
        ids, scores = scan_positives(scan, block["ids"], positives)
        return pa.table({"anchor_id": np.full(len(ids), anchor["anchor_id"]), "positive_id": ids, "positive_score": scores})

    best = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    found = by_block(blocks, anchors, groups, near, "anchor_id long, positive_id long, positive_score long")
    chosen = found.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= positives).drop("_at")
    chosen = materialize(chosen, "negatives-positives")
    listed = chosen.groupBy("anchor_id").agg(F.array_sort(F.collect_set("positive_score")).alias("positives"))

    def window(block: dict, anchor: dict) -> pa.Table | None:
        other = np.flatnonzero(block["labels"] != anchor["anchor_label"])
        tops = np.array(anchor["positives"], dtype=np.int64)
        scan = Scan(np.array(anchor["v"], dtype=np.int64), block["columns"], block["low"], block["high"], other)
        parts = scan_window(scan, block["ids"], tops, negatives)
        n = [len(ids) for ids, _ in parts]
        return pa.table({
            "anchor_id": np.full(sum(n), anchor["anchor_id"]), "positive_score": np.repeat(tops, n),
            "negative_id": np.concatenate([ids for ids, _ in parts]), "negative_score": np.concatenate([s for _, s in parts]),
        })

    schema = "anchor_id long, positive_score long, negative_id long, negative_score long"
    inside = by_block(blocks, anchors.join(listed, "anchor_id"), groups, window, schema)
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = inside.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return chosen.join(ranked, ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


NEGATIVES_SQL = """
WITH parts AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), false)
),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM parts a JOIN parts b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS nth FROM scores WHERE same) WHERE nth <= 5
),
inside AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM inside WHERE rank <= 5
"""
