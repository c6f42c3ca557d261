"""Near-duplicate embeddings through a forest of random-projection trees with spill.

A tree splits along one random direction per level, at the middle of each node's values. Vectors near the middle go to
both sides, so a close pair is rarely parted, and the trees part different pairs. Vectors are compared within leaves,
every pair found is verified by its cosine, and links are united into components.

Splits part the pairs of a group that is dense, as its spread is no larger than the distance of a linked pair. Vectors
near the centre of such a group stay out of the forest; they are compared exactly, block by block, with all vectors that
can be linked to them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shiftframe.functions.workspace import materialize
from shiftframe.llm.components import components
from shiftframe.llm.text import small_or_shuffled
from shiftframe.llm.union import unite

LEAST_COSINE = 0.9
SPILL = 0.05  # vectors within this share of the middle, to either side, go to both children
LEAF_ROWS = 1024
SAMPLE_PER_LEAF = 32
SAMPLE_ROWS = 1_000_000  # most vectors that thresholds are fitted on
PAIR_KEPT = 0.92  # chance that a pair at cosine 0.9 stays together at one level with this spill
MISSED = 0.001  # wanted chance that no tree keeps a pair together
CORE_COSINE = 0.8  # vectors at least this near to the centre of a dense group are its core
DENSE_SAMPLE = 8  # sampled vectors near each other in one leaf that make a group dense
DENSE_SHARE = 0.25  # share of ``leaf_rows`` that a core is expected to have at least
BLOCK_ROWS = 4096
ROWS_AT_ONCE = 512
CORE_ROWS_AT_ONCE = 128
PAIRS_AT_ONCE = 8192


@dataclass
class Forest:
    """``directions[tree, level]`` and, per tree and node in heap order, the spill interval ``low..high``."""

    directions: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def leaves(self, x: np.ndarray) -> list[np.ndarray]:
        """Leaf numbers of every row of ``x``, in rising order, different trees having different numbers."""
        trees, levels = self.directions.shape[:2]
        rows, found = [], []
        for tree in range(trees):
            row, node = np.arange(len(x)), np.ones(len(x), dtype=np.int64)
            for level in range(levels):
                value = (x @ self.directions[tree, level])[row]
                left, right = value <= self.high[tree, node], value >= self.low[tree, node]
                row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows.append(row)
            found.append((tree << (levels + 1)) + node)
        row, leaf = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((leaf, row))
        return np.split(leaf[order], np.cumsum(np.bincount(row, minlength=len(x)))[:-1])


def plan_forest(n: int, leaf_rows: int = LEAF_ROWS) -> tuple[int, int]:
    """(levels, trees) for ``n`` vectors: leaves of about ``leaf_rows``, and trees enough to keep pairs together."""
    levels = max(0, int(np.ceil(np.log(max(n, 1) / leaf_rows) / np.log(1 / (0.5 + SPILL)))))
    together = PAIR_KEPT**levels
    return levels, 1 if not levels else int(np.ceil(np.log(MISSED) / np.log(1 - together)))


def fit_forest(sample: np.ndarray, levels: int, trees: int, seed: int = 7) -> Forest:
    """Thresholds from sampled unit vectors. A node without sample splits at zero."""
    random = np.random.default_rng(seed)
    directions = random.standard_normal((trees, levels, sample.shape[1]))
    low, high = np.zeros((trees, 1 << levels)), np.zeros((trees, 1 << levels))
    for tree in range(trees):
        row, node = np.arange(len(sample)), np.ones(len(sample), dtype=np.int64)
        for level in range(levels):
            value = (sample @ directions[tree, level])[row]
            order = np.argsort(node, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                if len(part):
                    low[tree, node[part[0]]], high[tree, node[part[0]]] = np.quantile(value[part], [0.5 - SPILL, 0.5 + SPILL])
            left, right = value <= high[tree, node], value >= low[tree, node]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
    return Forest(directions, low, high)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of extreme values stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def dense_centres(sample: np.ndarray, forest: Forest, least_core: float) -> np.ndarray:
    """Centres of the groups whose cores hold at least ``least_core`` of the sampled unit vectors.

    Looks within the sample's parts at the last level of the first tree at which parts have four times ``DENSE_SAMPLE``
    vectors or more.
    """
    levels = min(forest.directions.shape[1], max(0, int(np.log2(max(len(sample) / (4 * DENSE_SAMPLE), 1)))))
    leaves = Forest(forest.directions[:1, :levels], forest.low[:1], forest.high[:1]).leaves(sample)
    row, leaf = np.repeat(np.arange(len(sample)), [len(x) for x in leaves]), np.concatenate(leaves)
    order = np.argsort(leaf, kind="stable")
    found: list[tuple[int, np.ndarray]] = []
    for part in np.split(row[order], np.flatnonzero(np.diff(leaf[order])) + 1):
        x = sample[part]
        near = x @ x.T >= CORE_COSINE**2  # what two vectors of a core have that lie to different sides of the centre
        left = np.ones(len(x), dtype=bool)
        while (support := (near & left).sum(axis=1) * left).max() >= DENSE_SAMPLE:
            own = near[support.argmax()] & left
            found.append((int(own.sum()), x[own].mean(axis=0)))
            left &= ~own
    free = np.ones(len(sample), dtype=bool)
    centres: list[np.ndarray] = []
    for _, mean in sorted(found, key=lambda f: -f[0]):
        centre = mean / np.linalg.norm(mean)
        core = free & (sample @ centre >= CORE_COSINE)
        if core.sum() >= max(least_core, 1):
            centre = sample[core].mean(axis=0)
            centres.append(centre / np.linalg.norm(centre))
            free &= sample @ centres[-1] < CORE_COSINE
    return np.array(centres).reshape(len(centres), sample.shape[1])


def block_links(
    x: np.ndarray, nodes: np.ndarray, copies: np.ndarray, y: np.ndarray, others: np.ndarray, other_copies: np.ndarray,
    outside: np.ndarray, least: float,
) -> tuple[np.ndarray, np.ndarray]:
    """(links per row, labels) of core vectors ``x`` followed by vectors ``y`` of the group.

    Every core vector counts its links itself, so those of ``y`` count theirs only if ``outside`` of all cores.
    """
    labels, links = np.arange(len(x) + len(y)), np.zeros(len(x) + len(y), dtype=np.int64)
    for at in range(0, len(x), CORE_ROWS_AT_ONCE):
        here = slice(at, min(at + CORE_ROWS_AT_ONCE, len(x)))
        hit = (x[here] @ y.T >= least) & (nodes[here, None] != others)
        links[here] = hit @ other_copies
        links[len(x) :] += (copies[here] @ hit) * outside
        i, j = np.nonzero(hit & (labels[here, None] != labels[len(x) :]))
        labels = unite(labels, i + at, j + len(x))
    return links, labels


def core_links(routed: DataFrame, least: float) -> DataFrame:
    """``a, b, links`` of every pair with a core vector: blocks of a core against blocks of all that may link to it."""
    members = routed.select("node", "v", "copies", "core", F.explode("near").alias("centre"))
    sizes = members.groupBy("centre").agg(
        F.count(F.lit(1)).alias("members"), F.sum((F.col("core") == F.col("centre")).cast("long")).alias("cores")
    )
    blocks = sizes.where("cores > 0").select(
        "centre", *[F.ceil(F.col(c) / BLOCK_ROWS).cast("int").alias(f"{c}_blocks") for c in ("members", "cores")]
    )
    dealt = members.join(F.broadcast(blocks), "centre")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["node", "v", "copies", "core", "centre"]
    left = dealt.where("core = centre").select(*columns, place(F.col("cores_blocks")).alias("i"), whole("members_blocks").alias("j"))
    right = dealt.select(*columns, whole("cores_blocks").alias("i"), place(F.col("members_blocks")).alias("j"))

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "links")})
        x, y = (unit(np.stack(t.column("v").to_numpy()).astype(float)) for t in (left, right))
        nodes, others = left.column("node").to_numpy(), right.column("node").to_numpy()
        copies, other_copies = left.column("copies").to_numpy(), right.column("copies").to_numpy()
        links, labels = block_links(x, nodes, copies, y, others, other_copies, right.column("core").to_numpy() < 0, least)
        linked = np.flatnonzero((labels != np.arange(len(labels))) | (links > 0))
        node = np.concatenate([nodes, others])
        return pa.table({"a": node[linked], "b": node[labels[linked]], "links": links[linked]})

    keys = ["centre", "i", "j"]
    left, right = (t.select(*[F.col(c).alias(c) for c in t.columns]) for t in (left, right))  # columns of two tables now
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a long, b long, links long")


def leaf_links(x: np.ndarray, copies: np.ndarray, leaves: np.ndarray, leaf: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(links counted here per row, labels of groups) for the unit vectors of one leaf.

    ``leaves`` holds the leaf numbers of each row, filled up with -1. A pair is counted in the first leaf that it
    shares, so counts from all leaves add up without naming pairs.
    """
    labels, links = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    earlier = np.where((leaves >= 0) & (leaves < leaf), leaves, -1)
    earlier = earlier[:, (earlier >= 0).any(axis=0)]
    for at in range(0, len(x), ROWS_AT_ONCE):
        i, j = np.nonzero(x[at : at + ROWS_AT_ONCE] @ x[at:].T >= least)
        i, j = i + at, j + at
        i, j = i[i < j], j[i < j]
        labels = unite(labels, i, j)
        for p in range(0, len(i), PAIRS_AT_ONCE):
            a, b = i[p : p + PAIRS_AT_ONCE], j[p : p + PAIRS_AT_ONCE]
            seen = np.zeros(len(a), dtype=bool)
            for column in range(earlier.shape[1]):
                own = earlier[a, column]
                seen |= (own >= 0) & (earlier[b] == own[:, None]).any(axis=1)
            np.add.at(links, a[~seen], copies[b[~seen]])
            np.add.at(links, b[~seen], copies[a[~seen]])
    return links, labels


def link_vectors(
    vectors: DataFrame, key: str = "vec_id", column: str = "embedding", least: float = LEAST_COSINE,
    leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Equal vectors become one node first, so copies are never paired. The forest's thresholds are fitted on at most
    ``sample_rows`` different vectors, chosen by hash; every vector is indexed. Only that sample reaches the driver. Dense groups found in the sample are
    compared exactly, in a number of blocks that grows with the square of a group.
    Vectors of each length are a table of their own: more than ``leaf_rows`` different ones get a forest, fewer are
    compared all with all. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. A null id is no component: such rows get the smallest id that they reach, null if there
    is none, and are not kept. Repeated rows link with each other. An empty table gives no rows. Other columns are not
    read.
    """
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(column).alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = rows.where(F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))
    grouped = sound.groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    sizes = nodes.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("nodes")).where(F.col("nodes") > leaf_rows)
    forests: dict[int, Forest] = {}
    centres_of: dict[int, tuple[int, np.ndarray]] = {}  # number of the first centre, centres
    n_centres = 0
    for row in sizes.orderBy("width").collect():  # only lengths with more than a leaf of vectors
        width, levels, trees = row["width"], *plan_forest(row["nodes"], leaf_rows)
        wanted = min(sample_rows, SAMPLE_PER_LEAF << levels)
        own = nodes.where(F.size("v") == width)
        sample = own.orderBy(F.xxhash64("v"), "node").limit(wanted).select("v").toPandas()["v"]
        fitted = unit(np.stack(sample.to_numpy()).astype(float))
        forests[width] = fit_forest(fitted, levels, trees)
        centres = dense_centres(fitted, forests[width], max(DENSE_SAMPLE, DENSE_SHARE * leaf_rows * len(fitted) / row["nodes"]))
        if len(centres):
            fitted = fitted[(fitted @ centres.T).max(axis=1) < CORE_COSINE]
            forests[width] = fit_forest(fitted, levels, trees)
            centres_of[width] = n_centres, centres
            n_centres += len(centres)
    # an angle from the centre at which a vector may still be linked to one at the edge of the core
    widest = np.cos(min(np.arccos(CORE_COSINE) + np.arccos(np.clip(least, -1, 1)) + 1e-6, np.pi))

    def route(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        for batch in found:
            lists_of = batch.column(1)
            lengths = lists_of.value_lengths().to_numpy()
            leaves, near = [np.zeros(1, dtype=np.int64)] * len(batch), [none] * len(batch)
            core = np.full(len(batch), -1)
            for width in set(lengths.tolist()) & set(forests):
                at = np.flatnonzero(lengths == width)
                x = unit(np.stack(lists_of.take(pa.array(at)).to_numpy(zero_copy_only=False)).astype(float))
                own = forests[width].leaves(x)
                if width in centres_of:
                    begin, centres = centres_of[width]
                    cosine = x @ centres.T
                    inside = cosine.max(axis=1) >= CORE_COSINE
                    core[at] = np.where(inside, begin + cosine.argmax(axis=1), -1)
                    own = [none if dense else tree_leaves for tree_leaves, dense in zip(own, inside)]
                    for i, c in zip(at, cosine):
                        near[i] = begin + np.flatnonzero(c >= widest)
                for i, tree_leaves in zip(at, own):
                    leaves[i] = tree_leaves
            lists = [pa.array(z, pa.list_(pa.int64())) for z in (leaves, near)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists[0], pa.array(core, pa.int64()), lists[1]], names=["node", "v", "copies", "leaves", "core", "near"]
            )

    kind = nodes.schema["v"].dataType.simpleString()
    routed = nodes.select("node", "v", "copies").mapInArrow(
        route, f"node long, v {kind}, copies long, leaves array<long>, core long, near array<long>"
    )
    routed = materialize(routed, "routed-vectors") if n_centres else routed
    placed = routed.select("node", "v", "copies", "leaves", F.size("v").alias("width"), F.explode("leaves").alias("leaf"))

    def compare(leaf: tuple, group: pa.Table) -> pa.Table:
        x = unit(np.stack(group.column("v").to_numpy()).astype(float))
        lists = group.column("leaves").to_pylist()
        leaves = np.full((len(lists), max(map(len, lists))), -1, dtype=np.int64)
        for i, own in enumerate(lists):
            leaves[i, : len(own)] = own
        node = group.column("node").to_numpy()
        links, labels = leaf_links(x, group.column("copies").to_numpy(), leaves, leaf[1].as_py(), least)
        linked = np.flatnonzero((labels != np.arange(len(labels))) | (links > 0))
        return pa.table({"a": node[linked], "b": node[labels[linked]], "links": links[linked]})

    within = placed.groupBy("width", "leaf").applyInArrow(compare, "a long, b long, links long")
    found = materialize(within.unionByName(core_links(routed, least)) if n_centres else within, "leaf-links")
    counted = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "node")
    joined = components(found.select("a", "b")).withColumnRenamed("id", "node")
    smallest = joined.join(nodes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("least_id"))
    smallest = small_or_shuffled(smallest, "component-ids")
    named = (
        nodes.join(counted, "node", "left").join(joined, "node", "left").join(smallest, "component", "left")
        .select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least_id", "first_id").alias("component"))
    )
    component = F.coalesce("component", "vec_id")
    return rows.join(named, "v", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
