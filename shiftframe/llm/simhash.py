"""SimHash near-dedup: 64-bit fingerprints joined with themselves by walking a binary trie in pairs of nodes.

The upper part of the walk is a table: pairs of trie nodes with few differing bits, refined level by level while they
hold many fingerprints. Each pair that is small enough becomes one task, which walks the rest of the trie in numpy.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiftframe.functions.workspace import materialize
from shiftframe.llm.components import components
from shiftframe.llm.union import unite

SHINGLE = 3
SEED = 42
BUDGET = 3
LEAST_DEPTH = 4  # the table of node pairs begins at this depth, or deeper where nodes would be large
CELL_ROWS = 65_536  # fingerprints of a node, on average, where it begins
PAIR_ROWS = 262_144  # a pair of nodes with more fingerprints is refined further
LEVEL_BITS = 4
HASHES_AT_ONCE = 1 << 16
NODES_AT_ONCE = 1 << 18
COMPARE_AT_ONCE = 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a whole text, as an unsigned number: a bit is set if over half of the shingle hashes have it.

    Null and blank texts have the fingerprint zero; a text with fewer words than a shingle has one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(shingle, len(words))
    stops = ends[size - 1 :].tolist()
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(stops), HASHES_AT_ONCE):
        part = slice(at, at + HASHES_AT_ONCE)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[part], stops[part])], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(stops)).astype(np.uint8)
    return int(np.packbits(bits).view(">u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` for every row; ``fp`` holds the 64 bits as a signed long."""
    narrow = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            made = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["doc_id", "fp"])

    return narrow.mapInArrow(batches, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp long")


def _ones(values: np.ndarray, bit: int) -> np.ndarray:
    """Running count of ``bit`` (0 is the highest) before each place of sorted ``values``."""
    return np.concatenate([[0], np.cumsum((values >> np.uint64(63 - bit)) & np.uint64(1), dtype=np.int32)])


def trie_groups(left: np.ndarray, right: np.ndarray | None, depth: int, budget: int = BUDGET) -> np.ndarray:
    """Labels of ``left`` followed by ``right`` after joining all pairs within ``budget`` differing bits.

    Both are sorted, distinct and share their first ``depth`` bits each; ``right=None`` joins ``left`` with itself.
    A trie node is a range of the sorted array. A pair of nodes goes when its budget is used up, or when everything
    below it is in one group already, which cannot change the groups.
    """
    itself = right is None
    other = left if itself else right
    shift = 0 if itself else len(left)
    labels = np.arange(len(left) + (0 if itself else len(other)))
    if not len(left) or not len(other):
        return labels
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    start = int(np.bitwise_count((left[0] ^ other[0]) >> np.uint64(64 - depth))) if depth else 0
    first = [np.array([x]) for x in (0, len(left), 0, len(other), start)]
    stack = [(depth, first)]
    while stack:
        bit, nodes = stack.pop()
        if len(nodes[0]) > NODES_AT_ONCE:
            half = len(nodes[0]) // 2
            stack += [(bit, [x[half:] for x in nodes]), (bit, [x[:half] for x in nodes])]
            continue
        al, ah, bl, bh, used = nodes
        changes = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        one = (changes[ah - 1] == changes[al]) & (changes[shift + bh - 1] == changes[shift + bl])
        open_ = ~(one & (labels[al] == labels[shift + bl]))
        al, ah, bl, bh, used = (x[open_] for x in nodes)
        pairs = (ah - al) * (bh - bl)
        few = pairs <= COMPARE_AT_ONCE
        if few.any():
            n, width, i0, j0 = pairs[few], (bh - bl)[few], al[few], bl[few]
            which = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            i, j = i0[which] + step // width[which], j0[which] + step % width[which]
            close = np.bitwise_count(left[i] ^ other[j]) <= budget
            labels = unite(labels, i[close], shift + j[close])
            al, ah, bl, bh, used = (x[~few] for x in (al, ah, bl, bh, used))
        if not len(al):
            continue
        if bit not in ones:
            ones[bit] = (_ones(left, bit), _ones(other, bit))
        of_left, of_other = ones[bit]
        am, bm = ah - (of_left[ah] - of_left[al]), bh - (of_other[bh] - of_other[bl])
        twice = itself & (al == bl) & (ah == bh)
        below = []
        for lo_a, hi_a, lo_b, hi_b, more, mirrored in (
            (al, am, bl, bm, 0, False), (am, ah, bm, bh, 0, False), (al, am, bm, bh, 1, False), (am, ah, bl, bm, 1, True)
        ):
            keep = (hi_a > lo_a) & (hi_b > lo_b) & (used + more <= budget)
            if mirrored:
                keep &= ~twice
            below.append([x[keep] for x in (lo_a, hi_a, lo_b, hi_b, used + more)])
        stack.append((bit + 1, [np.concatenate(x) for x in zip(*below)]))
        if not len(stack[-1][1][0]):
            stack.pop()
    return labels


def _prefix(fp: Column, depth: int) -> Column:
    return F.shiftrightunsigned(fp, 64 - depth) if depth else F.lit(0).cast("long")


def _node_pairs(nodes: DataFrame, depth: int, budget: int) -> DataFrame:
    """Pairs ``p <= q`` of nodes at ``depth`` whose prefixes differ in at most ``budget`` bits."""
    masks = [sum(1 << b for b in bits) for n in range(min(budget, depth) + 1) for bits in itertools.combinations(range(depth), n)]
    asked = nodes.select(F.col("prefix").alias("p"), F.col("n").alias("n_p"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    asked = asked.withColumn("q", F.col("p").bitwiseXOR(F.col("mask"))).where("q >= p").drop("mask")
    return asked.join(nodes.select(F.col("prefix").alias("q"), F.col("n").alias("n_q")), "q")


def linked_fingerprints(distinct: DataFrame, budget: int = BUDGET, cell_rows: int = CELL_ROWS, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Edges ``a, b`` between different fingerprints ``fp`` that join all pairs within ``budget`` bits into groups.

    Of a group only the edges of a spanning forest are given, so a large group of near copies stays linear.
    """
    depth = max(LEAST_DEPTH, (distinct.count() // cell_rows).bit_length())
    open_pairs, tasks = None, []
    while True:
        nodes = distinct.groupBy(_prefix(F.col("fp"), depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
        if open_pairs is None:
            pairs = _node_pairs(nodes, depth, budget)
        else:
            child = nodes.withColumn("parent", F.shiftrightunsigned("prefix", LEVEL_BITS))
            x, y = (child.select(*[F.col(c).alias(f"{side}_{c}") for c in child.columns]) for side in "xy")
            pairs = open_pairs.join(x, F.col("p") == F.col("x_parent")).join(y, F.col("q") == F.col("y_parent"))
            pairs = pairs.where(
                (F.bit_count(F.col("x_prefix").bitwiseXOR(F.col("y_prefix"))) <= budget)
                & ((F.col("p") != F.col("q")) | (F.col("x_prefix") <= F.col("y_prefix")))
            ).select(F.col("x_prefix").alias("p"), F.col("x_n").alias("n_p"), F.col("y_prefix").alias("q"), F.col("y_n").alias("n_q"))
        pairs = materialize(pairs.select("p", "n_p", "q", "n_q"), "node-pairs")
        large = (F.col("n_p") + F.col("n_q") > pair_rows) & F.lit(depth + LEVEL_BITS <= 64)
        tasks.append((depth, pairs.where(~large).select("p", "q")))
        open_pairs = pairs.where(large)
        if open_pairs.isEmpty():
            break
        depth += LEVEL_BITS
    members = None
    for level, ready in tasks:
        ends = F.when(F.col("p") == F.col("q"), F.array("p")).otherwise(F.array("p", "q"))
        spread = ready.select(F.lit(level).alias("depth"), "p", "q", F.explode(ends).alias("prefix"))
        with_fp = spread.join(distinct.select("fp", _prefix(F.col("fp"), level).alias("prefix")), "prefix").drop("prefix")
        members = with_fp if members is None else members.unionByName(with_fp)

    def walk(key: tuple, group: pa.Table) -> pa.Table:
        level, p, q = (x.as_py() for x in key)
        values = np.sort(group.column("fp").to_numpy().view(np.uint64))
        if p == q:
            left, right = values, None
        else:
            of_p = (values >> np.uint64(64 - level)) == np.uint64(p % 2**64)
            left, right = values[of_p], values[~of_p]
        labels = trie_groups(left, right, level, budget)
        everyone = (left if right is None else np.concatenate([left, right])).view(np.int64)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.table({"a": everyone[moved], "b": everyone[labels[moved]]})

    return members.groupBy("depth", "p", "q").applyInArrow(walk, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET, shingle: int = SHINGLE
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document: the smallest id reachable over links of fingerprints.

    Equal fingerprints are one node, so copies are never paired. Null and blank texts share the fingerprint zero and
    link like any other. A null id gets a component too; it is null only if no member has an id. Repeated rows stay.
    An empty table gives no rows. Other columns are not read.
    """
    made = materialize(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    links = materialize(linked_fingerprints(distinct.select("fp"), budget), "fingerprint-links")
    joined = components(links).withColumnRenamed("id", "fp")
    grouped = joined.join(distinct, "fp")
    smallest = grouped.groupBy("component").agg(F.min("first_id").alias("least_id"))
    named = distinct.join(joined, "fp", "left").join(smallest, "component", "left").select(
        "fp", F.coalesce("least_id", "first_id").alias("component_id")
    )
    return made.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
