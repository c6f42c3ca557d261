"""Molecule graphs as atom and bond tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftframe import constants as C
from shiftframe.functions.workspace import materialize



def target_atoms(atoms: DataFrame, *, nucleus: str = "nucleus", atomic_num: str = "atomic_num") -> DataFrame:
    """Atoms observed by the nucleus of their row; a molecule without any gives no rows."""
    observed = F.lit(None).cast("int")
    for name, number in C.NUCLEUS_ATOMIC_NUMBER.items():
        observed = F.when(F.col(nucleus) == name, number).otherwise(observed)
    return atoms.where(F.col(atomic_num) == observed)


def atom_map_reconcile(
    left: DataFrame, right: DataFrame, *, mol: str = "mol_id", atom: str = "atom_index", symbol: str = "symbol"
) -> DataFrame:
    """Per molecule: whether both tools list the same symbols at the same positions."""
    ours = left.select(mol, atom, F.col(symbol).alias("_a"), F.lit(True).alias("_in_a"))
    theirs = right.select(mol, atom, F.col(symbol).alias("_b"), F.lit(True).alias("_in_b"))
    both = ours.join(theirs, [mol, atom], "full_outer")
    same = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))
    return both.groupBy(mol).agg(
        F.bool_and(same).alias("accepted"), F.min(F.when(~same, F.col(atom))).alias("first_difference")
    )


def neighbors(bonds: DataFrame) -> DataFrame:
    """Both directions of every bond: (mol_id, atom_index, nbr, bond_idx)."""
    ends = F.array(F.struct(F.col("a").alias("atom_index"), F.col("b").alias("nbr")), F.struct(F.col("b").alias("atom_index"), F.col("a").alias("nbr")))
    return bonds.select("mol_id", "bond_idx", F.inline(ends))


def anchor_join(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Add ``anchor``: for a proton its first heavy neighbour in bond order, null for the rest."""
    heavy = atoms.where("atomic_num > 1").select("mol_id", F.col("atom_index").alias("nbr"))
    hydrogens = atoms.where("atomic_num = 1").select("mol_id", "atom_index")
    edges = neighbors(bonds).join(heavy, ["mol_id", "nbr"]).join(hydrogens, ["mol_id", "atom_index"], "left_semi")
    first = edges.groupBy("mol_id", "atom_index").agg(F.min_by("nbr", "bond_idx").alias("anchor"))
    return atoms.join(first, ["mol_id", "atom_index"], "left")


def carbon_neighbor_protons(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """For every carbon with carbon neighbours: protons on those neighbours (mol_id, anchor, neighbor_count).

    Two hops, but hydrogens are counted per atom first, so the second join moves one row per bond.
    """
    kinds = atoms.select("mol_id", F.col("atom_index").alias("nbr"), F.col("atomic_num").alias("nbr_z"))
    edges = neighbors(bonds).join(kinds, ["mol_id", "nbr"])
    hydrogens = edges.groupBy("mol_id", "atom_index").agg(F.count_if(F.col("nbr_z") == 1).alias("n_h"))
    carbons = atoms.where("atomic_num = 6").select("mol_id", "atom_index")
    carbon_edges = edges.where("nbr_z = 6").join(carbons, ["mol_id", "atom_index"], "left_semi")
    return (
        carbon_edges.select("mol_id", F.col("atom_index").alias("anchor"), F.col("nbr").alias("atom_index"))
        .join(hydrogens, ["mol_id", "atom_index"])
        .groupBy("mol_id", "anchor")
        .agg(F.sum("n_h").alias("neighbor_count"))
    )


def neighbor_protons(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Anchored protons with the number of protons on the carbon neighbours of a carbon anchor, else 0."""
    anchored = anchor_join(atoms, bonds).where(F.col("anchor").isNotNull())
    return anchored.join(carbon_neighbor_protons(atoms, bonds), ["mol_id", "anchor"], "left").withColumn(
        "neighbor_count", F.coalesce("neighbor_count", F.lit(0).cast("long"))
    )


def multiplicity_label(n: Column, is_aromatic: Column, is_sp3: Column) -> Column:
    first_order = F.lit("m")
    for count, label in C.MULTIPLICITY_BY_NEIGHBORS.items():
        first_order = F.when(n == count, label).otherwise(first_order)
    return F.when(n <= 0, "s").when(is_aromatic | ~is_sp3, "m").otherwise(first_order)


def estimated_coupling(n: Column, is_aromatic: Column, is_sp3: Column) -> Column:
    return F.when((n > 0) & is_sp3 & ~is_aromatic, F.lit(C.SP3_COUPLING_HZ))


def multiplicity_rule(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Anchored protons with group, multiplicity, coupling and neighbour count.

    One aggregation over the bonds tells each atom its protons and its first heavy neighbour. That is written once, as the
    second hop, the anchors and the protons all read it.
    """
    kinds = atoms.select("mol_id", F.col("atom_index").alias("nbr"), F.col("atomic_num").alias("nbr_z"))
    heavy = F.col("nbr_z") > 1
    seen = neighbors(bonds).join(kinds, ["mol_id", "nbr"]).groupBy("mol_id", "atom_index").agg(
        F.count_if(F.col("nbr_z") == 1).alias("n_h"),
        F.min_by(F.when(heavy, F.col("nbr")), F.when(heavy, F.col("bond_idx"))).alias("anchor"),
    )
    told = atoms.select("mol_id", "atom_index", "atomic_num", "is_aromatic", "is_sp3").join(seen, ["mol_id", "atom_index"], "left")
    told = materialize(told, "bonded-atoms")
    carbons = told.where("atomic_num = 6").select("mol_id", F.col("atom_index").alias("nbr"), "n_h")
    ahead = neighbors(bonds).join(carbons, ["mol_id", "nbr"]).groupBy("mol_id", F.col("atom_index").alias("anchor")).agg(F.sum("n_h").alias("_n"))
    anchors = told.where("atomic_num > 1").select(
        "mol_id", F.col("atom_index").alias("anchor"), F.col("atomic_num").alias("_z"), F.col("is_aromatic").alias("_aromatic"), F.col("is_sp3").alias("_sp3")
    )
    protons = told.where("atomic_num = 1").select("mol_id", "atom_index", "anchor")
    counted = protons.join(anchors.join(ahead, ["mol_id", "anchor"], "left"), ["mol_id", "anchor"]).withColumn(
        "neighbor_count", F.when(F.col("_z") == 6, F.coalesce("_n", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    )
    n, aromatic, sp3 = F.col("neighbor_count"), F.col("_aromatic"), F.col("_sp3")
    return counted.select(
        "mol_id",
        "atom_index",
        F.col("anchor").alias("attached_atom_index"),
        F.concat(F.lit("h@"), F.col("anchor").cast("string")).alias("assignment_group"),
        multiplicity_label(n, aromatic, sp3).alias("multiplicity"),
        estimated_coupling(n, aromatic, sp3).alias("coupling_hz"),
        "neighbor_count",
    )


def charge_spin(atoms: DataFrame, *, mol: str = "mol_id") -> DataFrame:
    """Total formal charge and spin multiplicity per molecule."""
    return atoms.groupBy(mol).agg(
        F.sum("formal_charge").alias("charge"), (F.sum("radicals") + 1).alias("spin_multiplicity")
    )


def pair_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for left, right in zip(a, b):
        total = total + (left - right) * (left - right)
    return F.sqrt(total)


def bond_distances(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Length of every bond."""
    ends = [
        atoms.select("mol_id", F.col("atom_index").alias(end), *[F.col(c).alias(f"_{c}{end}") for c in "xyz"])
        for end in ("a", "b")
    ]
    length = pair_distance([F.col(f"_{c}a") for c in "xyz"], [F.col(f"_{c}b") for c in "xyz"])
    joined = bonds.join(ends[0], ["mol_id", "a"]).join(ends[1], ["mol_id", "b"])
    return joined.select(*bonds.columns, length.alias("distance"))


CELL_LEVELS = 8
_ENDS = ["x", "y", "z", "_x", "_y", "_z"]


def _pairs_of_small(placed: DataFrame, keys: Sequence[str], atom: str) -> DataFrame:
    """All ordered pairs, an atom with itself included, of groups whose size is bounded."""
    others = placed.select(*keys, F.col(atom).alias("nbr"), *[F.col(c).alias(f"_{c}") for c in "xyz"])
    return placed.join(others, list(keys))


def _pairs_by_cell(placed: DataFrame, keys: Sequence[str], atom: str, cutoff: float, k: int) -> DataFrame:
    """Ordered pairs that can be among the ``k`` nearest, an atom with itself included, by cells of fitting size.

    Of atoms at one place only the first ``k + 1`` can be a neighbour of anything, because ties go by index. Space is
    cut into cells of the cutoff's size and of successive halves. An atom uses the finest cell around it that holds
    ``k`` others: those lie within the cell's diagonal, so farther ones need not be looked at, and two cells in every
    direction reach that far. Where no cell is full it looks in the adjoining cells of the cutoff's size.
    """
    spot = Window.partitionBy(*keys, "x", "y", "z").orderBy(atom)
    receivers = placed.withColumn("_n", F.row_number().over(spot)).where(F.col("_n") <= k + 1).drop("_n")
    axes = ["_cx", "_cy", "_cz"]

    def at_levels(rows: DataFrame, *columns) -> DataFrame:
        cells = [
            F.struct(
                F.lit(level).alias("_level"),
                *[F.floor(F.col(c) / (cutoff / 2**level)).cast("long").alias(axis) for c, axis in zip("xyz", axes)],
            )
            for level in range(CELL_LEVELS)
        ]
        return rows.select(*keys, *columns, F.inline(F.array(*cells)))

    full = at_levels(receivers).groupBy(*keys, "_level", *axes).count().where(F.col("count") > k)
    sized = (
        at_levels(placed, atom, "x", "y", "z")
        .join(full, [*keys, "_level", *axes], "left")
        .groupBy(*keys, atom, "x", "y", "z")
        .agg(F.coalesce(F.max(F.when(F.col("count").isNotNull(), F.col("_level"))), F.lit(0)).alias("_level"))
    )
    size = F.lit(cutoff) / F.pow(F.lit(2.0), F.col("_level"))
    diagonal = size * (3**0.5 * (1 + 1e-9))
    senders = sized.withColumn("_bound", F.when(F.col("_level") == 0, F.lit(cutoff)).otherwise(diagonal))
    reach = F.when(F.col("_level") == 0, 1).otherwise(2)
    steps = F.sequence(-reach, reach)
    for c, axis in zip("xyz", axes):
        senders = senders.withColumn(axis, F.explode(F.transform(steps, lambda d: F.floor(F.col(c) / size).cast("long") + d)))
    others = at_levels(receivers.withColumnsRenamed({"x": "_x", "y": "_y", "z": "_z", atom: "nbr"}).withColumns(
        {c: F.col(f"_{c}") for c in "xyz"}
    ), "nbr", "_x", "_y", "_z")
    distance = pair_distance([F.col(c) for c in "xyz"], [F.col(f"_{c}") for c in "xyz"])
    near = senders.join(others, [*keys, "_level", *axes]).where(
        (F.col(atom) != F.col("nbr")) & (distance <= F.col("_bound"))
    )
    own = placed.select(*keys, atom, F.col(atom).alias("nbr"), "x", "y", "z", *[F.col(c).alias(f"_{c}") for c in "xyz"])
    return near.select(*own.columns).unionByName(own)


def radius_neighbors(
    coords: DataFrame,
    *,
    cutoff: float,
    k: int,
    keys: Sequence[str] = ("mol_id",),
    atom: str = "atom_index",
    small_group: int = 64,
) -> DataFrame:
    """Ordered pairs (atom, nbr, distance, rank): the nearest ``k`` atoms closer than ``cutoff``, ties by index.

    Groups of up to ``small_group`` atoms are paired directly. Larger ones are cut into cells that fit how crowded they
    are, which spreads them over tasks and keeps the pairs per atom bounded. Every atom is also paired with itself, ranked after its
    neighbours; that pair stays, at distance 0 and rank 0, only where it comes first.
    """
    placed = coords.select(*keys, atom, "x", "y", "z")
    sizes = coords.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    sized = placed.join(sizes, list(keys))
    small = sized.where(F.col("_size") <= small_group).drop("_size")
    large = sized.where(F.col("_size") > small_group).drop("_size")
    columns = [*keys, atom, "nbr", *_ENDS]
    pairs = _pairs_of_small(small, keys, atom).select(*columns).unionByName(
        _pairs_by_cell(large, keys, atom, cutoff, k).select(*columns)
    )
    distance = pair_distance([F.col(c) for c in "xyz"], [F.col(f"_{c}") for c in "xyz"])
    close = pairs.select(*keys, atom, "nbr", distance.alias("distance")).where(F.col("distance") < cutoff)
    itself = F.col(atom) == F.col("nbr")
    nearest = Window.partitionBy(*keys, atom).orderBy(itself, "distance", "nbr")
    ranked = close.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= max(k, 1))
    return ranked.where(~itself | (F.col("rank") == 1)).withColumn("rank", F.when(itself, 0).otherwise(F.col("rank")))


def bond_key(bond_type: Column, conjugated: Column, in_ring: Column, symbol_a: Column, symbol_b: Column) -> Column:
    """Text key of a bond; the end symbols come sorted, so direction does not matter."""
    ends = F.array_join(F.array_sort(F.array(symbol_a, symbol_b)), "-")
    return F.concat_ws("|", bond_type, conjugated.cast("string"), in_ring.cast("string"), ends)


def keyed_bonds(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Bonds with their text key."""
    ends = [atoms.select("mol_id", F.col("atom_index").alias(e), F.col("symbol").alias(f"_{e}")) for e in ("a", "b")]
    key = bond_key(F.col("bond_type"), F.col("is_conjugated"), F.col("in_ring"), F.col("_a"), F.col("_b"))
    return bonds.join(ends[0], ["mol_id", "a"]).join(ends[1], ["mol_id", "b"]).select(
        *bonds.columns, key.alias("bond_key")
    )


def vocab_encode(rows: DataFrame, vocabulary: DataFrame, key: str, *, name: str = "token", unknown: str = "unk") -> DataFrame:
    """Add the class id of ``key``; keys outside the vocabulary get the id of ``unk``.

    ``vocabulary`` has (key, class_id). The id of ``unk`` is a scalar subquery.
    """
    ids = vocabulary.select(F.col("key").alias(key), F.col("class_id").alias("_id"))
    fallback = vocabulary.where(F.col("key") == unknown).agg(F.min("class_id")).scalar()
    return rows.join(ids, key, "left").select(*rows.columns, F.coalesce(F.col("_id"), fallback).alias(name))


def bond_feature_join(pairs: DataFrame, tokens: DataFrame, *, atom: str = "atom_index", nbr: str = "nbr") -> DataFrame:
    """Add the bond token of each ordered pair, 0 when the two atoms are not bonded."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    known = tokens.select("mol_id", low.alias("_low"), high.alias("_high"), F.col("token").alias("_token"))
    return (
        pairs.withColumn("_low", F.least(atom, nbr))
        .withColumn("_high", F.greatest(atom, nbr))
        .join(known, ["mol_id", "_low", "_high"], "left")
        .select(*pairs.columns, F.coalesce("_token", F.lit(0)).alias("bond_token"))
    )


def edge_gather(edges: DataFrame, nodes: DataFrame, value: str, *, end: str, name: str, node: str = "atom_index") -> DataFrame:
    """Copy a node value onto each edge from the node at its ``end`` column."""
    picked = nodes.select("mol_id", F.col(node).alias(end), F.col(value).alias(name))
    return edges.join(picked, ["mol_id", end])


def segment_reduce(
    rows: DataFrame, slots: DataFrame, value: str, *, keys: Sequence[str], how: Sequence[str] = ("sum",)
) -> DataFrame:
    """Reduce rows into the segments of ``slots``, one column per reducer (sum, mean, max, min); index -1 does not count.

    Empty segments are 0 for sum and mean and null for max and min.
    """
    reducers = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}
    reduced = rows.where(F.col(keys[-1]) != -1).groupBy(*keys).agg(*[reducers[h](value).alias(h) for h in how])
    filled = [F.coalesce(h, F.lit(0.0)).alias(h) if h in ("sum", "mean") else F.col(h) for h in how]
    return slots.select(*keys).join(reduced, list(keys), "left").select(*keys, *filled)


def prefix_offsets(
    graphs: DataFrame,
    *,
    graph: str = "mol_id",
    sizes: Sequence[str] = ("n_atoms",),
    partitions: int | None = None,
) -> DataFrame:
    """Add ``offset_<size>``: the total size of all graphs before this one in id order.

    The rows are dealt into ranges of about equal count, however the ids are spread, and written down, as the ranges
    come from a sample. The totals of the ranges, one row per partition, pass through an unpartitioned running sum; the
    rows themselves are summed range by range.
    """
    count = partitions or int(graphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = graphs.repartitionByRange(count, F.col(graph)).withColumn("_range", F.spark_partition_id())
    cut = materialize(dealt, "ranges")
    totals = cut.groupBy("_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sizes])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_range", *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_b_{s}") for s in sizes])
    inside = Window.partitionBy("_range").orderBy(graph).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(carried, "_range").select(
        *graphs.columns,
        *[(F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"_b_{s}")).alias(f"offset_{s}") for s in sizes],
    )


def shifted_index(index: Column, offset: Column) -> Column:
    """Index in the joined graph; -1 marks no index and stays."""
    return F.when(index == -1, index).otherwise(index + offset)
