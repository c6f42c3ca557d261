"""Coordinate files in and calculation inputs out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiftframe import constants as C
from shiftframe.functions.once import once
from shiftframe.functions.ranges import changes
from shiftframe.functions.text import stripped
from shiftframe.functions.workspace import materialize
from shiftframe.sources.logs import read_lines

COUNT_LINE = r"^\s*\d+\s*$"

def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, content): coordinate files are small, so a file is a row and parsing never shuffles."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("content")
    )


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, frame_block, frame_place, content): the frames of coordinate files of any length, read line by line.

    A frame begins with the first line of its file, or with a line that is a whole number and does not follow such a
    line, which would make it the comment of its frame. Each block of a file is cut where it is read, and the frames
    that begin and end in it are whole there. What a block begins and ends with may be part of a frame of several blocks,
    which one row per block tells; only these pieces are shuffled. Only the lines of a frame come together in one row.
    """
    lines = read_lines(spark, path).select(
        "file_id", F.col("block_start").alias("block"), F.col("row_id").alias("place"), "line", F.col("line").rlike(COUNT_LINE).alias("count")
    )

    kinds = {"file_id": pa.string(), "block": pa.int64(), "place": pa.int64(), "frame": pa.int64(), "leads": pa.bool_(),
             "count": pa.bool_(), "ends_count": pa.bool_(), "closes": pa.bool_(), "line": pa.string()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[pa.Array, pa.Array] | None = None
        counted = False
        # the piece at the end of the batches so far: what is known of it, and its lines
        piece: list | None = None
        waiting: list[pa.Array] = []

        def told(closes: bool) -> pa.RecordBatch:
            text = "\n".join(value for part in waiting for value in part.to_pylist())
            values = [*piece, counted, closes, text]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds.values())], names=[*kinds])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = changes(batch.column("file_id"), last and last[0]) | changes(batch.column("block"), last and last[1])
            new[0] |= last is None
            place, count = batch.column("place").to_numpy(), batch.column("count").to_numpy(zero_copy_only=False)
            count = count | (new & (batch.column("block").to_numpy() == 0))  # a file's first line counts as one
            before = np.concatenate([[counted], count[:-1]])
            begins = count & ~before & ~new  # the first line of a block is judged when its neighbour is known
            starts = np.flatnonzero(begins | new)
            own = np.where(new, -1, place)
            first = int(starts[0]) if len(starts) else n
            if first:
                waiting.append(batch.column("line")[:first])
            if len(starts):
                if piece is not None:
                    counted = bool(before[first])
                    yield told(bool(new[first]))
                whole, ends = starts[:-1], starts[1:]
                if len(whole):
                    lines = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), batch.column("line"))
                    at = pa.array(whole)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(c).take(at) for c in ("file_id", "block", "place")], pa.array(own[whole]), pa.array(new[whole]),
                         pa.array(count[whole]), pa.array(count[ends - 1]), pa.array(new[ends]), pc.binary_join(lines, "\n")], names=[*kinds],
                    )
                final = int(starts[-1])
                piece = [*[batch.column(c)[final].as_py() for c in ("file_id", "block", "place")], int(own[final]), bool(new[final]), bool(count[final])]
                waiting = [batch.column("line")[final:]]
            last, counted = (batch.column("file_id")[-1:], batch.column("block")[-1:]), bool(count[-1])
        if piece is not None:
            yield told(True)

    schema = "file_id string, block long, place long, frame long, leads boolean, count boolean, ends_count boolean, closes boolean, line string"
    rows = materialize(lines.mapInArrow(cut, schema), "frame-pieces")
    edges = rows.groupBy("file_id", "block").agg(
        F.max(F.when(F.col("leads"), F.col("place"))).alias("first"),
        F.bool_or(F.col("leads") & F.col("count")).alias("leads_count"),
        F.max_by("ends_count", "place").alias("ends_count"),
        F.max("frame").alias("frame"),
    )
    along = Window.partitionBy("file_id").orderBy("block")
    opens = F.lag("ends_count").over(along).isNull() | (F.col("leads_count") & ~F.lag("ends_count").over(along))
    judged = edges.withColumn("opens", opens)
    newest = F.when(F.col("frame") >= 0, F.col("frame")).when(F.col("opens"), F.col("first"))
    told = judged.select(
        F.col("file_id").alias("of"), F.col("block").alias("at"), "opens", "first",
        F.last(F.when(newest.isNotNull(), F.struct(F.col("block").alias("block"), newest.alias("place"))), ignorenulls=True)
        .over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
    )
    # at most two pieces of a block can go on in another; the frames between them are whole
    open_ = F.col("leads") | F.col("closes")
    joined = rows.where(open_).join(told, (F.col("file_id") == F.col("of")) & (F.col("block") == F.col("at")))
    here = F.when(F.col("frame") >= 0, F.col("frame")).when(F.col("opens"), F.col("first"))
    frame = F.when(here.isNotNull(), F.struct(F.col("block").alias("block"), here.alias("place"))).otherwise(F.col("earlier"))
    kept = joined.select("file_id", frame.alias("frame"), F.struct("block", "place", "line").alias("line"))
    listed = kept.groupBy("file_id", "frame").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    spread = listed.select(
        "file_id", F.col("frame.block").alias("frame_block"), F.col("frame.place").alias("frame_place"),
        F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content"),
    )
    inside = rows.where(~open_).select("file_id", F.col("block").alias("frame_block"), F.col("frame").alias("frame_place"), F.col("line").alias("content"))
    return inside.unionByName(spread)


def parse_coordinates(files: DataFrame, *, content: str = "content") -> DataFrame:
    """Atom rows of coordinate texts: two header lines, then symbol, x, y, z; shorter lines are skipped.

    The status is ok, malformed (fewer than 3 lines), no coordinates, or bad number; a text that is not ok keeps one
    row without an atom.
    """
    keep = [c for c in files.columns if c != content]
    lines = F.split(stripped(F.col(content)), r"\r\n|\r|\n")
    cut = once(files.select(*keep, lines.alias("_lines")), _n_lines=F.size("_lines"))
    rows = F.filter(
        F.transform(
            F.slice("_lines", 3, F.greatest(F.col("_n_lines") - 2, F.lit(0))),
            lambda line: F.split(stripped(line), r"\s+"),
        ),
        lambda t: F.size(t) >= 4,
    )
    atoms = F.transform(
        rows,
        lambda t: F.struct(
            F.get(t, F.lit(0)).alias("symbol"),
            *[F.get(t, F.lit(i)).try_cast("double").alias(name) for i, name in ((1, "x"), (2, "y"), (3, "z"))],
        ),
    )
    parsed = once(cut.select(*keep, "_n_lines", F.when(F.col("_n_lines") >= 3, atoms).alias("_found")), _atoms=F.col("_found"))
    numbers = F.flatten(F.array(F.col("_atoms.x"), F.col("_atoms.y"), F.col("_atoms.z")))
    status = (
        F.when(F.col("_atoms").isNull(), "malformed")
        .when(F.size("_atoms") == 0, "no coordinates")
        .when(F.size(F.array_compact(numbers)) < F.size("_atoms") * 3, "bad number")
        .otherwise("ok")
    )
    judged = once(parsed, status=status)
    shown = F.when(F.col("status") == "ok", F.col("_atoms"))
    opened = judged.select(*keep, "status", F.posexplode_outer(shown).alias("atom_index", "_atom"))
    return opened.select(*keep, "status", "atom_index", "_atom.symbol", "_atom.x", "_atom.y", "_atom.z")


def coordinate_line(symbol: Column, x: Column, y: Column, z: Column) -> Column:
    return F.format_string(C.DECK_COORDINATE_FORMAT, symbol, x, y, z)


def _deck(kind: str, block: Column, charge: Column, spin: Column, functional: str, basis: str, cpus: int, ram_mb: int) -> Column:
    title = C.DECK_SEARCH_TITLE if kind == "search" else C.DECK_SHIELDING_TITLE % (functional, basis)
    workers = ["%goat", f"  NWorkers {cpus}", "end", ""] if kind == "search" else []
    head = [title, "", f"%maxcore {ram_mb}", "%pal", f"  nprocs {cpus}", "end", "", *workers]
    opening = F.concat(F.lit("* xyz "), charge.cast("string"), F.lit(" "), spin.cast("string"))
    return F.concat_ws("\n", F.lit("\n".join(head)), opening, block, F.lit("*"), F.lit(""))


def render_decks(
    atoms: DataFrame,
    *,
    kind: str = "shielding",
    functional: str = "",
    basis: str = "",
    cpus: int = 1,
    ram_mb: int = 1000,
    mol: str = "mol_id",
) -> DataFrame:
    """One input text per molecule (mol, deck), coordinates in atom order.

    Every molecule is rendered; a deck is as long as its molecule, and ``size_gate`` is there for callers with limits.
    """
    line = coordinate_line(F.col("symbol"), F.col("x"), F.col("y"), F.col("z"))
    ordered = F.array_sort(F.collect_list(F.struct("atom_index", line.alias("line"))))
    gathered = atoms.groupBy(mol).agg(
        F.array_join(F.transform(ordered, lambda e: e["line"]), "\n").alias("_block"),
        F.sum("formal_charge").alias("_charge"),
        (F.sum("radicals") + 1).alias("_spin"),
    )
    deck = _deck(kind, F.col("_block"), F.col("_charge"), F.col("_spin"), functional, basis, cpus, ram_mb)
    return gathered.select(mol, deck.alias("deck"))
