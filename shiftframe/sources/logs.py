"""Calculation logs, read line by line so that one huge file is shared by many tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftframe import constants as C
from shiftframe.functions.once import once
from shiftframe.functions.ranges import changes
from shiftframe.functions.workspace import materialize

BLOCK_LINES = 65_536
HEADER, VALUE, TITLE, ROW = range(4)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, block_start, row_id, line). Lines of a file are in order by block_start, then row_id.

    A block is read front to back by one task, so the generated row ids rise within it; the blocks of a file rise by
    their start. No shuffle is needed to know the order.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_id"),
        F.col("value").alias("line"),
    )


def log_status(lines: DataFrame, *, keys: Sequence[str] = ("file_id",), marker: str = C.LOG_FINISHED_MARKER) -> DataFrame:
    """Per log: number of lines and whether the exit marker occurs. Reduced on the map side."""
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.coalesce(F.bool_or(F.contains(F.col("line"), F.lit(marker))), F.lit(False)).alias("finished"),
    )


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    """Status of every log under ``path``. Spark's file sources pass over files of zero bytes, so those have no row."""
    return log_status(read_lines(spark, path))


def known_lines(lines: DataFrame, file: str, block: str, place: str) -> DataFrame:
    """``file, block, place, kind, atom, value`` of the lines that matter: headers, values, table titles, table rows.

    A number too large for its type makes its line no header and no row.
    """
    line = F.col("line")
    upper = F.upper(line)
    title = F.contains(upper, F.lit(C.LOG_TABLE_TITLES[0])) | F.contains(upper, F.lit(C.LOG_TABLE_TITLES[1]))
    kind = (
        F.when(line.rlike(C.LOG_HEADER_PATTERN), HEADER)
        .when(line.rlike(C.LOG_VALUE_PATTERN), VALUE)
        .when(title, TITLE)
        .when(line.rlike(C.LOG_TABLE_ROW_PATTERN), ROW)
    )
    kept = lines.select(F.col(file).alias("file"), F.col(block).cast("long").alias("block"), F.col(place).cast("long").alias("place"), "line")
    known = once(kept, kind=kind).where(F.col("kind").isNotNull())
    atom = F.when(F.col("kind") == HEADER, F.regexp_extract(line, C.LOG_HEADER_PATTERN, 1)).when(
        F.col("kind") == ROW, F.regexp_extract(line, C.LOG_TABLE_ROW_PATTERN, 1)
    )
    number = F.when(F.col("kind") == VALUE, F.regexp_extract(line, C.LOG_VALUE_PATTERN, 1)).when(
        F.col("kind") == ROW, F.regexp_extract(line, C.LOG_TABLE_ROW_PATTERN, 3)
    )
    read = known.select(
        "file", "block", "place", "kind", atom.try_cast("int").alias("atom"), number.try_cast("double").alias("value")
    )
    return read.where(F.col("kind").isin(VALUE, TITLE) | F.col("atom").isNotNull())


#: What a block of a file comes to. ``pair`` rows are values with the header before them, ``row`` rows those of a table
#: (``after``: the block had a title before), and one ``edge`` row says what the neighbours must know: the number of pairs,
#: whether there was a header or value, the header left open at the end, the value at its begin without a header, a title.
REDUCED = """what string, block long, place long, atom int, value double, after boolean,
    pairs long, walked boolean, opened int, free boolean, titled boolean"""


def reduce_blocks(lines: DataFrame) -> DataFrame:
    """Every block of ``known_lines`` reduced to ``REDUCED``; a block's lines must lie together and in order."""
    schema = T.StructType([lines.schema["file"], *T._parse_datatype_string(REDUCED).fields])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_type = None
        # the block at the end of the batch so far: its file and number, and its edge
        last: tuple[pa.Array, pa.Array] | None = None
        edge = {"pairs": 0, "opened": -1, "walked": False, "free": -1, "free_value": None, "titled": False}

        def told(what: str, file: pa.Array, block: pa.Array, n: int, **given: pa.Array) -> pa.RecordBatch:
            kinds = {"place": pa.int64(), "atom": pa.int32(), "value": pa.float64(), "after": pa.bool_(), "pairs": pa.int64(),
                     "walked": pa.bool_(), "opened": pa.int32(), "free": pa.bool_(), "titled": pa.bool_()}
            columns = [given.get(c, pa.nulls(n, k)) for c, k in kinds.items()]
            return pa.RecordBatch.from_arrays([file, pa.array([what] * n, pa.string()), block, *columns], names=["file", "what", "block", *kinds])

        def closing() -> pa.RecordBatch:
            free = edge["free"] >= 0
            return told(
                "edge", last[0], last[1], 1, pairs=pa.array([edge["pairs"]], pa.int64()), walked=pa.array([edge["walked"]]),
                opened=pa.array([edge["opened"] if edge["opened"] >= 0 else None], pa.int32()), free=pa.array([free]),
                place=pa.array([edge["free"] if free else None], pa.int64()), value=pa.array([edge["free_value"]], pa.float64()),
                titled=pa.array([edge["titled"]]),
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            file, block = batch.column("file"), batch.column("block")
            file_type = file.type
            new = changes(file, last and last[0]) | changes(block, last and last[1])
            part = np.cumsum(new)  # 0: the block that the batch before ended with, or the first one
            count = int(part[-1]) + 1
            kind, place = batch.column("kind").to_numpy(), batch.column("place").to_numpy()
            atom = batch.column("atom").fill_null(-1).to_numpy()
            walked = np.flatnonzero(kind <= VALUE)
            before = np.concatenate([[-1], atom[walked[:-1]]]) if len(walked) else atom[:0]
            before = np.where(np.concatenate([[HEADER], kind[walked[:-1]]])[: len(walked)] == HEADER, before, -1)
            leads = np.diff(part[walked], prepend=-1) > 0  # the first header or value of its block here
            before[leads] = -1
            known = ~leads  # whether something in the block came before
            if len(walked) and part[walked[0]] == 0 and edge["walked"]:
                before[0], known[0] = edge["opened"], True
            values = kind[walked] == VALUE
            paired = walked[values & (before >= 0)]
            free = walked[values & ~known]
            titles = np.flatnonzero(kind == TITLE)
            title_at = np.full(count, n)
            np.minimum.at(title_at, part[titles], titles)
            if edge["titled"]:
                title_at[0] = -1
            rows = np.flatnonzero(kind == ROW)
            take = lambda name, at: batch.column(name).take(pa.array(at))
            if len(paired):
                yield told("pair", take("file", paired), take("block", paired), len(paired), place=take("place", paired),
                           atom=pa.array(before[values & (before >= 0)], pa.int32()), value=take("value", paired))
            if len(rows):
                yield told("row", take("file", rows), take("block", rows), len(rows), place=take("place", rows),
                           atom=take("atom", rows), value=take("value", rows), after=pa.array(rows > title_at[part[rows]]))
            # edges of all blocks seen here; the first adds to what is held, the last is held on
            pairs = np.bincount(part[paired], minlength=count)
            some = np.zeros(count, dtype=bool)
            opened = np.full(count, -1, dtype=np.int64)
            if len(walked):
                ends = walked[np.flatnonzero(np.diff(part[walked], append=count) > 0)]
                some[part[ends]], opened[part[ends]] = True, np.where(kind[ends] == HEADER, atom[ends], -1)
            frees, free_at = np.full(count, -1, dtype=np.int64), np.zeros(count, dtype=np.int64)
            frees[part[free]], free_at[part[free]] = place[free], free
            value = batch.column("value")
            first = {
                "pairs": edge["pairs"] + int(pairs[0]), "walked": edge["walked"] or bool(some[0]),
                "opened": int(opened[0]) if some[0] else edge["opened"], "free": edge["free"] if edge["free"] >= 0 else int(frees[0]),
                "free_value": edge["free_value"] if edge["free"] >= 0 or frees[0] < 0 else value[int(free_at[0])].as_py(),
                "titled": bool(title_at[0] < n),
            }
            edge, starts = first, np.flatnonzero(new)
            if count > 1:
                last = last or (file[:1], block[:1])
                yield closing()
                inner = np.arange(1, count - 1)
                if len(inner):
                    at = starts[inner - 1]
                    has = frees[inner] >= 0
                    yield told(
                        "edge", take("file", at), take("block", at), len(inner), pairs=pa.array(pairs[inner], pa.int64()), walked=pa.array(some[inner]),
                        opened=pa.array(opened[inner], pa.int32(), mask=opened[inner] < 0), free=pa.array(has), titled=pa.array(title_at[inner] < n),
                        place=pa.array(frees[inner], pa.int64(), mask=~has), value=value.take(pa.array(free_at[inner], mask=~has)),
                    )
                k = count - 1
                edge = {"pairs": int(pairs[k]), "walked": bool(some[k]), "opened": int(opened[k]), "free": int(frees[k]),
                        "free_value": value[int(free_at[k])].as_py() if frees[k] >= 0 else None, "titled": bool(title_at[k] < n)}
            last = file[-1:], block[-1:]
        if file_type is not None:
            yield closing()

    return lines.mapInArrow(reduce, schema)


def sections_of_blocks(reduced: DataFrame, file: str) -> DataFrame:
    """``file, atom_index, sigma`` from reduced blocks: what a block leaves open is carried over the blocks of its file.

    Of a repeated atom the last value wins. A file without any value falls back to the rows of its tables.
    """
    stored = materialize(reduced, "log-blocks")
    along = Window.partitionBy("file").orderBy("block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    edges = stored.where("what = 'edge'").select(
        "file", "block", "place", "value", "free", "pairs",
        F.last(F.when(F.col("walked"), F.struct("opened")), ignorenulls=True).over(earlier)["opened"].alias("open"),
        F.coalesce(F.max("titled").over(earlier), F.lit(False)).alias("earlier_title"),
    )
    joined = F.col("free") & F.col("open").isNotNull()
    told = edges.withColumn("some", F.sum(F.col("pairs") + joined.cast("long")).over(Window.partitionBy("file")) > 0)
    carried = told.where(joined).select("file", "block", "place", F.col("open").alias("atom"), "value")
    lacking = told.where("not some").select(F.col("file").alias("of"), F.col("block").alias("at"), "earlier_title")
    rows = stored.where("what = 'row'").join(lacking, F.col("file").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    columns = ["file", "block", "place", "atom", "value"]
    found = stored.where("what = 'pair'").select(columns).unionByName(carried).unionByName(
        rows.where(F.col("after") | F.col("earlier_title")).select(columns)
    )
    return found.groupBy(F.col("file").alias(file), F.col("atom").alias("atom_index")).agg(
        F.max_by("value", F.struct("block", "place")).alias("sigma")
    )


def log_sections(lines: DataFrame, *, file: str = "file_id", place: str = "line_no", block_lines: int = BLOCK_LINES) -> DataFrame:
    """(file, atom_index, sigma) from headers and the first isotropic value after each, of lines numbered by ``place``.

    Only header and value lines matter: a value counts exactly when the line before it, among these, is a header. Lines
    are cut into blocks, so one very long log is shared by many tasks.
    """
    cut = known_lines(lines.withColumn("_block", F.floor(F.col(place) / block_lines)), file, "_block", place)
    dealt = cut.repartition("file", "block").sortWithinPartitions("file", "block", "place")
    return sections_of_blocks(reduce_blocks(dealt), file)


def read_log_sections(spark: SparkSession, path: str) -> DataFrame:
    """Shieldings of all log files under ``path``: one pass over the files, each block reduced where it is read."""
    return sections_of_blocks(reduce_blocks(known_lines(read_lines(spark, path), "file_id", "block_start", "row_id")), "file_id")
