"""Files against a list of expected checksums."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from itertools import groupby
from operator import itemgetter
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a task holds of a file at a time.
CHUNK_BYTES = 1 << 20


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files under ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _local(path: str) -> str | None:
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith(("/", "file:")) else None


def _located(path: str):
    """File system and path in it, of a path that Arrow knows."""
    from pyarrow import fs

    scheme, _, rest = path.partition("://")
    authority, _, inside = rest.partition("/")
    system, root = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority}/")
    return system, f"{root.rstrip('/')}/{inside}"


def open_stream(path: str) -> BinaryIO:
    """A file of the local disk or of a file system that Arrow knows, opened for reading front to back."""
    if local := _local(path):
        return open(local, "rb")
    system, inside = _located(path)
    return system.open_input_stream(inside)


@contextmanager
def create_stream(path: str) -> Iterator[BinaryIO]:
    """A new file to write front to back. On a local disk it has its name when it is whole, so a task may run again."""
    folder, _, name = path.rpartition("/")
    if local := _local(folder):
        os.makedirs(local, exist_ok=True)
        begun = f"{local}/_{name}.{os.getpid()}"
        with open(begun, "wb") as stream:
            yield stream
        os.replace(begun, f"{local}/{name}")
    else:
        system, inside = _located(folder)
        system.create_dir(inside, recursive=True)
        with system.open_output_stream(f"{inside}/{name}") as stream:
            yield stream


def write_groups(
    rows: DataFrame, path: str, *, key: str, order: Sequence[str], line: str, parts: int, created: Callable[[str], BinaryIO] = create_stream
) -> None:
    """Write the lines of every key, in order, to a file ``slot=<task>/<key>.txt``; a null is an empty line.

    A folder per key costs a file system far more than the file in it, to make and to list; here there is one per task.
    A task holds one batch of lines. Keys must not be null.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = f"{path}/slot={TaskContext.get().partitionId()}"

        def lines() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        written = 0
        for name, group in groupby(lines(), key=itemgetter(0)):
            with created(f"{folder}/{name}.txt") as stream:
                for _, text in group:
                    stream.write((text or "").encode() + b"\n")
            written += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([written], pa.int64())})

    dealt = rows.repartition(parts, key).sortWithinPartitions(key, *order, line).select(key, line)
    dealt.mapInArrow(write, "files long").agg(F.sum("files")).first()


def digest_paths(
    paths: DataFrame, *, path: str = "path", chunk_bytes: int = CHUNK_BYTES, opened: Callable[[str], BinaryIO] = open_stream
) -> DataFrame:
    """A table of paths with ``read_bytes`` and ``sha256`` of each file.

    A task reads its files in chunks, so a file may be larger than a cell or than the memory of a task. ``opened`` opens
    a path where Arrow does not know the file system. A file that cannot be opened fails the task. Repeated paths are
    read each, a null path has nulls, and an empty file the checksum of no bytes.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, found = [], []
            for name in batch.column(path).to_pylist():
                if name is None:
                    lengths.append(None)
                    found.append(None)
                    continue
                state, length = hashlib.sha256(), 0
                with opened(name) as stream:
                    while chunk := stream.read(chunk_bytes):
                        state.update(chunk)
                        length += len(chunk)
                lengths.append(length)
                found.append(state.hexdigest())
            added = [pa.array(lengths, pa.int64()), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "read_bytes", "sha256"])

    added = [T.StructField("read_bytes", T.LongType()), T.StructField("sha256", T.StringType())]
    return paths.mapInArrow(digest, T.StructType([*paths.schema.fields, *added]))


def digest_files(
    spark: SparkSession, path: str, *, chunk_bytes: int = CHUNK_BYTES, opened: Callable[[str], BinaryIO] = open_stream
) -> DataFrame:
    """``digest_paths`` of all files under ``path``, with their listed length and the columns of partition folders.

    Only names and lengths come from the scan, which deals files to tasks by size. Spark's file sources pass over files
    of zero bytes, so those have no row here.
    """
    listed = spark.read.format("binaryFile").load(path).drop("content", "modificationTime")
    return digest_paths(listed, chunk_bytes=chunk_bytes, opened=opened)


def manifest_check(
    files: DataFrame,
    manifest: DataFrame,
    *,
    key: str = "path",
    content: str | None = "content",
    expected: str = "sha256",
    keep: Sequence[str] = (),
) -> DataFrame:
    """(key, sha256, status): ``ok``, ``mismatch``, or ``unlisted``, which passes. ``accepted`` says which pass.

    Columns of ``files`` named in ``keep`` follow, so nothing has to be digested again for them.

    The checksum is taken in the scan, so only it goes into the join. Without ``content``, ``files`` has it as column
    ``sha256`` (see ``digest_files``).
    """
    hashed = files.select(key, *keep, F.sha2(F.col(content), 256).alias("sha256") if content else F.col("sha256"))
    wanted = manifest.select(key, F.lower(expected).alias("_expected"))
    status = (
        F.when(F.col("_expected").isNull(), "unlisted")
        .when(F.col("_expected") == F.col("sha256"), "ok")
        .otherwise("mismatch")
    )
    return hashed.join(wanted, key, "left").select(
        key, "sha256", status.alias("status"), (status != "mismatch").alias("accepted"), *keep
    )
