"""Registered queries of the operators that are plain DataFrame work, with their SQL twins where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftframe.functions.workspace import new_path
from shiftframe.llm import archive, boilerplate, decontaminate, mixing, sharding
from shiftframe.llm.text import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.drop_boilerplate(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    archive.write_archive(table(spark, sf_dir, "pages"), path)
    return archive.parse_records(archive.read_records(spark, path)).drop("target_uri", "header_digest")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_line_dedup, op3_sharding, op6_mixing, op8_warc)}
ORACLE = {
    "op1_decontaminate": decontaminate.DECONTAMINATE_SQL,
    "op2_line_dedup": boilerplate.BOILERPLATE_SQL,
    "op6_mixing": mixing.MIX_SQL,
    "op8_warc": archive.ARCHIVE_SQL,
}
