"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)`` and decides row by row: a stage that looks rows up again gives each a key of
its own, so rows without id, with one id and several texts, or with columns of any name are told apart. Null and
empty texts are texts without words; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftframe.functions.workspace import materialize
from shiftframe.llm import decontaminate, mixing, sharding, simhash, toxicity
from shiftframe.llm.text import small_or_shuffled, table


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key each, and the name of the column that holds it.

    Rows that come straight from Parquet files are told apart by file and place in the file. Any others are written
    once with a number.
    """
    name = "_row"
    while name in docs.columns:
        name += "_"
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        return docs.withColumn(name, F.struct("_metadata.file_path", "_metadata.row_index")), name
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def without(rows: DataFrame, gone: DataFrame, row: str, columns: list[str], name: str) -> DataFrame:
    """Rows whose number is not in ``gone``."""
    return rows.join(small_or_shuffled(gone, name), row, "left_anti").select([rows[c] for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among them, does not reject.

    A row is judged by its text alone; one without words is kept unless the model rejects such texts.
    """
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, of rows with equal or no ids the first.

    Repeated rows are copies of each other, as are all rows without words.
    """
    rows, row = keyed(docs)
    place = F.struct(F.col("doc_id").isNull().alias("bare"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    found = simhash.near_duplicates(rows.select(place.alias("place"), "text"), key="place")
    gone = found.where("component_id != doc_id").select(F.col("doc_id.row").alias(row))
    return without(rows, gone, row, docs.columns, "near-copies")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the rule allows; every row is judged by its own text."""
    rows, row = keyed(docs)
    judged = decontaminate.decontaminate(rows.select(row, "text"), table(spark, sf_dir, "benchmark"), key=row)
    return without(rows, judged.where("contaminated").select(F.col("doc_id").alias(row)), row, docs.columns, "contaminated")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one that a budget cuts is taken whole.

    Rows without words are taken by no mix and go. Repeated rows are taken each.
    """
    rows, row = keyed(docs)
    taken = mixing.mix_sources(rows.select("doc_id", "text", "source", row), row=row).where("taken > 0")
    times = taken.select(F.col("row").alias("of"), F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"))
    chosen = rows.join(times, rows[row] == times["of"])
    return chosen.withColumn(f"{row}_pass", F.explode(F.sequence(F.lit(1), times["times"]))).select([rows[c] for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and position of every row of the mix; rows without id are spread by their text."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The first stage applies a trained model, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None
