"""Registered queries of the operators that need Python inside tasks; their tests compare them with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shiftframe.llm import collocations, extraction, negatives, ngram, pii, simhash, toxicity, vectors
from shiftframe.llm.text import table


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link_vectors(table(spark, sf_dir, "embeddings"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_texts(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract_main(pages, extraction.train(pages))


QUERIES = {
    f.__name__: f
    for f in (
        op4_embedding_dedup, op5_pii, op7_simhash, op9_toxicity, op10_lm_scoring, op11_collocations, op12_hard_negatives,
        op13_html_extraction,
    )
}
ORACLE = {"op11_collocations": collocations.COLLOCATIONS_SQL, "op12_hard_negatives": negatives.NEGATIVES_SQL}
