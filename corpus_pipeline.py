"""Corpus pipeline: documents in, placed training pieces out, one written table per stage.

Rules, classifier, line dedup and near duplicates hand on the columns of documents; the last stage gives one row per piece
with its place in a sequence. Every stage works on all rows that the one before kept.
"""

from pyspark.sql import DataFrame, SparkSession

from persona_spark.llm.common import read
from persona_spark.llm.jaccard_join import keep_one_of_each
from persona_spark.llm.kneser_ney import keep_likely
from persona_spark.llm.line_dedup import line_dedup as dedup_lines
from persona_spark.llm.packing import best_fit_packing as pack_documents
from persona_spark.llm.quality_rules import keep_good
from persona_spark.session import stage_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trained on the trusted texts among `docs`."""
    return keep_likely(docs, read(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; a document that has no others stays, with an empty text."""
    return dedup_lines(docs).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates stays."""
    return keep_one_of_each(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier's model and the packing have no counterpart in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
