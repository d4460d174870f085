"""A training-corpus pipeline of five stages over ``documents``; part of the subpackage ``tidemark.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each stage's result as
Parquet in the shared folder and reads it back as the next one's input. All stages but the last return the
columns of ``documents``. Every stage reads whole texts of any length, keeps other columns, whatever their names,
and gives an empty result for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, language_id, packing, pii, simhash_dedup
from tidemark.llm.registry import TOKENIZER, table
from tidemark.llm.scratch import every_column, materialise

#: A document stays if its language holds at least this corrected share of its trigrams.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or whose trigrams fit no language.

    Null and empty texts have no letters and go. Rows are judged one by one: repeats and ties each, null ids too.
    """
    model = language_id.train(docs.where(~language_id.held_out()))
    return language_id.keep_known(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near duplicates.

    SimHash over five-word shingles; 60 of 64 bits or more agree, a similarity of 0.94. Rows with one id stay
    together, null ids stay, and texts without words are one group.
    """
    classes = simhash_dedup.near_duplicates(docs, width=5)
    gone = materialise(classes.where("doc_id <> component_id").select("doc_id").distinct(), "gone")  # joined by its size
    return docs.join(gone, "doc_id", "left_anti").select(*every_column(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark; null, empty and short texts hold none."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind; null and empty texts stay."""
    return pii.redact(docs, pii.train(pii.labelled_table()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of 1024; null and empty texts have the end id alone."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", redact),
    ("best-fit packing", pack),
]

#: SQL can't express the trained models and the tokenizer; the tests hold run() to its stages, and each stage's operator
#: to brute force or a plain loop where it has one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
