"""A training-data pipeline over documents: language identification, line dedup, similarity join, packing.

Every stage is a function of (spark, docs, sf_dir) over all that its predecessor kept; run() writes each stage's result as
Parquet in the shared folder and reads it back as the next one's documents.

Edge cases: null texts and texts without letters go at the first stage; a stage given them all the same keeps null and empty
texts but for `lines`, which drops documents of which nothing is left; rows equal in doc_id and text are one document to
`lines` and `near_duplicates`, of which the latter keeps one; very long texts are whole; of ties the smaller doc_id stays, a
null one comes last; empty tables stay empty; other columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fragmill.llm.chosen_path import keep_one_of_each
from fragmill.llm.language_id import UNKNOWN, identify
from fragmill.llm.line_dedup import dedup_lines
from fragmill.llm.packing import pack
from fragmill.llm.queries import tokenizer_path
from fragmill.llm.shared import settle

#: A document is rejected if no language is found or the best one is less likely than this.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; null texts and texts without letters go."""
    found = identify(docs)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier document has; a document of which nothing is left goes."""
    found = dedup_lines(docs)
    left = found.where((F.col("n_deleted") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents that are linked by similar word 5-grams."""
    return keep_one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packing)]

#: A trained network, alignment and best-fit search are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
