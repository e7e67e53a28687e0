"""From documents to packed training sequences: language, repeated lines, near duplicates, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabflow.llm.jaccard import one_of_each
from tabflow.llm.language import fit, with_language
from tabflow.llm.line_templates import drop_lines
from tabflow.llm.mixing import mixed_documents
from tabflow.llm.packing import pack_documents
from tabflow.llm.tokens import tokenizer_path
from tabflow.session import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, the filters learned from these documents' own labels."""
    return with_language(docs, fit(docs))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs across documents."""
    return drop_lines(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; labelled quality weighs the draw."""
    return mixed_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the encoded documents, each with its sequence and its place there."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("lines", fresh_lines),
    ("near duplicates", unlike_documents),
    ("mix", mixed_sources),
    ("packing", packed_sequences),
]

#: No SQL: language filters and token ids cannot be written in it. tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written and read back before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
