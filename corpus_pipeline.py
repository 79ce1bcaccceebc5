"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame, applied to what its
predecessor kept. Stages are written as Parquet and read again, so a lost executor
costs at most one stage. All but the last return the columns of documents.

Models of the first two stages are fitted on the documents they are given and the
labels of the table folder. Every stage decides by row: rows that share a doc_id or have
none are told apart by their content, and repeated rows are near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crossmer.llm.common import table
from crossmer.llm.decontamination import without_passages
from crossmer.llm.language_id import accepted_documents, fit_text_models
from crossmer.llm.near_dedup import keep_one
from crossmer.llm.packing import pack_documents
from crossmer.llm.toxicity import held_out, learn, scored
from crossmer.operators.storage import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language."""
    return accepted_documents(docs, fit_text_models(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    grammar = learn(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id"))
    return scored(docs, grammar).filter("predicted = 0").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_passages(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, placed in sequences."""
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: No stage but the first could be told in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a table folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
