"""The training-data pipeline: five stages over ``documents``, each by one operator of ``quillspark.llm``.

Each stage is written as Parquet in the shared folder and read again, so that a lost executor costs one stage's tasks;
what a stage held on the way is let go of when it has been written.
All stages but the last return the columns of the documents they are given; a stage reads all rows of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm._common import settled, table
from quillspark.llm.decontaminate import clean_documents
from quillspark.llm.exact_dedup import kept_documents
from quillspark.llm.packing import pack
from quillspark.llm.simhash import without_similar
from quillspark.llm.toxicity import accepted


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels that are not held out, does not reject."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one that the digest index keeps."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the one with the least doc_id.

    Texts too short for one shingle are compared as wholes. Rows alike in doc_id and text are one document, and a row
    without a doc_id comes after all others of its group.
    """
    return without_similar(docs, similarity=0.8, words_per_shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs: one occurrence is enough for a document to go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The toxicity model, fingerprints, components and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
