"""A training corpus from documents in five stages, each one written as Parquet and read again by the next.

toxicity: documents that the classifier rejects go. exact dedup: of equal texts the largest doc_id stays.
near-dedup: of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles the smallest doc_id stays.
mixing: sources meet their target weights by copies. SentencePiece: each document's ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestkit.llm.common import Scratch, table
from nestkit.llm.exact_dedup import drop_exact
from nestkit.llm.mixing import mix_documents
from nestkit.llm.sentencepiece_codec import encode_columns
from nestkit.llm.near import drop_near
from nestkit.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_toxic(spark, docs, sf_dir)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Columns of documents, and each document's number of tokens and ids. Copies of a document repeat its ids."""
    return encode_columns(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("simhash near-dedup", near_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: SQL can express neither a fitted classifier nor SentencePiece; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
