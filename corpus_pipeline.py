"""From raw documents to tokens: quality, boilerplate lines, near duplicates, benchmark items, token ids.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of documents.

Defined cases: a document with a null or empty text stays through all stages and is its end id alone; one without doc_id stays, since no
decision can name it; rows that share a doc_id stay or go together; without labels no document is rejected; empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studylake.llm import decontaminate, line_dedup, ngram_join, quality, sentence_pieces
from studylake.llm.common import store, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their sources' boilerplate lines; n_chars follows the text. Copies are still there, so equal texts of a
    source count once: else two copies in a small source would take each other's lines."""
    return line_dedup.drop_boilerplate(docs, by_text=True).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id."""
    return ngram_join.keep_one(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_items(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as digests of the ids and of their decoded text."""
    return sentence_pieces.digests(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", good),
    ("line dedup", own_lines),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", uncontaminated),
    ("SentencePiece encoding and decoding", tokens),
]

ORACLE_SQL = None  # a trained classifier and a tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs).df
    return docs
