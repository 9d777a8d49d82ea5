"""From documents to token ids: language, exact and near copies, source mix, pieces.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm.common import free_name, materialise, table
from sparkfolio.llm.exact_dedup import drop_exact_duplicates
from sparkfolio.llm.language import UNDETERMINED, language_column
from sparkfolio.llm.mixing import mixed_documents
from sparkfolio.llm.near_copies import drop_near_copies
from sparkfolio.llm.sentencepiece import encode_documents

#: A document whose bytes are on average less sure of its language than this is rejected.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language and those no language fits.

    Null and empty texts, and texts without a letter, go; rows that repeat are judged alike; columns of any name stay; an empty table stays empty.
    """
    mark = free_name(docs, "language_id")
    found = docs.withColumn(mark, language_column(docs))
    return found.filter((F.col(f"{mark}.lang") != UNDETERMINED) & (F.col(f"{mark}.score") >= LEAST_SCORE)).drop(mark)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of the documents with equal texts stays, that with the largest id; of rows equal in id and text one. Null texts equal empty ones, null ids are the smallest."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles of similarity 0.8 or more stays, that with the smallest id.

    Fingerprints and their Golay keys give the first links, the shingles the rest, and sets of shingles verify them all.
    Null and empty texts are alike; rows that repeat an id are told apart by text; an empty table stays empty.
    """
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none over three times. Null sources are a source, texts without words go with their source's whole repeats, rows that repeat an id are taken together."""
    return mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row; a null or empty text has none."""
    return encode_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", pieces),
]

#: The language model, the fingerprints and the segmentation have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
