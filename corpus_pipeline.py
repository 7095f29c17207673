"""Corpus pipeline: five stages over documents, each written as Parquet and reread.

Every stage takes empty tables, texts of any length, repeated rows and columns
beyond those of documents; what it does with nulls is said beside it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pitchfold.llm import exact_dedup, jaccard_join, language_id, mixing, viterbi_pieces
from pitchfold.llm.common import materialise, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents whose language is not recognised go; null texts and those without a letter are such."""
    return language_id.recognised(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one document of each group of equal texts stays, the one with the largest id; null is an empty text, a null id stays if it is alone."""
    return exact_dedup.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each class of near copies stays, the one with the smallest id; texts without a word are one class, null ids stay."""
    return jaccard_join.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: the words that the mix takes, a row for each epoch that takes of a document, in the order of the mix; texts without a word give none, a null source is one."""
    return mixing.mixed_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: doc_id, lang, source and the ids of the text's pieces, a row for each row; an empty text has none."""
    return viterbi_pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]
#: SQL cannot express language ID, MinHash, seeded draws or the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
