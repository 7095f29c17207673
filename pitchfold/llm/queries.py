"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat_format, exact_dedup, html_extract, imatch, jaccard_join, language_id, license_scan, mixing, periodic_runs, secret_scan, token_codes, turn_repair, viterbi_pieces
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(table(spark, sf_dir, "documents")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.license_scan(table(spark, sf_dir, "documents")))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op5_token_codes(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    return token_codes.encode_documents(table(spark, sf_dir, "documents"), path)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op8_viterbi_pieces(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    return viterbi_pieces.digest_documents(table(spark, sf_dir, "documents"), path)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), edit=periodic_runs.repeat_from)
    return periodic_runs.digest(found)


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_digest(table(spark, sf_dir, "conversations"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chat_format.format_conversations(chat_format.with_own(table(spark, sf_dir, "conversations")))
    return chat_format.read_back(parts)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_license_scan, op3_html_extract, op4_mix_sources, op5_token_codes, op6_jaccard_join, op7_language_id, op8_viterbi_pieces, op9_exact_dedup, op10_imatch, op11_periodic_runs, op12_turn_repair, op13_chat_format)}
ORACLES = {"op9_exact_dedup": exact_dedup.ORACLE, "op12_turn_repair": turn_repair.ORACLE, "op13_chat_format": chat_format.ORACLE}
