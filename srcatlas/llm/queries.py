"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import checkpoint_root, read
from .html_extraction import main_text
from .lm_scoring import score_documents
from .minhash import near_duplicates
from .mixing import mix
from .packing import pack_documents
from .pivots import near_vectors
from .quality import quality_report
from .recompression import strip_repeats
from .secrets import find_secrets
from .token_alignment import align_documents
from .token_counts import count_tokens
from .token_files import read_token_files, write_token_files
from .turn_repair import damage, repair_chunks, repair_report


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by place; the query shows a digest in place of the secret itself."""
    found = find_secrets(read(spark, sf_dir, "documents"))
    return found.withColumn("secret_sha256", F.sha2("secret", 256)).drop("secret")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = strip_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(
        read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), vocabulary=50257, end_id=0
    )
    return read_token_files(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return repair_report(conversations, repair_chunks(damage(conversations)))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that figures are of counting and not of what an earlier run left."""
    cache = f"{checkpoint_root(spark)}/token-counts-{uuid.uuid4().hex}"
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), cache)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_pivot_near_dedup": op2_pivot_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_html_extraction": op4_html_extraction,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_packing": op9_packing,
    "op10_token_files": op10_token_files,
    "op11_turn_repair": op11_turn_repair,
    "op12_token_alignment": op12_token_alignment,
    "op13_token_counts": op13_token_counts,
}
ORACLES: dict[str, str] = oracles.ORACLES
