"""Registered queries of the llm operators: each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import hard_negatives, mixing


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import digest, remove_repeats

    return digest(remove_repeats(_documents(spark, sf_dir)))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_documents(spark, sf_dir), k=4, percent=80)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_next

    return compare_with_next(_documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_digest

    return mix_digest(_documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import digest, remove_repeated_lines

    return digest(remove_repeated_lines(_documents(spark, sf_dir)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import leaks

    return leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file: in the folder DOCKETSPARK_TOKENIZERS names, else where the package of public tokenizers lies."""
    import os

    return os.path.join(os.environ.get("DOCKETSPARK_TOKENIZERS", "/opt/tokenizers"), name)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, secrets
    from .token_counts import END, load_pieces

    words = {p[:-1].decode() for p in load_pieces(_vocabulary_path()) if p[-1:] == bytes([END]) and len(p) > 3 and p[:-1].isalpha()}
    return digest(secrets(_documents(spark, sf_dir), words))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import load_pieces, token_counts

    return token_counts(_documents(spark, sf_dir), load_pieces(_vocabulary_path()))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damaged, digest, repair

    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return digest(conversations, *repair(damaged(conversations)))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.query_labels(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digest, remove_repeated_bytes

    return digest(remove_repeated_bytes(_documents(spark, sf_dir)))


QUERIES = {
    "op12_suffix_dedup": op12_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op13_conversation_repair": op13_conversation_repair,
    "op3_secrets": op3_secrets,
    "op5_token_counts": op5_token_counts,
    "op9_licenses": op9_licenses,
    "op4_line_dedup": op4_line_dedup,
    "op6_decontamination": op6_decontamination,
    "op1_fingerprints": op1_fingerprints,
    "op2_mixing": op2_mixing,
    "op7_quality": op7_quality,
    "op8_near_dedup": op8_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {"op2_mixing": mixing.SQL, "op11_hard_negatives": hard_negatives.SQL}
