"""The queries opN_<name> of this subpackage: each applies its operator, with production parameters,
to its whole tables, and derives the digest columns from what the operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import crc_mod, read_table
from wayfold.llm.covertree import top_k
from wayfold.llm.decontamination import benchmark_leaks
from wayfold.llm.languagemodel import score_texts
from wayfold.llm.licenses import scan_licenses
from wayfold.llm.minhash import near_duplicates
from wayfold.llm.pieces import count_tokens, encode
from wayfold.llm.secrets import scan_secrets, secret_digest
from wayfold.llm.suffixes import remove_repeats
from wayfold.llm.toxicity import learn, score_toxicity


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


def op2_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs, read_table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).withColumn("held_out", crc_mod("doc_id", 5) == F.lit(0))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return remove_repeats(read_table(spark, sf_dir, "documents")).withColumn("spans", F.array_join(listed, ","))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(scan_secrets(read_table(spark, sf_dir, "documents")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": op1_licenses,
        "op2_cover_tree": op2_cover_tree,
        "op3_language_model": op3_language_model,
        "op4_toxicity": op4_toxicity,
        "op5_suffix_array": op5_suffix_array,
        "op6_decontamination": op6_decontamination,
        "op7_secrets": op7_secrets,
        "op8_token_counts": op8_token_counts,
        "op9_minhash": op9_minhash,
        "op10_piece_sampling": op10_piece_sampling,
    }
