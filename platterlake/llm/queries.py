"""The numbered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterlake.llm import chat, decontam, forest, langid, lattice, mixing, pitman_yor, quality, suffixes, templates
from platterlake.llm.shared import fold, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    use = fold(F.col("doc_id")) != 0
    scored = quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels"), use))
    return scored.select("doc_id", (~use).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_chats(rows.unionByName(chat.hard_case(spark))))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_texts(table(spark, sf_dir, "documents"), fold(F.col("doc_id")) != 1)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_links", "component_id", "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify_language(table(spark, sf_dir, "documents"), fold(F.col("doc_id")) != 0)
    return found.withColumn("score", F.round("score", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing_sources": op6_mixing_sources,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_formatting": chat.ORACLE,
    "op3_benchmark_decontamination": decontam.ORACLE,
    "op4_suffix_array_dedup": suffixes.ORACLE,
    "op5_line_dedup": templates.ORACLE,
    "op6_mixing_sources": mixing.ORACLE,
    "op8_embedding_near_dedup": lattice.ORACLE,
    "op9_ngram_jaccard_join": forest.ORACLE,
    "op10_language_id": langid.ORACLE,
}
