"""Registered queries of the subpackage (``opN_<name>``) and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.llm import (decontam, divergence, hard_negatives, html_main, langid, line_dedup, packing, quality, setjoin, suffix_dedup,
                           toxicity, warc, window_dedup)
from pitchside.llm.textops import shared_folder
from pitchside.sources.tables import read_table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs.select("doc_id", "text", langid.held_out(F.col("doc_id")).alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archive(read_table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", "refers_to")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.linked_components(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = toxicity.held_out(F.col("doc_id"))
    labels = read_table(spark, sf_dir, "labels").where(~held_out)
    score = toxicity.train(docs, labels)
    return score(docs.select("doc_id", "text", held_out.alias("held_out"))).select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(read_table(spark, sf_dir, "documents"), keep_first=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.removals(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.removals(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_language": op2_language,
    "op3_warc": op3_warc,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_html_main_text": op6_html_main_text,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_window_dedup": op8_window_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op3_warc": warc.ORACLE_SQL,
    "op4_jaccard_join": setjoin.ORACLE_SQL,
    "op9_quality_rules": quality.ORACLE_SQL,
    "op10_decontamination": decontam.ORACLE_SQL,
    "op11_line_dedup": line_dedup.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_source_divergence": divergence.ORACLE_SQL,
}


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
