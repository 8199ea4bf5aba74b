"""Queries of the training-data operators and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, chat, decontamination, embedding_dedup, line_dedup, pii, quality_classifier, quality_rules, rangecoder, resampling, simhash, structure_repair, toxicity
from gridloom.llm.common import held_out, scratch_path, table


def _predictions(scored: DataFrame, threshold: float, *more: str) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_model(docs, table(spark, sf_dir, "labels"))
    return _predictions(toxicity.score(docs, model, keep_text=False), toxicity.THRESHOLD, "hits")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find_pii(docs, pii.train_field(docs), keep_text=False)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "ids")
    rangecoder.write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return rangecoder.digest(rangecoder.read_ids(spark, folder))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(table(spark, sf_dir, "conversations"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), trusted)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality_classifier.train_model(docs, table(spark, sf_dir, "labels"))
    return _predictions(quality_classifier.score(docs, machine, keep_text=False), quality_classifier.THRESHOLD)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure_repair.repair_conversations(table(spark, sf_dir, "conversations"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_toxicity, op2_pii, op3_bpe, op4_token_output, op5_line_dedup, op6_chat_format, op7_quality_rules, op8_simhash, op9_quality_classifier, op10_decontamination,
        op11_resampling, op12_structure_repair, op13_embedding_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": line_dedup.ORACLE, "op6_chat_format": chat.ORACLE, "op11_resampling": resampling.ORACLE, "op12_structure_repair": structure_repair.ORACLE,
        "op13_embedding_dedup": embedding_dedup.ORACLE,
    }
