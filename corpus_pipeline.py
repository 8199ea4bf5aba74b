"""Cleaning of a document corpus in five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results, for every stage: an empty table gives an empty one; further columns, whatever their names, pass through the first four stages;
rows with a null doc_id are documents as others; a null text counts as one without words, and only the line stage keeps null apart from empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, decontamination, line_dedup, near_dedup, toxicity
from gridloom.llm.common import scratch_path, table

VOCABULARY = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts have no hits and stay; repeated rows get the same score; without toxic training rows only the fixed lexicon counts.
    """
    model = toxicity.train_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines go; every document stays, with what is left of its text.

    A null text stays null, one whose lines all go becomes empty; of equal lines the one of the smallest doc_id (null first), then text hash, then
    place stays; rows that repeat doc_id and text keep the same lines. n_chars is passed on as it was.
    """
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (5-word Jaccard of 0.8 or more) stays.

    It is the one with the smallest doc_id, ties going by text hash; a null doc_id is kept only where its group has no other; of repeated
    rows one stays; texts without words, null ones too, are one group.
    """
    return near_dedup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none; repeated rows go or stay together; an empty benchmark drops nothing.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of each document.

    A null or empty text has no ids; repeated rows stay repeated rows; texts of any length are encoded whole.
    """
    return bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: The models and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again, as the next one uses them more than once."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
