"""A corpus through five operators: toxicity, SimHash near-dedup, benchmark
decontamination, secret redaction, SentencePiece encoding.

Every stage works on all rows that the one before kept, and is written as Parquet
and read again. All but the last return the columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, near_dedup, secrets, sentencepiece_codec, toxicity
from graphloom.llm._spark import delete, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more go. It is fitted on the labelled rows of docs. Null and empty texts
    score as texts without a toxic passage; repeated rows are judged alike; without labels of both kinds all stay."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model).select(COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest doc_id, nulls last, ties by a hash of the text; of
    repeated rows one. Null and blank texts are one group."""
    return near_dedup.drop_near_duplicates(docs).select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none; items of null id or without words count for nothing."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mark; n_chars follows. No document goes; null texts stay null, with n_chars null."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: ids (decimal, comma-joined), n_tokens and the text decoded from them. Null counts as empty: no ids."""
    return sentencepiece_codec.encode_table(docs, sentencepiece_codec.default_model()).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("sentencepiece", encoding_stage),
]

#: No stage but the redaction can be said in SQL. Tests hold the rows of every stage against brute force on a small table.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each one's table written and read again; (doc_id, n_tokens, ids, decoded) of what is kept.

    Columns of documents beyond COLUMNS are left out by the first stage. Empty documents give no row; without labels of both
    kinds no document is toxic, without benchmark items none is a leak. What a stage does with nulls, empty and very long
    texts, ties and repeated rows stands with it. The last table is the caller's to delete."""
    docs, where, last = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{where}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(path)
        if last:  # nothing reads the table before this one any more
            delete(spark, last)
        last = path
    return docs
