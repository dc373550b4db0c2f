"""A training-data pipeline over `documents`: quality classifier, MinHash near-dedup, benchmark
decontamination, secret scan, packing. Each stage takes (spark, docs, sf_dir) and returns a
DataFrame; between stages the documents are written as Parquet and read again. All stages but the
last return the columns of the documents; the last returns pieces of packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import cut, drop_written, narrow, table, tables_written, written
from lexforge.llm.decontaminate import contaminated
from lexforge.llm.near_dedup import BROADCAST_IDS, near_duplicates, one_text_each, text_key
from lexforge.llm.packing import pack_documents
from lexforge.llm.quality_classifier import keep_quality
from lexforge.llm.secret_scan import redact_secrets

#: The near-duplicate stage links on five words and 0.8.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without those whose doc_id is in ids(doc_id); the ids are broadcast only if few."""
    gone = cut(ids.select(F.col("doc_id").alias("_gone")).distinct())
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone"], "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id stays; of rows under one id,
    one with the text that stands for it. Rows without an id stay."""
    groups = near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)
    kept = without(docs, groups.filter(~F.col("kept")))
    again = one_text_each(text_key(narrow(docs)).select("doc_id", "tk"))
    if again is None:
        return kept
    keyed = kept.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_tk"))
    one = keyed.join(again.toDF("_id", "_tk"), ["_id", "_tk"], "left_semi").dropDuplicates(["_id"])
    return keyed.join(again.select(F.col("doc_id").alias("_id")), "_id", "left_anti").select("_row.*").unionByName(one.select("_row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: A trained model, iterated components and a tokenizer can't be stated in SQL; tests hold the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), tables_written()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
            drop_written(before, last=False)  # what the stages so far wrote isn't read again
    return docs
