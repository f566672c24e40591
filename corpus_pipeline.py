"""Corpus pipeline: quality classifier, quality rules, near-duplicates, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. The mix stage's decision is the order of its rows: its
files hold the mixed order, and the last stage reads each row's place in it from its file and row number.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmask.llm import bpe, cascade, mixing, neardup, resample, store
from quillmask.llm.queries import MIX_BLOCK_ROWS, MIX_EXPONENT

#: Similarity (percent) from which documents are near-duplicates here.
NEAR_PERCENT = 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws."""
    return resample.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects. A short text isn't a bad one here: only those without words are too short."""
    return cascade.accepted(docs, least_words=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near-duplicates."""
    return neardup.kept_documents(docs, neardup.Settings(percent=NEAR_PERCENT))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the mixed order from file to file and row to row."""
    placed = mixing.mixed(docs, MIX_BLOCK_ROWS, exponent=MIX_EXPONENT)
    return placed.repartitionByRange("mix_position").sortWithinPartitions("mix_position", "doc_id").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, mix_rank (place in the mix, from 0), n_tokens, and digests of the ids and of the bytes decoded from them."""
    model, pattern = bpe.model_proto(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), public_tokenizers.PATTERN
    return bpe.digests(with_rank(docs), model, pattern)


def with_rank(docs: DataFrame) -> DataFrame:
    """doc_id, text and mix_rank: rows of earlier files plus the row's number in its file; null if docs aren't read from files."""
    if not docs.inputFiles():
        return docs.select("doc_id", "text", F.lit(None).cast("long").alias("mix_rank"))
    named = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = docs.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    # one row a file; names end with the number of the task, then of the file in the task
    order = (F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), F.regexp_extract("file", r"-c(\d+)", 1), F.col("file"))
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return named.join(starts, "file").select("doc_id", "text", (F.col("start") + F.col("row")).alias("mix_rank"))


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("byte_bpe", byte_bpe)]

#: SQL cannot express the sampled classifier or the sketches; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of `sf_dir`. What a stage keeps in the shared folder goes when its result is
    written, and that result when the next is; the last stage's tables stay, as the result reads them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = store.fresh_dir(spark, name)
        with store.job(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            store.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
