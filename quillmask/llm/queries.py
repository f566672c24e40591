"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, cascade, codes, compaction, graphann, mixing, neardup, oracles, quotes, resample, runs, store, urlrules, warc, wavelet
from .cascade import let


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, pattern = bpe.model_proto(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))), public_tokenizers.PATTERN
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), model, pattern)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.fresh_dir(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    path = store.fresh_dir(spark, "wavelet")
    wavelet.write_shards(table(spark, sf_dir, "documents"), path, tokenizer, end_id=2)
    read = store.written(wavelet.read_shards(spark, path), "wavelet-read")
    return wavelet.with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")


#: Rows of a block of the mix; weights go with the square root of a source's rows.
MIX_BLOCK_ROWS, MIX_EXPONENT = 32, 0.5


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mixed(docs, MIX_BLOCK_ROWS, exponent=MIX_EXPONENT).select("doc_id", "source", "mix_block", "mix_slot", "mix_position")


def op3_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's turns, which quote nothing, are first made replies that quote what they answer."""
    messages = store.written(quotes.replies(table(spark, sf_dir, "conversations")), "replies")
    out = quotes.linked(messages)
    return out.select("conv_id", "turn", "parent_turn", "root_turn", "reply_depth", F.sha2("own_text", 256).alias("own_sha256"))


def op5_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cascade.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = compaction.ingested(table(spark, sf_dir, "documents"), store.fresh_dir(spark, "sharded"))
    return sharded.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = resample.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return done.table.select("doc_id", "log_weight", done.drawn.alias("drawn"), done.toxic.alias("toxic"), (done.drawn & ~done.toxic).alias("kept"))


def op9_bottom_k_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.clustered(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


def op10_pruned_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graphann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = codes.compressed(table(spark, sf_dir, "embeddings"))
    digits = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return rows.select(F.col("id").alias("vec_id"), digits.alias("code"), "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


URL_RULES = [urlrules.Listed(*r) for r in (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))]


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`labels` are of documents, so the labelled URLs that rules are mined from are those that the list decides."""
    return urlrules.judged(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def with_planted_periods(docs: DataFrame) -> Column:
    """The text of a document; a tenth of them, by the hash of their id, repeat a stretch of their words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, x["a"] + (i - x["a"]) % x["p"]))), " "))).otherwise(F.lit(""))

    return F.when(h % 10 == 0, let(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), repeated)).otherwise(F.col("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = runs.with_runs(docs.withColumn("text", with_planted_periods(docs)), keep=["doc_id"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("best")
    made = found.withColumn("best", runs.most_repeated(F.col("runs"))).select(
        "doc_id", "n_runs", best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    with store.batches_of(spark, runs.BATCH_ROWS):
        return store.written(made, "runs")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_byte_bpe, op2_pfair_mix, op3_quote_linking, op4_warc_revisits, op5_rule_cascade, op6_tiered_shards, op7_importance_resampling, op8_wavelet_shards, op9_bottom_k_near_duplicates, op10_pruned_graph_search, op11_vector_codes, op12_url_rules, op13_periodic_runs)
}

SQL: dict[str, str] = {
    "op3_quote_linking": oracles.OP3,
    "op4_warc_revisits": oracles.OP4,
    "op5_rule_cascade": oracles.OP5,
    "op6_tiered_shards": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
    "op9_bottom_k_near_duplicates": oracles.OP9,
    "op11_vector_codes": oracles.product_quantised(),
    "op12_url_rules": oracles.OP12,
    "op13_periodic_runs": oracles.OP13,
}
