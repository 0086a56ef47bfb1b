"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html, quality, sharding, simhash, substring, token_counts, toxicity, urlfilter
from .common import stored, table

#: The entries that op6 judges by.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

#: The words of a proximity match of op7 lie so many places apart at most.
NEAR = 15


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), toxicity.held_out()
    models = toxicity.train(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), models)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # n_links counts the pairs that were compared; texts that are linked through a third one needn't be, and class_id holds them
    return substring.link_passages(table(spark, sf_dir, "documents")).drop("n_links")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = stored(decontam.build_index(table(spark, sf_dir, "documents")), "positions", row_group=16 << 20)
    return decontam.search_index(index, table(spark, sf_dir, "benchmark"), near=NEAR).drop("items")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.link(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_toxicity, op3_token_counts, op4_passages, op5_shards, op6_url_rules, op7_decontamination, op8_bpe, op9_simhash, op10_main_text)}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
