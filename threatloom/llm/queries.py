"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html_extract, jaccard_join, lm_score, merkle, mixing, quality, sharding, spelling, suffix_dedup, url_filter, warc
from .common import table


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicate(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], rows.schema)
    return chat.digests(chat.format_turns(chat.with_parts(rows.unionByName(extra))), dealt=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).drop("text")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=tampered)


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(html_extract.labelled_pages(pages)))


def queries() -> dict:
    return {
        "op1_suffix": op1_suffix,
        "op2_warc": op2_warc,
        "op3_jaccard": op3_jaccard,
        "op4_chat": op4_chat,
        "op5_quality": op5_quality,
        "op6_urls": op6_urls,
        "op7_lm": op7_lm,
        "op8_decontam": op8_decontam,
        "op9_mixing": op9_mixing,
        "op10_sharding": op10_sharding,
        "op11_spelling": op11_spelling,
        "op12_merkle": op12_merkle,
        "op13_html": op13_html,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.ORACLE_SQL,
        "op3_jaccard": jaccard_join.ORACLE_SQL,
        "op4_chat": chat.ORACLE_SQL,
        "op5_quality": quality.ORACLE_SQL,
        "op6_urls": url_filter.ORACLE_SQL,
        "op8_decontam": decontam.ORACLE_SQL,
        "op12_merkle": merkle.ORACLE_SQL,
    }
