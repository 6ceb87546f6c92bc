"""The ten digest queries over the test tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm import bpe, chat_format, lm_scoring, media, mixing, near_dedup, quality_rules, suffix_dedup, token_counts, url_filter
from quillstat.llm.common import documents


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS t(conv_id, turn, role)").withColumn("text", F.lit(said))
    talks = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    loss = chat_format.loss_text(F.col("recovered"))
    turns = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chat_format.format_chats(talks).select(
        "conv_id",
        F.size("recovered").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(documents(spark, sf_dir))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir)).drop("representative")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    # base rules read statistics that are returned anyway; the method's rules follow as a cascade for rows that pass them
    order = quality_rules.plan_cascade(docs, quality_rules.METHOD_RULES, have_statistics=True)
    failed = F.expr(quality_rules.BASE_FAILED)
    known = {c: F.col(c) for c in quality_rules.STATISTICS}
    first = quality_rules.cascade(order, quality_rules.METHOD_RULES, F.coalesce("text", F.lit("")), known)
    return quality_rules.text_statistics(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.when(failed, False).otherwise(first.isNull()).alias("kept"),
    )


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(documents(spark, sf_dir), keep_media=False)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def queries() -> dict:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_chat_format": op2_chat_format,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_near_dedup": op4_near_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_quality_rules": op6_quality_rules,
        "op7_media_columns": op7_media_columns,
        "op8_bpe": op8_bpe,
        "op9_mixing": op9_mixing,
        "op10_suffix_dedup": op10_suffix_dedup,
    }
