"""The registered queries of the ten operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.llm import exact_dedup, host_reputation, jaccard, knlm, linededup, mixing, packing, pii, quality, wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "quality.*")
    return out.withColumn("char_distance", F.round("char_distance", 6)).withColumn("word_distance", F.round("word_distance", 6))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wrapper.main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    merged = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(merged).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = knlm.train(docs.where(~knlm.held_out("doc_id")))
    return knlm.scored(docs, model).select("doc_id", knlm.held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


def tokenizer() -> dict:
    """The byte-level BPE with 50,257 ids: the file of ranks gives the same ids as byte_bpe_50k.json, and faster."""
    import public_tokenizers

    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "specials": {"<|endoftext|>": 50256}}


def op8_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), **tokenizer())


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = linededup.without_wide_lines(docs)
    return out.select("doc_id", "removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are the quality labels whose doc_id is the page's page_id."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return host_reputation.url_verdicts(table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
