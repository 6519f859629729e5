"""The queries of this subpackage: one for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binpack, bitsliced_topk, conversation_repair, language_crf, latent_decontam, minhash_dedup, mpeg_audio, pii_feistel, quality_fm, secret_links, token_alignment, toxicity_ftrl, training_order
from .common import LABELS, held_out, if_small, read
from .oracles import oracle_sql  # noqa: F401  the registry's other half


#: The key that the query of pseudonyms uses. A deployment names its own.
PII_KEY = "example key"
#: The key of the epoch that the query of the training order writes.
ORDER_KEY = 20240229


def _labelled(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Texts with a label; a document with several labels counts once for each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return docs.join(if_small(read(spark, sf_dir, "labels").select("doc_id", label), LABELS), "doc_id")


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    names, model = language_crf.train(docs.where(~out), "lang", "text", F.col("doc_id"))
    return language_crf.predict(docs.select("doc_id", "text"), names, model).withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score", "n_switches")


def op4_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 4, 2)
    model = toxicity_ftrl.train(_labelled(spark, sf_dir, "toxic").where(~out), "toxic", "text", F.col("doc_id"))
    scored = toxicity_ftrl.score(read(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 3, 1)
    model = quality_fm.train(_labelled(spark, sf_dir, "quality").where(~out), "quality", "text", "n_chars", F.col("doc_id"))
    scored = quality_fm.score(read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), model, stated="n_chars")
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii_feistel.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return docs.select("doc_id", *(f"n_{k}" for k in pii_feistel.KINDS), "text")


def op3_latent_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent_decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    shards = training_order.shards(docs, ORDER_KEY, training_order.new_folder(docs))
    return training_order.records(shards).select("doc_id", "piece", "n_ids", "slot", "shard", "at", "ids_crc32")


def op7_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_links.secrets(read(spark, sf_dir, "documents"))


def op8_binpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binpack.pack(read(spark, sf_dir, "documents"))


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_table(read(spark, sf_dir, "documents"))


def op11_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return bitsliced_topk.search(bitsliced_topk.build(vectors), vectors, F.col("vec_id") % 50 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, gone = conversation_repair.damaged(read(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows, gone)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
