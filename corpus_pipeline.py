"""Documents to packed training sequences, in five stages. Each takes all that the one before it kept.

Null and empty texts go through every stage as documents without words. Rows are judged one by one, by id and text together: of rows
that are the same in both, near-duplicate removal keeps one, and a row goes if its own text is contaminated, whatever other rows have its
id. A row without an id goes as a copy of one that has an id, but isn't held against near copies. Columns beside those of ``documents`` stay up to the last stage, whatever their names. An empty table goes through
as it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm import binpack, latent_decontam, minhash_dedup, quality_fm, secret_links
from fieldtrace.llm.common import LABELS, cut, free_name, held_out, if_small, read

Stage = tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is fitted on the labelled ones that its query learns from."""
    labelled = docs.select("doc_id", "text", "n_chars").join(if_small(read(spark, sf_dir, "labels").select("doc_id", "quality"), LABELS), "doc_id")
    model = quality_fm.train(labelled.where(~held_out(F.col("doc_id"), 3, 1)), "quality", "text", "n_chars", F.col("doc_id"))
    score = free_name(docs, "score")
    return quality_fm.score(docs, model, stated="n_chars", into=score).where(F.col(score) >= 0.5).select(docs.columns)


KEYS = ["__key0", "__key1"]


def _row_key() -> Column:
    """Two hashes that tell rows by id and text."""
    return F.struct(*(F.xxhash64(F.lit(k), F.col("doc_id").isNull(), "doc_id", "text").alias(c) for k, c in enumerate(KEYS)))


def _keyed(docs: DataFrame) -> DataFrame:
    """The key of each row, and all its columns as one value, so that none of their names clashes."""
    return docs.select(F.struct(*docs.columns).alias("__doc"), _row_key().alias("__key")).select("__doc", "__key.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that of the smallest id. Documents without words all stay."""
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    worded = docs.where(some)
    kept = minhash_dedup.near_duplicates(worded.select("doc_id", "text"), carry=_row_key()).where("kept").select("carried.*").distinct()
    # of equal rows each task keeps one before they are dealt out, so that no number of them meets in one place
    once = _keyed(worded).groupBy(*KEYS).agg(F.first("__doc").alias("__doc"))
    return once.join(kept.hint("merge"), KEYS, "left_semi").select("__doc.*").union(docs.where(~some))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = latent_decontam.contaminated(docs.select("doc_id", "text"), read(spark, sf_dir, "benchmark"), carry=_row_key())
    gone = found.where("contaminated").select("carried.*").distinct()
    return _keyed(docs).join(gone, KEYS, "left_anti").select("__doc.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, and the parts of credentials that are linked to them, are masked; n_chars follows the text."""
    return secret_links.redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with the sequence and the place that each has."""
    return binpack.pack(docs)


STAGES: list[Stage] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: A fitted classifier, min-hash candidates and a search for packings have no SQL of equal rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
