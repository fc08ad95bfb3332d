"""The registered queries of this subpackage, one for each operator, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licenses, mixing, neardup, ogg, oracles, ordinal, packing, pii, quality_rules, tokens
from .common import bounded_batches, n_words, read

#: Words of a bin; where the public tokenizers' vocabularies lie; of the mixed documents, those with fewer words
#: than this have half the odds.
CAPACITY, TOKENIZERS, SHORT = 2048, "/opt/tokenizers", 64


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), n_words(F.col("text")), CAPACITY)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = read(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, read(spark, sf_dir, "labels")))


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = read(spark, sf_dir, "documents")
    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), ogg.stored_column(F.col("text")).alias("media"))
    return stored.select("doc_id", "n_bytes", ogg.probed_column(F.col("media")).alias("m")).select("doc_id", "n_bytes", "m.*")


def grades(labels: DataFrame) -> DataFrame:
    """0 to 2: a point for quality and a point for not being toxic; null where a label is."""
    told = F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)
    return labels.select("doc_id", F.when(told, F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = read(spark, sf_dir, "documents")
    model = ordinal.fit(docs, grades(read(spark, sf_dir, "labels")), n_grades=3, wanted=2)
    return ordinal.graded(docs, model, wanted=2)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    found = pii.find(read(spark, sf_dir, "documents"), ["doc_id"])
    n_spans = F.when(F.col("spans") == "", 0).otherwise(F.regexp_count("spans", F.lit(",")) + 1).cast("long")
    return found.select("row.doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", n_spans.alias("n_spans"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = lambda size: F.when(size < SHORT, 0.5).otherwise(1.0)
    return mixing.mixed(read(spark, sf_dir, "documents"), n_words(F.col("text")), prior)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    told = docs.select("doc_id", held_out().alias("held_out"), langid.predict(F.col("text"), model, spark).alias("l"))
    return told.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), "l.score", "l.entropy", "l.rejected")


def op9_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    bounded_batches(spark)
    vocabulary = tokens.byte_level_vocabulary(f"{tokenizers}/byte_bpe_50k.json")
    return tokens.counted(read(spark, sf_dir, "documents"), vocabulary)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_quality_rules,
        op3_ogg,
        op4_ordinal_quality,
        op5_pii,
        op6_license_scan,
        op7_mixing,
        op8_language_id,
        op9_token_counts,
        op10_near_dedup,
    )
}

ORACLES: dict[str, str] = {"op6_license_scan": oracles.license_scan(), "op7_mixing": oracles.mixing(SHORT), "op10_near_dedup": oracles.near_duplicates(85)}
