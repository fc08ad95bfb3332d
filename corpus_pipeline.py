"""The corpus pipeline: language ID, near duplicates, personal data, mixing, packing.

Each stage works on all rows its predecessor kept, written as Parquet and read again. All but the last return the
columns of documents, whatever further ones there are and whatever their names: rows are carried as one struct.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemeter.llm import langid, mixing, neardup, packing, pii
from prosemeter.llm.common import bounded_batches, materialise, n_words, shared_dir
from prosemeter.llm.queries import CAPACITY, SHORT, held_out


def _carried(docs: DataFrame, *others: Column) -> DataFrame:
    """Rows as one struct `row`, so that no column of docs meets a column of ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *others)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models know; lang becomes the predicted one. Rejected documents go.

    Null texts, and those without a letter, have no language and go; so do texts of languages that were not learned.
    Null languages and ids are not learned from, but such rows stay if their text does. Repeated rows stay as often as
    they stand. An empty table gives an empty one, and one without any language loses all rows.
    """
    bounded_batches(spark)
    model = langid.fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    told = _carried(docs, langid.predict(F.col("text"), model, spark).alias("told")).where(~F.col("told.rejected"))
    return told.select(F.col("row").withField("lang", F.col("told.lang")).alias("row")).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id.

    Of several rows of that id, equal or not, one stays: the first by the hash of its text and of its other columns, so
    that reruns agree. Rows of null id are linked with nothing and all stay; so do documents without words. An empty
    table gives an empty one.
    """
    bounded_batches(spark)
    kept = neardup.near_duplicates(docs, percent=80).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = _carried(docs, F.col("doc_id").alias("id"), F.md5(F.col("text").cast("binary")).alias("own"))
    rows = rows.withColumn("whole", F.xxhash64(F.to_json("row")))
    named = rows.where("id IS NOT NULL").join(kept.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    one = named.groupBy("id").agg(F.min_by("row", F.struct("own", "whole")).alias("row"))
    return one.select("row.*").unionByName(rows.where("id IS NULL").select("row.*"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced by its kind; n_chars counts the new text.

    Null and empty texts, null ids and repeated rows stay as they are; an empty table gives an empty one.
    """
    bounded_batches(spark)
    found = pii.find(_carried(docs), ["row"], text_col="row.text").select("row.row", "spans")
    text = F.when(F.col("spans") == "", F.col("row.text")).otherwise(pii.redacted(F.col("row.text"), F.col("spans")))
    clean = found.select("row", text.alias("clean"))
    row = F.col("row").withField("text", F.col("clean")).withField("n_chars", F.length("clean").cast("long"))
    return clean.select(row.alias("row")).select("row.*")


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, rows of null id too; one without words is not taken.

    Rows are numbered and written before they are mixed, and their copies are joined by that number: ids may be null or
    repeated. An empty table gives an empty one.
    """
    prior = lambda size: F.when(size < SHORT, 0.5).otherwise(1.0)
    rows = materialise(_carried(docs, F.monotonically_increasing_id().alias("uid")), "mix-rows")
    flat = rows.select("uid", F.col("row.doc_id"), F.col("row.source"), F.col("row.text"))
    taken = mixing.mixed(flat, n_words(F.col("text")), prior, carry={"uid": F.col("uid")}).where("copies > 0").select("uid", "copies")
    copied = rows.join(taken, "uid").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return copied.select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins: a row for each piece of each document.

    Documents without words are one piece of size 0; null ids and sources, and repeated rows, are packed as they stand.
    An empty table gives no bin.
    """
    return packing.pack(docs, n_words(F.col("text")), CAPACITY)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mixing_weights),
    ("packing", best_fit_packing),
]

#: No stage but mixing can be expressed in SQL; the tests hold the pipeline against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES on documents, each written to the shared folder and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        df = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return df
        df.write.parquet(f"{at}/{i}-{name}")
        docs = spark.read.parquet(f"{at}/{i}-{name}")
    return docs
