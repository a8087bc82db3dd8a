"""A corpus pipeline: each stage reads the documents that the one before it wrote, and decides by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import exact_dedup, near_jaccard, packing, toxicity
from seriesmill.llm.common import shared_path, stored, table

DIGEST = "__digest"


def kept(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of ``docs``, with its columns, for each pair of doc_id and digest in ``rows``, however often it is in either.

    An id is not enough to name a row: rows may share one and differ in text,
    or have none.
    """
    counts = rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    keys = stored(counts.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__key"), "n"), "kept")
    named = docs.withColumn(DIGEST, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col(DIGEST) == F.col("__key"))
    single = named.join(keys.where("n = 1"), here, "left_semi").select(docs.columns)
    more = keys.where("n > 1")
    if more.isEmpty():
        return single
    return single.union(named.join(more, here, "left_semi").dropDuplicates(["doc_id", DIGEST]).select(docs.columns))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the severity model rejects go; all others stay, whatever their id.

    The model learns from the labelled rows among ``docs``.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(~toxicity.rejected(model))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, one with the largest doc_id."""
    found = exact_dedup.exact_dedup(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    return kept(docs, found.where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts with a 5-word Jaccard similarity of 0.8 or more one row stays, one with the smallest doc_id.

    Candidates are the texts that op3's SimHash operator links, and those of
    MinHash bands, for similar texts may differ in more bits than its blocks
    reach; whole sets decide. Rows without an id come last; of rows that share
    the id that of least text digest stays.
    """
    found = near_jaccard.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("first")
    return kept(docs, found.groupBy("class_id").agg(first).select("first.doc_id", "first.digest"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed bins."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("exact_dedup", exact), ("near_dedup", near), ("packing", packed)]

#: The severity model and MinHash have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
