"""The given tables seen through this engine's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import doc_uri
from corvane.operators.chunking import chunk_whitespace
from corvane.operators.embed import hash_embedder

DIM = 64  # width of the hash embedding the registered plans use
CAP = 64  # whitespace tokens per chunk


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan yields fewer splits than cores.

    A large table has more splits than cores and is left alone, so nothing shuffles there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a source listing."""
    return documents(spark, sf).select(
        doc_uri(F.col("doc_id")).alias("uri"),
        F.col("source").alias("label"),
        F.sha2("text", 256).alias("content_hash"),
        F.lit(0.0).alias("mtime"),
        "text",
    )


def chunks(spark: SparkSession, sf: str, cap: int = CAP, overlap: int = 0) -> DataFrame:
    """``doc_id, lang, source, ordinal, token_count, text`` of every document."""
    docs = documents(spark, sf).select("doc_id", "lang", "source", "text")
    return chunk_whitespace(docs, cap, overlap=overlap)


FEW_IDS = 1_000_000


def chunks_of(spark: SparkSession, sf: str, ids: DataFrame, cap: int = CAP) -> DataFrame:
    """The chunks of the documents in ``ids`` (``doc_id``); few ids are sent to the documents, not the other way round."""
    wanted = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    docs = documents(spark, sf).select("doc_id", "lang", "source", "text").join(wanted, "doc_id", "left_semi")
    return chunk_whitespace(docs, cap)


def embedded(spark: SparkSession, sf: str, cap: int = CAP, overlap: int = 0, dim: int = DIM) -> DataFrame:
    return chunks(spark, sf, cap, overlap).withColumn("vector", hash_embedder(dim, "md5")(F.col("text")))


def passages(spark: SparkSession, sf: str, dim: int = DIM) -> DataFrame:
    """The benchmark passages as queries: ``qid, text, vector``."""
    return (
        table(spark, sf, "benchmark")
        .select(F.col("item_id").alias("qid"), "text")
        .withColumn("vector", hash_embedder(dim, "md5")(F.col("text")))
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label"
    )


def class_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One query per label: the mean of its vectors (``qid`` is the label)."""
    wide = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("at", "x"))
    means = wide.groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return (
        means.groupBy("label")
        .agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("cells"))
        .select(F.col("label").alias("qid"), F.col("cells.x").alias("vector"))
    )
