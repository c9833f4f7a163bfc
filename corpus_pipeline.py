"""A training-text pipeline: quality, shared lines, near copies, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and returns what it keeps, with the same
columns; the last returns the packed pieces. A stage's result is written and read again before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import jaccard, lines, packing, pii, quality
from corvane.llm.common import NO_ID, filter_bits, filtered, fresh, id_filter, stored
from corvane.llm.queries import packing_files, rated_model

KEEP = 0.5  # least chance of the best grade
ORACLE_SQL = None  # model, personal-data and packing stages are beyond SQL; tests hold run() against brute force


def with_text(name: str, text, docs: DataFrame):
    if name == "text":
        return text.alias(name)
    return F.char_length(text).cast(docs.schema[name].dataType).alias(name) if name == "n_chars" else F.col(name)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the best grade is at least ``KEEP``; the model is fitted to the labelled documents."""
    return quality.keep(docs, rated_model(spark, sf_dir), KEEP)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that one with a smaller id holds too."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = lines.dedup_lines(docs, carry=others).select("doc_id", "text", *[F.col("rest")[c].alias(c) for c in others])
    return out.select(*[with_text(c, F.col("text"), docs) for c in docs.columns])


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones: that with the smallest id. Only rows whose id may go are shuffled.

    Rows without an id are one document that comes after all others, as in the join: where it is linked, they go.
    """
    groups = stored(jaccard.near_components(docs), "groups")
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("gone_id")).distinct()
    named = docs.withColumn(key := fresh(docs, "gone_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    gone = stored(gone.withColumnRenamed("gone_id", key), "gone")
    known = spark.sparkContext.broadcast(id_filter(gone, key, bits := filter_bits(gone)))
    maybe = filtered(named, key, known, bits).join(gone, key, "left_anti").select(*docs.columns)
    return maybe.unionByName(filtered(named, key, known, bits, keep=False).select(*docs.columns))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    out = pii.redact(docs)
    return out.select(*[with_text(c, F.col("text"), docs) for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 1024 tokens."""
    return packing.pack(docs, *packing_files())


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_copies", near_copy_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
