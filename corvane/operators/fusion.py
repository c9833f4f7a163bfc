"""Rank fusion and the orderings around it. Raw scores of different systems are never compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60  # fixed value: the damping constant
FUSED_DECIMALS = 12  # sums of reciprocals are compared after rounding, so their order decides nothing


def contribution(rank: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def fuse_datasets(hits: DataFrame, limit: int, *, k: int = RRF_K) -> DataFrame:
    """Fuse per-dataset lists of chunks.

    ``hits``: ``qid, dataset, list_pos, rank, uri, ordinal`` plus payload columns. A chunk listed
    by several datasets adds up its contributions; its dataset and payload come from the single
    largest one, and from the first list among equals.
    """
    payload = [c for c in hits.columns if c not in ("qid", "uri", "ordinal", "rank", "list_pos")]
    fused = hits.groupBy("qid", "uri", "ordinal").agg(
        F.round(F.sum(contribution(F.col("rank"), k)), FUSED_DECIMALS).alias("rrf_score"),
        F.min_by(F.struct(*payload), F.struct("rank", "list_pos")).alias("_best"),
    )
    order = Window.partitionBy("qid").orderBy(F.desc("rrf_score"), "uri", "ordinal")
    return (
        fused.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .select("qid", "rank", "rrf_score", "uri", "ordinal", "_best.*")
    )


def fuse_documents(
    rankings: DataFrame, limit: int, *, k: int = RRF_K, segments: Sequence[str] = (), doc: str = "doc_id"
) -> DataFrame:
    """Fuse document rankings (``qid, system, doc_id, rank``); ties by best rank, then id."""
    keys = ["qid", *segments]
    fused = rankings.groupBy(*keys, doc).agg(
        F.round(F.sum(contribution(F.col("rank"), k)), FUSED_DECIMALS).alias("rrf_score"),
        F.min("rank").alias("best_rank"),
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("rrf_score"), "best_rank", doc)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def first_distinct_documents(
    chunk_ranking: DataFrame, limit: int, *, segments: Sequence[str] = (), doc: str = "doc_id"
) -> DataFrame:
    """A ranking of chunks as a ranking of the distinct documents in it, order kept."""
    keys = ["qid", *segments]
    best = chunk_ranking.groupBy(*keys, doc).agg(F.min("rank").alias("chunk_rank"))
    order = Window.partitionBy(*keys).orderBy("chunk_rank")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def rerank(shortlist: DataFrame, score: Column, *, decimals: int = 6) -> DataFrame:
    """Re-order each query's shortlist by a pair score; equal scores keep their order."""
    scored = shortlist.withColumn("pair_score", F.round(score, decimals))
    order = Window.partitionBy("qid").orderBy(F.desc("pair_score"), "rank")
    return scored.withColumn("new_rank", F.row_number().over(order))
