"""Search over several stored collections at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.ann import AnnParams
from corvane.operators.fusion import RRF_K, fuse_datasets
from corvane.operators.store import VectorTable
from corvane.schema import ConfigError
from corvane.session import cut_lineage


@dataclass(frozen=True)
class SearchTarget:
    """A dataset's collection and how queries are embedded for it; targets of one ``model_key`` share the vectors."""

    name: str
    model_key: str
    embedder: Callable[[Column], Column]
    store: VectorTable
    collection: str
    params: AnnParams | None = None


def search_across(targets: Sequence[SearchTarget], queries: DataFrame, k: int = 5, *, rrf_k: int = RRF_K) -> DataFrame:
    """``qid, rank, rrf_score, uri, ordinal, dataset, score, label, chunk_text``: one fused ranking per query.

    ``queries`` has ``qid, text``. Every distinct model embeds them once; each collection, whatever its width, is
    searched with its own model's vectors for its top ``k``; only ranks are fused, never scores. A chunk of several
    datasets adds up its contributions and shows the dataset of the largest (the first target among equals).
    """
    if not targets:
        raise ConfigError("no datasets to search")
    vectors: dict[str, DataFrame] = {}
    hits: DataFrame | None = None
    for pos, target in enumerate(targets):
        if target.model_key not in vectors:
            vectors[target.model_key] = cut_lineage(queries.select("qid", target.embedder(F.col("text")).alias("vector")))
        found = target.store.search(target.collection, vectors[target.model_key], k, target.params)
        one = found.select(
            "qid", F.lit(target.name).alias("dataset"), F.lit(pos).alias("list_pos"), "rank", "uri", "ordinal", "score", "label", "chunk_text"
        )
        hits = one if hits is None else hits.unionByName(one)
    return fuse_datasets(hits, k, k=rrf_k)
