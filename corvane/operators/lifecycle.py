"""Incremental indexing: what changed, and the one plan that turns sources into vector rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.chunking import chunk_whitespace
from corvane.operators.sanitize import SanitizeOptions, sanitize
from corvane.operators.stats import prefix_sums

NEW, CHANGED, UNCHANGED, VANISHED, FAILED = "new", "changed", "unchanged", "vanished", "failed"


def reconcile_diff(current: DataFrame, indexed: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``uri, content_hash, status, carry...`` for every URI on either side (both keyed by ``uri``).

    A new or changed source with an ``error`` has failed: it is listed, so it has not vanished, but
    there is nothing to index.
    """
    failed = F.col("error").isNotNull() if "error" in current.columns else F.lit(False)
    now = current.select("uri", F.col("content_hash").alias("now"), failed.alias("failed"), *carry)
    was = indexed.select("uri", F.col("content_hash").alias("was"))
    status = (
        F.when(F.col("now").isNull(), VANISHED)
        .when(F.col("now") == F.col("was"), UNCHANGED)
        .when(F.col("failed"), FAILED)
        .when(F.col("was").isNull(), NEW)
        .otherwise(CHANGED)
    )
    return now.join(was, "uri", "full_outer").select("uri", F.coalesce("now", "was").alias("content_hash"), status.alias("status"), *carry)


def reconcile_report(diff: DataFrame) -> DataFrame:
    return diff.agg(
        F.count_if(F.col("status").isin(NEW, CHANGED)).alias("indexed"),
        F.count_if(F.col("status") == VANISHED).alias("pruned"),
        F.count_if(F.col("status") == UNCHANGED).alias("unchanged"),
        F.count_if(F.col("status") == FAILED).alias("errors"),
    )


def moves_by_content(diff: DataFrame) -> DataFrame:
    """Contents that vanished under one URI and turned up under a new one: ``content_hash, old_uri, new_uri, n_old, n_new``,
    a row per content with the first URI of each side."""
    gone, came = F.col("status") == VANISHED, F.col("status") == NEW
    moved = diff.where(gone | came).groupBy("content_hash").agg(
        F.min(F.when(gone, F.col("uri"))).alias("old_uri"),
        F.min(F.when(came, F.col("uri"))).alias("new_uri"),
        F.count_if(gone).alias("n_old"),
        F.count_if(came).alias("n_new"),
    )
    return moved.where((F.col("n_old") > 0) & (F.col("n_new") > 0))


def move_detect(diff: DataFrame) -> DataFrame:
    """``content_hash, old_uri, new_uri``: every move once.

    The vanished URIs of a content and its new ones are matched by rank, in order of the URI; copies that only one side
    has more of were deleted or added, not moved. Ranks are prefix sums over ranges of URIs, so a content with very
    many copies (an empty or boilerplate file) is spread over tasks, and the join is on content and rank.
    """
    sides = diff.where(F.col("status").isin(VANISHED, NEW)).select("content_hash", "status", "uri", F.lit(1).alias("one"))
    ranked = prefix_sums(sides, ["content_hash", "status"], "uri", "one", "nth")
    old, new = (ranked.where(F.col("status") == s).select("content_hash", "nth", F.col("uri").alias(c)) for s, c in ((VANISHED, "old_uri"), (NEW, "new_uri")))
    return old.join(new, ["content_hash", "nth"]).select("content_hash", "old_uri", "new_uri")


@dataclass(frozen=True)
class IndexPlan:
    """How sources become vector rows; the same plan serves bulk, reconcile and single writes."""

    embedder: Callable[[Column], Column]
    dim: int
    chunker: Callable[[DataFrame], DataFrame] | None = None
    max_tokens: int = 256
    sanitize: SanitizeOptions | None = None
    sanitize_mode: str = "dry_run"
    summarizer: Callable[[Column], Column] | None = None

    def rows(self, docs: DataFrame) -> DataFrame:
        """``docs`` (the document table) as vector rows without ``seq``; narrow up to here."""
        ready = docs
        if self.sanitize is not None:
            ready = sanitize(ready, self.sanitize, mode=self.sanitize_mode).drop("spans", "removed_chars")
        summary = self.summarizer(F.col("text")) if self.summarizer else F.lit(None).cast("string")
        ready = ready.withColumn("summary", summary)
        chunks = self.chunker(ready) if self.chunker else chunk_whitespace(ready, self.max_tokens)
        return chunks.withColumn("vector", self.embedder(F.col("text"))).select(
            "uri", "label", "content_hash", "mtime", F.col("ordinal").cast("int").alias("ordinal"),
            F.col("token_count").cast("int").alias("token_count"), "text", "summary", "vector",
        )


def remembered(notes: DataFrame, dataset: str, id_col: str, text_col: str, order_col: str) -> DataFrame:
    """Notes as documents of a writable dataset: one per id, the latest write wins."""
    from corvane.functions.text import percent_encode

    latest = notes.groupBy(id_col).agg(F.max_by(text_col, order_col).alias("text"))
    return latest.select(
        F.concat(F.lit(f"corvane://{dataset}/"), percent_encode(F.col(id_col).cast("string"))).alias("uri"),
        F.lit(dataset).alias("label"),
        F.sha2("text", 256).alias("content_hash"),
        F.lit(0.0).alias("mtime"),
        "text",
    )


def compaction_due(records: Column, seconds: Column, after_records: int, after_seconds: float) -> Column:
    """Fold now? New rows exist, and one of the enabled triggers has been reached."""
    by_records = (records >= after_records) if after_records > 0 else F.lit(False)
    by_time = (seconds >= after_seconds) if after_seconds > 0 else F.lit(False)
    return (records > 0) & (by_records | by_time)
