"""Index, reconcile, remember and forget over a :class:`~corvane.operators.store.VectorTable`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.lifecycle import CHANGED, NEW, VANISHED, IndexPlan, reconcile_diff, reconcile_report, remembered
from corvane.operators.store import VectorTable
from corvane.schema import SOURCES, Dataset
from corvane.session import cut_lineage

SOURCE_COLUMNS = [f.name for f in SOURCES.fields]


def index_sources(store: VectorTable, name: str, docs: DataFrame, plan: IndexPlan, *, batch: int | None = None) -> bool:
    """Write ``docs`` into the collection, replacing whatever their URIs held."""
    return store.replace(name, plan.rows(docs), docs.select(*SOURCE_COLUMNS), batch=batch)


def reconcile(
    store: VectorTable, name: str, listing: DataFrame, plan: IndexPlan, *, batch: int | None = None, stream: str = ""
) -> DataFrame:
    """Bring the collection in line with a full listing (the document table): one commit.

    Returns the one-row report ``indexed, pruned, unchanged, errors``. Unchanged sources are neither
    extracted nor embedded again. A source that is listed with an ``error`` keeps the rows it had. The
    difference is written to the shared folder once, with all that a commit needs of a source besides its
    text, as the commit changes the very table it was computed from.
    """
    diff = cut_lineage(reconcile_diff(listing, store.source_hashes(name), carry=["label", "mtime"]))
    wanted = diff.where(F.col("status").isin(NEW, CHANGED)).select(*SOURCE_COLUMNS)
    docs = listing.join(wanted.select("uri"), "uri", "left_semi")
    vanished = diff.where(F.col("status") == VANISHED).select("uri")
    store.replace(name, plan.rows(docs), wanted, vanished, batch=batch, stream=stream)
    return reconcile_report(diff)


def remember(store: VectorTable, dataset: Dataset, notes: DataFrame, plan: IndexPlan, id_col: str, text_col: str, order_col: str) -> bool:
    """Write notes into a writable dataset, one document per id; the latest write of an id stands."""
    dataset.check_write()
    return index_sources(store, dataset.collection, remembered(notes, dataset.name, id_col, text_col, order_col), plan)


def reindex(store: VectorTable, dataset: Dataset, listing: DataFrame, plan: IndexPlan) -> DataFrame:
    """Reconcile a dataset that may be reindexed."""
    dataset.check_reindex()
    return reconcile(store, dataset.collection, listing, plan)


def forget(store: VectorTable, name: str, uris: DataFrame) -> None:
    """Delete the URIs' rows; only files that hold one of them are rewritten."""
    store.delete(name, uris)
