"""Change streams: bursts of file events become one reconcile each, exactly once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.index import reconcile
from corvane.operators.lifecycle import IndexPlan
from corvane.operators.store import VectorTable
from corvane.schema import Dataset
from corvane.sources.connector import ListingPulse
from corvane.sources.files import read_documents

DEBOUNCE = "400 milliseconds"  # fixed value: the quiet gap that ends a burst


def burst_windows(events: DataFrame, by: Sequence[str], ts: str = "ts", gap: str = DEBOUNCE, late: str | None = None) -> DataFrame:
    """``by..., start, end, changes``: one row per burst. Works on a stream and on a table.

    A busy key's events meet in one task; :func:`burst_slices` spreads a table's over time slices.
    """
    rows = events.withWatermark(ts, late) if late else events
    grouped = rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("changes"))
    return grouped.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


def burst_slices(events: DataFrame, by: Sequence[str], ts: str = "ts", gap_seconds: float = 0.4, unit: str = "hour") -> DataFrame:
    """:func:`burst_windows` of a table, without gathering a busy key: the walk goes by time slices.

    An event's predecessor is the one before it in its slice, or the last one of the slice before; a burst's
    number is the bursts that began in earlier slices plus those in its own.
    """
    by, gap = list(by), round(gap_seconds * 1e6)
    rows = events.select(*by, F.col(ts).alias("_ts"), F.date_trunc(unit, F.col(ts)).alias("_slice"))
    slices = Window.partitionBy(*by).orderBy("_slice")
    inside = Window.partitionBy(*by, "_slice").orderBy("_ts").rowsBetween(Window.unboundedPreceding, 0)
    last = rows.groupBy(*by, "_slice").agg(F.max("_ts").alias("_last")).withColumn("_prior", F.lag("_last").over(slices)).drop("_last")
    before = F.coalesce(F.lag("_ts").over(Window.partitionBy(*by, "_slice").orderBy("_ts")), F.col("_prior"))
    apart = F.unix_micros("_ts") - F.unix_micros(before) >= gap
    marked = rows.join(last, [*by, "_slice"]).withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    begun = marked.groupBy(*by, "_slice").agg(F.sum("_new").alias("_n"))
    begun = begun.select(*by, "_slice", (F.sum("_n").over(slices) - F.col("_n")).alias("_done"))
    numbered = marked.withColumn("_in", F.sum("_new").over(inside)).join(begun, [*by, "_slice"])
    bursts = numbered.groupBy(*by, (F.col("_done") + F.col("_in")).alias("_burst")).agg(
        F.min("_ts").alias("start"), F.max("_ts").alias("_end"), F.count("*").alias("changes")
    )
    return bursts.select(*by, "start", F.timestamp_micros(F.unix_micros("_end") + gap).alias("end"), "changes")


def last_known(
    changes: DataFrame, *, key: str = "uri", schema: str = "uri string, status string, content_hash string"
) -> DataFrame:
    """Per-URI state over a change stream (``uri, kind, content_hash, seq``): what changed.

    A burst counts once: of a URI's changes in one micro-batch only the latest (by ``seq``) is
    judged against the remembered hash, as ``new``, ``changed``, ``unchanged`` or ``vanished``.
    The step keeps one row, however many changes a URI has.
    """

    def step(uri: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = state.get[0] if state.exists else None
        latest: tuple | None = None
        for rows in batches:
            row = rows.loc[rows["seq"].idxmax()]
            if latest is None or row["seq"] > latest[0]:
                latest = (row["seq"], row["kind"], row["content_hash"])
        if latest is None:
            return
        _, kind, content = latest
        if kind == "deleted":
            if known is not None:
                state.remove()
                yield pd.DataFrame([(uri[0], "vanished", known)], columns=["uri", "status", "content_hash"])
            return
        status = "new" if known is None else "unchanged" if known == content else "changed"
        state.update((content,))
        yield pd.DataFrame([(uri[0], status, content)], columns=["uri", "status", "content_hash"])

    return changes.groupBy(key).applyInPandasWithState(step, schema, "content_hash string", "append", "NoTimeout")


def watch(
    spark: SparkSession, dataset: Dataset, store: VectorTable, plan: IndexPlan, *, checkpoint: str,
    extensions: Sequence[str] = (".md", ".txt"), on_report: Callable[[int, DataFrame], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery | None:
    """Follow the dataset's folders; every micro-batch of changes is one reconcile.

    A dataset without roots, or one that is read-only or written by hand, is not watched. The
    micro-batch number travels into the commit together with the checkpoint it counts for, so a batch
    replayed after a failure changes nothing and a new checkpoint starts anew. A file that cannot be
    read keeps the rows it had, is counted as an error, and does not stop the stream.
    """
    if not dataset.watched:
        return None

    def apply(changes: DataFrame, batch: int) -> None:
        if store.last_batch(dataset.collection, checkpoint) >= batch or changes.isEmpty():
            return
        listing = read_documents(
            changes.sparkSession, dataset.roots, label=dataset.name, extensions=extensions, ignore_case=True
        )
        report = reconcile(store, dataset.collection, listing, plan, batch=batch, stream=checkpoint)
        if on_report is not None:
            on_report(batch, report)

    spark.dataSource.register(ListingPulse)
    pulses = (
        spark.readStream.format("corvane_pulse")
        .option("paths", ",".join(dataset.roots))
        .option("extensions", ",".join(extensions))
        .load()
    )
    writer = pulses.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "400 milliseconds"})).start()


def fold_points(events: DataFrame, by: str, ts: str, order: str, after_records: int) -> DataFrame:
    """Which events fall due a compaction that runs after every ``after_records`` new rows.

    With only the record trigger the due events are every n-th one of their key, which a count
    over order decides; no fold over state is needed. The count runs in two steps, so that one
    busy key is not one task: rows are counted per time slice, and a slice's rows are numbered
    from its starting count.
    """
    sliced = events.withColumn("_slice", F.date_trunc("hour", F.col(ts)))
    per_slice = sliced.groupBy(by, "_slice").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select(by, "_slice", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(by, "_slice").orderBy(ts, order)
    numbered = sliced.join(starts, [by, "_slice"]).withColumn(
        "records", F.col("_before") + F.row_number().over(inside)
    )
    return numbered.where(F.col("records") % after_records == 0).drop("_slice", "_before")
