"""Long word spans repeated across documents: a de Bruijn graph of word windows, compacted to source spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import id_back, in_filter, keyed, lists, map_batches, stored, texts
from corvane.llm.shingles import minimizers, rolling, word_hashes

MER = 32  # words of an anchor; a window of WINDOW words always holds one
WINDOW = 50
EDGES = 200_000  # rows of an outgoing batch


def tag_of(words: list[bytes]) -> int:
    """Tells apart the texts of rows that repeat an id."""
    return xxhash.xxh32_intdigest(b" ".join(words)) - (1 << 31)


def anchors(rows: DataFrame, window: int, mer: int) -> DataFrame:
    """``id, tag, n, digest, mers``: per text of at least ``window`` words its distinct anchors, and a digest of all words."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, tags, sizes, digests, found = [], [], [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            words = text.split()
            if len(words) < window:
                continue
            mers = rolling(word_hashes(words), mer)
            chosen, _ = minimizers(mers, window - mer + 1)
            ids.append(doc)
            tags.append(tag_of(words))
            sizes.append(len(words))
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            found.append(np.unique(mers[chosen]).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(tags, pa.int32()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists(found, pa.int64())],
            ["id", "tag", "n", "digest", "mers"],
        )

    return map_batches(rows, run, "id long, tag int, n long, digest binary, mers array<long>")


def edges(df: DataFrame, window: int, mer: int) -> DataFrame:
    """``id, tag, start, edge`` for every window whose least anchor occurs in two documents.

    ``df`` has ``id, text, tag, mers``: the anchors of that text that occur in two documents. Equal windows have
    equal least anchors, so no repeated window is missed.
    """

    def out(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sizes = [len(f[2]) for f in found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.array([f[0] for f in found], np.int64), sizes)),
                pa.array(np.repeat(np.array([f[1] for f in found], np.int32), sizes)),
                pa.array(np.concatenate([f[2] for f in found])), pa.array(np.concatenate([f[3] for f in found])),
            ],
            ["id", "tag", "start", "edge"],
        )

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for doc, text, tag, shared in zip(
            batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3), strict=True
        ):
            words = text.split()
            if tag_of(words) != tag:
                continue
            hashes = word_hashes(words)
            _, least = minimizers(rolling(hashes, mer), window - mer + 1)
            known = np.sort(shared.values.to_numpy().view(np.uint64))
            at = np.minimum(np.searchsorted(known, least), len(known) - 1)
            starts = np.flatnonzero(known[at] == least)
            found.append((doc, tag, starts.astype(np.int32), rolling(hashes, window)[starts].view(np.int64)))
            size += len(starts)
            if size > EDGES:  # a batch of very long texts leaves in several
                yield out(found)
                found, size = [], 0
        if size:
            yield out(found)

    return map_batches(df.select("id", "text", "tag", "mers"), run, "id long, tag int, start int, edge long")


def paths(repeated: DataFrame, window: int) -> DataFrame:
    """Nonbranching paths of repeated edges: ``id, tag, first, n_words, source_id, source_tag, source_first``.

    An edge continues the one before it when both follow each other in the document and in its source too;
    everything else (a fork, a change of source) starts another path.
    """
    walk = W.partitionBy("id", "tag").orderBy("start")
    before = lambda c: F.lag(c).over(walk)
    same = (
        (before("start") == F.col("start") - 1) & (before("source.id") == F.col("source.id"))
        & (before("source.tag") == F.col("source.tag")) & (before("source.start") == F.col("source.start") - 1)
    )
    marked = repeated.withColumn("head", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn(
        "path", F.sum("head").over(walk)
    )
    return marked.groupBy("id", "tag", "path").agg(
        F.min("start").alias("first"), (F.max("start") - F.min("start") + window).alias("n_words"),
        F.first("source.id").alias("source_id"), F.first("source.tag").alias("source_tag"),
        F.min("source.start").alias("source_first"),
    ).drop("path")


def span_digests(df: DataFrame, spans: DataFrame) -> DataFrame:
    """``no, digest``: 128 bits of the words at the coordinates ``id, tag, first, n_words`` of span ``no``."""
    asked = spans.groupBy("id", "tag").agg(F.collect_set(F.struct("no", "first", "n_words")).alias("spans"))
    found = in_filter(df, "id", asked, "id").join(asked, "id").select("text", "tag", "spans")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        no, digest = [], []
        for text, tag, asked in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            if tag_of(words) == tag:
                for s in asked:
                    no.append(s["no"])
                    digest.append(xxhash.xxh3_128_digest(b" ".join(words[s["first"] : s["first"] + s["n_words"]])))
        yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(digest, pa.binary())], ["no", "digest"])

    return map_batches(found, run, "no long, digest binary").distinct()


def repeated_spans(df: DataFrame, window: int = WINDOW, mer: int = MER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified spans ``id, tag, first, n_words, source_id, source_tag, source_first`` of words that a smaller id holds too.

    1. Anchors: the least hashed ``mer`` of every window; those of two documents are found with one small shuffle.
    2. Edges: windows with such an anchor are grouped by hash; the least ``(id, start)`` is an edge's source.
    3. Paths: repeated edges compact to spans along document and source.
    4. Both texts are read at the span's coordinates and must give the same words.

    Documents that equal a smaller one word for word are spans as a whole and take no part in 2 and 3, so a
    large group of copies costs one row per copy.
    """
    rows = keyed(df, id_col, text_col)
    table = stored(anchors(rows, window, mer), "anchors")
    # aggregates are written before they are joined with what they come from: only then may the skew join split a frequent key
    first = stored(table.groupBy("digest").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper < last").drop("last"), "first")
    alike = stored(table.select("id", "tag", "n", "digest").join(first, "digest").where("id <> keeper"), "copies")
    copies = alike.select(
        "id", "tag", F.lit(0).alias("first"), F.col("n").cast("int").alias("n_words"), F.col("keeper").alias("source_id"),
        F.col("tag").alias("source_tag"), F.lit(0).alias("source_first"),
    ).distinct()
    alone = table.join(alike.select("id", "tag").distinct(), ["id", "tag"], "left_anti")
    mers = alone.select("id", "tag", F.explode("mers").alias("mer"))
    shared = stored(mers.groupBy("mer").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("mer"), "mers")
    asked = stored(mers.join(shared, "mer").groupBy("id", "tag").agg(F.collect_set("mer").alias("mers")), "asked")
    some = in_filter(rows, "id", asked, "id").join(asked, "id").select("id", "text", "tag", "mers")
    walked = stored(edges(some, window, mer), "edges")
    source = stored(walked.groupBy("edge").agg(
        F.min(F.struct("id", "tag", "start")).alias("source"), F.max("id").alias("last")
    ).where("source.id < last").drop("last"), "sources")
    repeated = walked.join(source, "edge").where(F.col("id") > F.col("source.id")).drop("edge")
    found = paths(repeated, window).unionByName(copies)
    # numbers are hashes of what they stand for, so they stay the same when a task runs again
    spans = found.distinct().withColumn("no", F.xxhash64("id", "tag", "first", "n_words"))
    spans = stored(spans.withColumn("source_no", F.xxhash64("source_id", "source_tag", "source_first", "n_words")), "spans")
    own = span_digests(rows, spans.select("id", "tag", "first", "n_words", "no"))
    # a source's span is read once, however many documents repeat it
    origin = [F.col(f"source_{c}").alias(c) for c in ("id", "tag", "first")]
    theirs = span_digests(rows, spans.select(*origin, "n_words", F.col("source_no").alias("no")).distinct())
    same = spans.join(own, "no").join(theirs.withColumnRenamed("no", "source_no"), ["source_no", "digest"])
    return stored(same.drop("no", "source_no", "digest").distinct(), "verified")


def dedup_spans(df: DataFrame, window: int = WINDOW, mer: int = MER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, text``: every row without the words that a smaller id's document has in a window.

    A word goes when some window of ``window`` consecutive words that covers it also starts in a document with a
    smaller id; windows are judged on the input. Kept words are joined by one space.

    A null or empty text has no words and becomes an empty text; texts under ``window`` words lose nothing. Rows that
    repeat an id are one document's texts: neither takes words from the other. A null id comes after all
    others. An empty table gives an empty one; other columns are not read.
    """
    rows = keyed(df, id_col, text_col)
    spans = repeated_spans(df, window, mer, id_col, text_col)
    lost = spans.groupBy("id").agg(F.collect_list(F.struct("tag", "first", "n_words")).alias("spans"))
    hit = in_filter(rows, "id", spans, "id").join(lost, "id", "left")
    miss = not_in_filter(rows, spans).withColumn("spans", F.lit(None).cast("array<struct<tag:int,first:int,n_words:int>>"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, gone, kept = [], [], []
        for text, found in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            tag = tag_of(words) if found else 0
            lost = np.zeros(len(words), dtype=bool)
            for s in found or []:
                if s["tag"] == tag:
                    lost[s["first"] : s["first"] + s["n_words"]] = True
            left = [w for w, x in zip(words, lost.tolist(), strict=True) if not x] if found else words
            sizes.append(len(words))
            gone.append(len(words) - len(left))
            kept.append(b" ".join(left))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
            ["id", "n_words", "n_removed", "text"],
        )

    out = map_batches(hit.unionByName(miss), run, "id long, n_words long, n_removed long, text string")
    return out.select(id_back("id").alias("doc_id"), "n_words", "n_removed", "text")


def not_in_filter(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows that ``in_filter`` leaves out: surely without a span, so they need no shuffle."""
    return in_filter(rows, "id", spans, "id", keep=False)
