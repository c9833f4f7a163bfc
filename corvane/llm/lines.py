"""Dropping lines that several documents share, with two Bloom filters before any shuffle of lines."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BLANKS, id_back, keyed, map_partitions, stored, texts

SLICE = 1 << 16  # bytes of a filter that travel together


def line_key(line: bytes, least: int) -> bytes | None:
    """The line without outer blanks and with A-Z in lower case; None when shorter than ``least`` code points."""
    key = line.strip(BLANKS).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return key


def distinct_keys(text: bytes, least: int) -> set[bytes]:
    return {k for k in (line_key(line, least) for line in text.split(b"\n")) if k is not None}


def places(keys: list[bytes], bits: int) -> np.ndarray:
    """Two filter places per key, one row each."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))
    mask = np.uint64(bits - 1)
    return np.stack([h & mask, (h >> np.uint64(32)) & mask], axis=1).astype(np.int64)


def seen_in(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1


def twice_seen(df: DataFrame, bits: int, least: int) -> np.ndarray:
    """The filter of keys that may be in two documents or more, ``bits / 8`` bytes whatever the input.

    Each task fills a filter of keys it has seen once and one of keys it has seen again. Filters merge slice
    by slice: twice-seen ones are united, and what two once-seen ones have in common is twice-seen.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            keys = [k for t in texts(batch.column(1)) for k in distinct_keys(t, least)]
            if not keys:
                continue
            at = places(keys, bits)
            fresh = np.unique(at, axis=0, return_counts=True) if len(at) > 1 else (at, np.ones(1, dtype=np.int64))
            again = fresh[0][(fresh[1] > 1) | (seen_in(once, fresh[0]).all(axis=1))].ravel()
            np.bitwise_or.at(twice, again >> 3, np.left_shift(1, again & 7).astype(np.uint8))
            every = fresh[0].ravel()
            np.bitwise_or.at(once, every >> 3, np.left_shift(1, every & 7).astype(np.uint8))
        yield from slices(once, twice)

    def slices(once: np.ndarray, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(once), SLICE):
            if once[k : k + SLICE].any():
                pair = [zlib.compress(x[k : k + SLICE].tobytes(), 1) for x in (once, twice)]
                yield pa.RecordBatch.from_arrays([pa.array([k // SLICE]), *(pa.array([p], type=pa.binary()) for p in pair)], ["slice", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = -1, np.empty(0, np.uint8), np.empty(0, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([zlib.compress(twice.tobytes(), 1)], type=pa.binary())], ["slice", "twice"])

        for batch in batches:
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (a, b))
                if k != at:
                    if at >= 0:
                        yield done()
                    at, once, twice = k, one.copy(), two.copy()
                else:
                    twice |= two | (once & one)
                    once |= one
        if at >= 0:
            yield done()

    filled = map_partitions(df, fill, "slice long, once binary, twice binary")
    merged = map_partitions(filled.repartition("slice").sortWithinPartitions("slice"), merge, "slice long, twice binary")
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in merged.collect():
        part = np.frombuffer(zlib.decompress(bytes(row["twice"])), dtype=np.uint8)
        out[row["slice"] * SLICE : row["slice"] * SLICE + len(part)] = part
    return out


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, bits: int = 1 << 26, carry: Sequence[str] = ()
) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text, rest``: every row with the lines it keeps; ``rest`` is a struct of the columns ``carry``.

    A line's key is the line without outer blanks and with A-Z in lower case. A key of at least ``least`` code
    points in two documents or more loses all its lines except in the smallest id that holds it (there all of
    them stay, repeated ones too). Only keys that the twice-seen filter reports are shuffled, once per
    document; they are confirmed by the key itself, so a full filter costs time and never a result. Texts
    without such keys end in the first pass and are never shuffled.

    A null or empty text is one empty line and becomes an empty text. Rows that repeat an id count as one
    document. A null id counts as one document after all others. An empty table gives an empty one.
    Columns outside ``carry`` are not read; carried ones sit inside ``rest``, so no name can clash.
    """
    rest = F.struct(*carry) if carry else F.lit(None).cast("int")
    rows = keyed(df, id_col, text_col, rest.alias("rest"))
    rest_type = rows.schema["rest"].dataType.simpleString()
    known = df.sparkSession.sparkContext.broadcast(twice_seen(rows.select("id", "text"), bits, least))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, suspects = [], []
            for text in texts(batch.column(1)):
                keys = sorted(distinct_keys(text, least))
                hit = seen_in(known.value, places(keys, bits)).all(axis=1) if keys else []
                suspects.append([k for k, h in zip(keys, hit, strict=True) if h])
                kept.append(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, type=pa.binary()).cast(pa.string()), pa.array(suspects, type=pa.list_(pa.binary())), batch.column(2)],
                ["id", "text", "keys", "rest"],
            )

    seen = stored(map_partitions(rows, look, f"id long, text string, keys array<binary>, rest {rest_type}"), "lines")
    asked = seen.where(F.size("keys") > 0).select("id", F.explode("keys").alias("key"))
    # one row per key; written, so that both sides of the join are shuffled for it and the adaptive skew join may split a frequent key
    shared = stored(asked.groupBy("key").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper < last").drop("last"), "shared")
    lost = asked.join(shared, "key").where("id <> keeper").groupBy("id").agg(F.collect_set("key").alias("lost"))
    cut = seen.where(F.size("keys") > 0).select("id", "text", "rest").join(lost, "id", "left").select("id", "text", "lost", "rest")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, keys in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                bad = set(keys or [])
                left = [x for x in lines if line_key(x, least) not in bad] if bad else lines
                total.append(len(lines))
                gone.append(len(lines) - len(left))
                kept.append(b"\n".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(kept, type=pa.binary()).cast(pa.string()), batch.column(3)],
                ["id", "n_lines", "n_dropped", "text", "rest"],
            )

    whole = seen.where(F.size("keys") == 0).select("id", "text", F.lit(None).cast("array<binary>").alias("lost"), "rest")
    out = map_partitions(whole.unionByName(cut), drop, f"id long, n_lines long, n_dropped long, text string, rest {rest_type}")
    return out.select(id_back("id").alias("doc_id"), "n_lines", "n_dropped", "text", "rest")


