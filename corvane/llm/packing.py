"""Bulk-synchronous best-fit packing of documents into sequences of at most ``width`` tokens."""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import id_back, keyed, map_batches, stored
from corvane.llm.tokens import encoding, parts

# Letters, digits, marks and blanks that every splitter of a byte-level BPE classes alike.
PLAIN = re.compile("[\t\n\r -~\u00a1-\u00a9\u00ab-\u00b1\u00c0-\u00ff\u2010-\u2027\u20ac]*")


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def special_tokens(path: str) -> list[str]:
    with open(path, encoding="utf-8") as file:
        return [t["content"] for t in json.load(file)["added_tokens"]]


def token_ids(texts: list[str], vocabulary: str, ranks: tuple[str, str] | None) -> list[bytes]:
    """Little-endian 32-bit ids of whole texts.

    ``vocabulary`` defines them. ``ranks``, a rank file of the same vocabulary and its splitting pattern, gives
    the same ids several times faster where no special token's string and no character occurs that
    two splitters may class differently; every other text goes through ``vocabulary`` itself, which a worker
    loads with the first such text.
    """
    special = special_tokens(vocabulary)
    quick = [bool(ranks) and PLAIN.fullmatch(t) is not None and not any(s in t for s in special) for t in texts]
    others = [t for t, ok in zip(texts, quick, strict=True) if not ok]
    slow = iter(tokenizer(vocabulary).encode_batch_fast(others, add_special_tokens=False) if others else [])
    fast = encoding(*ranks) if ranks else None
    return [
        array("I", [i for part in parts(t) for i in fast.encode_ordinary(part)] if ok else next(slow).ids).tobytes()
        for t, ok in zip(texts, quick, strict=True)
    ]


def pieces(
    df: DataFrame, vocabulary: str, ranks: tuple[str, str] | None, end_id: int, width: int, id_col: str, text_col: str
) -> DataFrame:
    """``id, piece, start, length, ids_crc32``: every document's ids and ``end_id``, cut only when longer than ``width``.

    The first piece takes what is left over, the others are full.
    """
    end = array("I", [end_id]).tobytes()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int, int]] = []
        found = token_ids([t or "" for t in batch.column(1).to_pylist()], vocabulary, ranks)
        for doc, ids in zip(batch.column(0).to_pylist(), found, strict=True):
            ids += end
            n = len(ids) // 4
            first = n % width or width
            for piece, start in enumerate([0, *range(first, n, width)]):
                length = first if piece == 0 else width
                out.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
        columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], ["id", "piece", "start", "length", "ids_crc32"]
        )

    return map_batches(keyed(df, id_col, text_col), run, "id long, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], width: int) -> list[tuple[int, int, int, int, int, int]]:
    """The rounds of best fit over counts per length: ``length, rank_from, n, sequence_from, offset, per_sequence``.

    Each entry places the documents of one length with ranks from ``rank_from`` on, ``per_sequence`` one
    after the other into each of consecutive sequences. A round takes the longest length left, sweeps the
    gaps upward from the smallest that holds it (its successor), gives documents to sequences by rank, and
    puts the smaller gaps back; what finds no gap opens sequences. Documents of one length are
    interchangeable, so a round needs counts only: at most ``width`` lengths and ``width`` gaps.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences (first, how many)
    out: list[tuple[int, int, int, int, int, int]] = []
    next_sequence = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def fill(first: int, many: int, gap: int, per: int) -> None:
            nonlocal left, rank
            out.append((length, rank, many * per, first, width - gap, per))
            left, rank = left - many * per, rank + many * per
            if gap - per * length:
                gaps.setdefault(gap - per * length, []).append((first, many))

        for gap in sorted(g for g in gaps if g >= length):
            ranges = gaps[gap]
            while ranges and left:
                first, many = ranges.pop()
                most = gap // length
                if full := min(many, left // most):
                    fill(first, full, gap, most)
                    first, many = first + full, many - full
                if many and 0 < left < most:
                    fill(first, 1, gap, left)
                    first, many = first + 1, many - 1
                if many:
                    ranges.append((first, many))
            if not ranges:
                del gaps[gap]
            if not left:
                break
        most = width // length
        if full := left // most:
            fill(next_sequence, full, width, most)
            next_sequence += full
        if left:
            fill(next_sequence, 1, width, left)
            next_sequence += 1
    return out


def pack(
    df: DataFrame, vocabulary: str, ranks: tuple[str, str] | None = None, width: int = 1024, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    Spark tokenizes, ranks the pieces of each length (row number per length and input partition plus what earlier
    partitions hold, so a length that a third of all documents share is never sorted in one task) and places
    them with a range join on the rounds of ``sweep``, whose input is one count per length.

    A null or empty text is one piece, the end id alone. Repeated rows are packed as often as they occur; a
    null id stays null; an empty table gives an empty one; other columns are not read.
    """
    cut = pieces(df, vocabulary, ranks, end_id, width, id_col, text_col).withColumn("part", F.spark_partition_id())
    rows = stored(cut, "pieces")
    per_part = rows.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sweep(counts, width)
    spark = df.sparkSession
    rounds = spark.createDataFrame(plan or [(0, 0, 0, 0, 0, 1)], "len long, rank_from long, many long, first long, at long, per long")
    before = per_part.select(
        "length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before")
    )
    own = F.row_number().over(W.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("own", own).join(before, ["length", "part"]).withColumn("rank", F.col("own") + F.col("before"))
    # a length splits at most two ranges of sequences, so the rounds are bounded by the width, not by the data
    hit = (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_from") + F.col("many"))
    nth = F.col("rank") - F.col("rank_from")
    return ranked.join(F.broadcast(rounds), hit).select(
        id_back("id").alias("doc_id"), "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(nth / F.col("per"))).alias("sequence_id"),
        (F.col("at") + (nth % F.col("per")) * F.col("length")).alias("offset"),
    )

