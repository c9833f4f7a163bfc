"""Which documents hold a passage, whole or in part: many patterns against every text in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.session import cut_lineage

RUN = 8  # words of a passage in a row that count as a part of it
PASSAGE_BYTES = 32 << 20  # of passages that are sent to the documents at a time
SLICE = 512  # documents whose words a task holds at a time
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Passages:
    """The runs of passages as sorted fingerprints; built once per task."""

    def __init__(self, rows: list[tuple[object, str, list[str]]]) -> None:
        self.qids = [r[0] for r in rows]
        self.texts = [r[1] for r in rows]
        self.numbers: dict[str, int] = {}
        self.runs: dict[int, dict[tuple[int, ...], list[int]]] = {}  # by length: the passages that have a run
        for at, (_, _, words) in enumerate(rows):
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            size = min(len(ids), RUN)
            for i in range(len(ids) - size + 1) if size else ():
                owners = self.runs.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), [])
                if not owners or owners[-1] != at:
                    owners.append(at)
        self.marks = {size: np.sort(prints(np.array(list(found), dtype=np.uint64))) for size, found in self.runs.items()}

    def within(self, texts: list[str]) -> list[tuple[int, int]]:
        """``(text, passage)`` for every passage of which a text has a run. A fingerprint finds the place, the words themselves decide.

        The texts are one sequence of word numbers, parted by 0; so is a word of no passage, and no run holds one.
        """
        number = self.numbers.get
        ids, begins = [], []
        for text in texts:
            begins.append(len(ids))
            ids.extend([number(w, 0) for w in text.split()])
            ids.append(0)
        sequence = np.array(ids, dtype=np.uint64)
        unknown = np.r_[0, np.cumsum(sequence == 0)]
        found: set[tuple[int, int]] = set()
        for size, marks in self.marks.items():
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            seen = prints(np.lib.stride_tricks.sliding_window_view(sequence, size)[at])
            at = at[marks[np.minimum(np.searchsorted(marks, seen), len(marks) - 1)] == seen]
            of = np.searchsorted(begins, at, side="right") - 1
            for i, text in zip(at.tolist(), of.tolist(), strict=True):
                found.update((text, p) for p in self.runs[size].get(tuple(ids[i : i + size]), ()))
        return sorted(found)


def prints(windows: np.ndarray) -> np.ndarray:
    """A polynomial fingerprint per row of word numbers."""
    found = np.zeros(len(windows), dtype=np.uint64)
    for column in windows.T:
        found = (found + column) * MULTIPLIER
        found ^= found >> np.uint64(29)
    return found


def hits(docs: DataFrame, passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``qid, key, rel``: 2 where a document has the passage's text, 1 where it has ``RUN`` words in a row of it.

    ``passages`` has ``qid, text``; one under ``RUN`` words is one run. Documents are read once per ``PASSAGE_BYTES`` of
    passages and only hits leave the scan, so neither runs nor texts are shuffled.
    """
    asked = cut_lineage(passages.select("qid", "text", tokens(F.col("text")).alias("words")).where(F.size("words") > 0))
    total = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // PASSAGE_BYTES) or 1
    split = asked.withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(parts)))
    source = docs.select(F.col(key), "text")
    out: DataFrame | None = None
    for part in range(parts):
        rows = [tuple(r) for r in split.where(F.col("part") == part).select("qid", "text", "words").collect()]
        one = _scan(source, rows, passages.schema["qid"].dataType.simpleString(), key)
        one = cut_lineage(one) if parts > 1 else one
        out = one if out is None else out.unionByName(one)
    return out


def _scan(source: DataFrame, rows: list[tuple], qid_type: str, key: str) -> DataFrame:
    shipped = source.sparkSession.sparkContext.broadcast(rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Passages(shipped.value)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                texts = [text or "" for text in part.column("text").to_pylist()]
                near = known.within(texts)
                if not near:
                    continue
                found = part.column(0).take(pa.array([i for i, _ in near], pa.int64()))
                rel = pa.array([2 if known.texts[p] in texts[i] else 1 for i, p in near], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([known.qids[p] for _, p in near]), found, rel], ["qid", key, "rel"])

    return source.mapInArrow(scan, f"qid {qid_type}, {key} {source.schema[key].dataType.simpleString()}, rel int")
