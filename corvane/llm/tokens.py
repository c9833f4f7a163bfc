"""Byte-level BPE encoding and decoding with a local rank file."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import fresh, lists, map_batches

PART_CHARS = 1 << 16
# A blank after an ASCII letter, digit or full stop always starts a new match of the usual splitting
# patterns, which take blanks only at the start of a match and never look back.
SAFE = re.compile(r"(?<=[A-Za-z0-9.])(?=[ \n])")


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut at safe boundaries only; one part when it has none."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(
    df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep..., ids array<int>``: the token ids of every whole text, without special tokens.

    A null or empty text has no ids. Rows are independent: repeated rows and ids stay as they are, an empty
    table gives an empty one, and only ``keep`` and the text are read, so other columns cannot clash. The
    rank file is read once per Python worker, at ``rank_file`` on every machine.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code = encoding(rank_file, pattern)
        found = []
        for text in batch.column(len(keep)).to_pylist():
            ids: list[int] = []
            for part in parts(text or ""):
                ids += code.encode_ordinary(part)
            found.append(np.array(ids, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], lists(found, pa.int32())], [*keep, ids_col])

    source = df.select(*keep, F.col(text_col).cast("string").alias(fresh(df, "text_")))
    schema = df.select(*keep).schema.add(ids_col, T.ArrayType(T.IntegerType()))
    return map_batches(source, run, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the raw bytes its ids stand for; null ids give empty bytes. Bytes need not be valid UTF-8."""
    names = [*df.columns, bytes_col]
    at = df.columns.index(ids_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code = encoding(rank_file, pattern)
        raw = [code.decode_bytes(ids or []) for ids in batch.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, type=pa.binary())], names)

    return map_batches(df, run, T.StructType([*df.schema.fields, T.StructField(bytes_col, T.BinaryType())]))
