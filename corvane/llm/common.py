"""What the operators of this subpackage share: ids, bounded batches, written intermediates, id filters."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import shared_folder

BATCH_ROWS = 512  # rows in an Arrow batch, so that a batch of very long texts still fits a worker
NO_ID = 2**63 - 1  # stands for a null id inside an operator: it sorts after every other id
BLANKS = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def keyed(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``id, text, more...`` alone, so that no other column can clash; a null id becomes ``NO_ID``, a null text stays null."""
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"), *more
    )


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def id_back(column: str | Column) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.when(value != NO_ID, value)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``function`` over every Arrow batch of ``df``."""
    return map_partitions(df, lambda batches: (out for batch in batches for out in function(batch)), schema)


def map_partitions(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there and nothing is computed twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_filter(ids: DataFrame, column: str, bits: int = 1 << 26) -> np.ndarray:
    """A bitmap of hashed ids, at most ``bits / 8`` bytes whatever the input.

    An id that was put in is always found; another is found with a chance of at most ids / bits. It
    only spares a shuffle rows that an exact join drops anyway, so a full bitmap costs time, not results.
    """
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits)) + 1  # these functions count values from 1
    slices = (
        ids.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("slice"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(bits // 8 + 8192, dtype=np.uint8)
    for number, part in zip(slices.column("slice").to_pylist(), slices.column("bits"), strict=True):
        start = (number - 1) * 4096
        out[start : start + 4096] |= np.frombuffer(part.as_buffer(), dtype=np.uint8)
    return out


def filter_bits(ids: DataFrame) -> int:
    """Bits of a filter of a written table of ids: some 64 per row, 32 KB at least and 8 MB at most."""
    return 1 << min(26, max(18, (64 * ids.count()).bit_length()))


def in_filter(
    df: DataFrame, column: str, ids: DataFrame, ids_column: str, bits: int = 1 << 26, keep: bool = True
) -> DataFrame:
    """The rows of ``df`` whose id may be among ``ids`` (an exact join must follow), or those whose id is surely not."""
    return filtered(df, column, df.sparkSession.sparkContext.broadcast(id_filter(ids, ids_column, bits)), bits, keep)


def filtered(df: DataFrame, column: str, known: Broadcast, bits: int, keep: bool = True) -> DataFrame:
    """``in_filter`` by an ``id_filter`` of ``bits`` that is broadcast already."""

    def choose(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        place = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        hit = (known.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1
        yield batch.filter(pa.array(hit.astype(bool) == keep)).select(range(batch.num_columns - 1))

    marked = df.withColumn(fresh(df, "place"), F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits)))
    return map_batches(marked, choose, df.schema)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lists(values: list[np.ndarray], dtype: pa.DataType) -> pa.ListArray:
    """One list per array, built without Python objects for the elements."""
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=dtype))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
