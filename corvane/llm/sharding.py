"""Rendezvous hashing of record keys over weighted shards. Column expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import stored


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to ``len(weights) - 1``, with the best score for ``key``.

    A shard's score is ``-ln(u) / weight`` with ``u`` uniform in (0, 1) from a 64-bit hash of key and shard;
    the least wins, so a shard gets its weight's share. Adding a shard changes no other score: rows move
    into the new shard only. A null key is one key like any other.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    scores = []
    for shard, weight in enumerate(weights):
        high = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
        uniform = (high + F.lit(0.5)) / F.lit(float(1 << 53))
        scores.append(F.struct((-F.ln(uniform) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*scores))["shard"] if len(scores) > 1 else F.lit(0)


def place(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float], keep: Sequence[Column]) -> DataFrame:
    """``keep..., shard, slot, grown_shard`` per row.

    ``slot`` counts from 0 without gaps inside a shard. It is a row number per shard and input partition plus
    the rows that earlier partitions put into the shard, so no shard is ever sorted in one task and a key
    that holds a third of all rows spreads with its input partitions. Repeated rows get slots of their own;
    an empty table gives an empty one; only ``key`` and ``keep`` are read. A kept column named like one
    of the three results gives way to it.
    """
    names = [c for c in df.select(*keep).columns if c not in ("shard", "slot", "grown_shard")]
    kept = df.select(F.struct(*keep).alias("kept"), F.col(key).alias("key"))  # inside a struct no carried name can clash
    rows = kept.select(
        "kept", rendezvous(F.col("key"), weights).alias("shard"), rendezvous(F.col("key"), grown).alias("grown_shard"),
        F.spark_partition_id().alias("part"), F.xxhash64(F.col("key")).alias("turn"),
    )
    rows = stored(rows, "shards")  # partition numbers are fixed from here on
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(W.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("shard", "part").orderBy("turn", *[F.col("kept")[c] for c in names])).cast("long") - 1
    placed = rows.withColumn("own", own).join(before, ["shard", "part"])
    return placed.select(*[F.col("kept")[c].alias(c) for c in names], "shard", (F.col("own") + F.col("before")).alias("slot"), "grown_shard")
