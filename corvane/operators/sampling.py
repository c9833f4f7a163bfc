"""Deterministic samples: drawn by hash order, so they are the same on any cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: int) -> Column:
    """A uniform order key that depends on the row's key and the seed only."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))


def slice_corpus(docs: DataFrame, judged: DataFrame, budget: int, *, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """All judged documents plus hash-drawn others up to exactly ``budget``.

    The draw is counted by its first four digits; whole prefixes are taken until one would overshoot, and only
    that one, a 65,536th of the documents, is ordered.
    """
    kept = docs.join(judged.select(key).distinct(), key, "left_semi")
    others = docs.join(judged.select(key).distinct(), key, "left_anti")
    room = max(0, budget - kept.count())
    drawn = others.withColumn("_o", draw(F.col(key), seed)).withColumn("_p", F.substring("_o", 1, 4))
    taken, last = 0, ""
    for row in drawn.groupBy("_p").count().orderBy("_p").collect():  # at most 65,536 rows
        last = row["_p"]
        if taken + row["count"] >= room:
            break
        taken += row["count"]
    edge = drawn.where(F.col("_p") == last).orderBy("_o", key).limit(room - taken)
    filler = drawn.where(F.col("_p") < last).unionByName(edge).drop("_o", "_p")
    return kept.withColumn("judged", F.lit(True)).unionByName(filler.withColumn("judged", F.lit(False)))


def stratified(rows: DataFrame, by: Sequence[str], key: str, quota: int, total: int, *, seed: int = 42) -> DataFrame:
    """Up to ``quota`` rows per stratum by hash order, then cut to ``total``."""
    order = Window.partitionBy(*by).orderBy("_o", key)
    drawn = rows.withColumn("_o", draw(F.col(key), seed)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= quota)
    return drawn.orderBy("_n", "_o", key).limit(total).drop("_o", "_n")


def quantile_edges(values: DataFrame, value: str, bins: int) -> DataFrame:
    """One row: ``edges``, the truncated linear-interpolation quantiles from minimum to maximum."""
    shares = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    return values.agg(F.transform(F.percentile(value, shares), lambda x: x.cast("int")).alias("edges"))


def bins_of(rows: DataFrame, value: str, edges: DataFrame, short: int | None = None) -> DataFrame:
    """Each row once per bin holding it: half-open quantile bins (the last closed), a short bin, all.

    The edges are one short array, so a row finds its bins by itself; nothing is joined.
    """
    placed = rows.withColumn("_e", edges.scalar())
    v = F.col(value)
    quantiles = F.transform(
        F.sequence(F.lit(1), F.size("_e") - 1),
        lambda i: F.struct(
            F.concat(F.lit("Q"), i.cast("string")).alias("bin"), F.get(F.col("_e"), i - 1).alias("words_lo"), F.get(F.col("_e"), i).alias("words_hi"),
            (i == F.size("_e") - 1).alias("last"),
        ),
    )
    inside = F.filter(
        quantiles, lambda b: (v >= b["words_lo"]) & F.when(b["last"], v <= b["words_hi"]).otherwise(v < b["words_hi"])
    )
    named = F.transform(inside, lambda b: F.struct(b["bin"].alias("bin"), b["words_lo"].alias("words_lo"), b["words_hi"].alias("words_hi")))
    everything = F.array(F.struct(F.lit("all").alias("bin"), F.get(F.col("_e"), F.lit(0)).alias("words_lo"), F.element_at(F.col("_e"), F.lit(-1)).alias("words_hi")))
    parts = [named, everything]
    if short is not None:
        below = F.array(F.struct(F.lit(f"<= {short} words").alias("bin"), F.lit(0).alias("words_lo"), F.lit(short).alias("words_hi")))
        parts.append(F.when(v <= short, below).otherwise(F.slice(below, 1, 0)))
    return placed.withColumn("_b", F.explode(F.concat(*parts))).drop("_e").select("*", "_b.*").drop("_b")
