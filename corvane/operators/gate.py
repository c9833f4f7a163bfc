"""Comparing a run with its baseline: paired per query where possible, and merging the two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The paired floor, the unpaired tolerance and the figures that never gate.
PAIRED_FLOOR = 0.005
UNPAIRED_DROP = 0.03
REPORTED_SUFFIXES = ("_ms", "_s", "_mb")


def gated(metric: Column) -> Column:
    out = F.lit(True)
    for suffix in REPORTED_SUFFIXES:
        out = out & ~F.endswith(metric, F.lit(suffix))
    return out


def paired_verdicts(base: DataFrame, current: DataFrame, floor: float = PAIRED_FLOOR) -> DataFrame:
    """``combo, metric, mean_delta, worse, better, n, regressed`` over the queries both runs scored.

    A regression needs a mean drop past the floor and more queries worse than better.
    """
    b = base.select("combo", "metric", "qid", F.col("value").alias("_b"))
    c = current.select("combo", "metric", "qid", F.col("value").alias("_c"))
    delta = F.round(F.col("_c") - F.col("_b"), 9)
    return b.join(c, ["combo", "metric", "qid"]).withColumn("_d", delta).groupBy("combo", "metric").agg(
        F.round(F.avg("_d"), 6).alias("mean_delta"),
        F.count_if(F.col("_d") < 0).alias("worse"),
        F.count_if(F.col("_d") > 0).alias("better"),
        F.count("*").alias("n"),
    ).withColumn("regressed", (F.col("mean_delta") < -floor) & (F.col("worse") > F.col("better")))


def compare_runs(
    base: DataFrame, current: DataFrame, base_metrics: DataFrame, current_metrics: DataFrame, verdicts: DataFrame,
    drop: float = UNPAIRED_DROP,
) -> DataFrame:
    """``combo, bucket, dropped``: regressions, not_run, new or ok.

    ``base``/``current``: ``combo, status``; metrics: ``combo, metric, value``. A cell that was ok
    and no longer is regresses; a metric without shared queries falls back to its means.
    """
    met = base_metrics.select("combo", "metric", F.col("value").alias("_b")).join(
        current_metrics.select("combo", "metric", F.col("value").alias("_c")), ["combo", "metric"]
    ).where(gated(F.col("metric"))).join(verdicts.select("combo", "metric", "regressed"), ["combo", "metric"], "left")
    fell = F.coalesce(F.col("regressed"), F.col("_c") < F.col("_b") - drop)
    drops = met.where(fell).groupBy("combo").agg(F.count("*").alias("dropped"))
    joined = base.select("combo", F.col("status").alias("_was")).join(
        current.select("combo", F.col("status").alias("_is")), "combo", "full_outer"
    ).join(drops, "combo", "left")
    bucket = (
        F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "not_run")
        .when((F.col("_was") == "ok") & (F.col("_is") != "ok"), "regressions")
        .when(F.col("dropped") > 0, "regressions").otherwise("ok")
    )
    return joined.select("combo", bucket.alias("bucket"), F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped"))


def merge_newest(base: DataFrame, current: DataFrame, key: str, stamp: str, base_stamp: Column, current_stamp: Column) -> DataFrame:
    """The union of both runs, the current one winning per key; kept rows keep or get their stamp."""
    rest = [c for c in base.columns if c not in (key, stamp)]
    b = base.select(key, F.struct(*rest, F.coalesce(F.col(stamp), base_stamp).alias(stamp)).alias("_b"))
    c = current.select(key, F.struct(*rest, current_stamp.alias(stamp)).alias("_c"))
    origin = F.when(F.col("_b").isNull(), "new").when(F.col("_c").isNull(), "kept").otherwise("updated")
    return b.join(c, key, "full_outer").select(key, F.coalesce("_c", "_b").alias("_r"), origin.alias("origin")).select(key, "_r.*", "origin")
