"""Measurements around retrieval: energy, footprint, cost and extraction quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import collapse, let
from corvane.operators.metrics import multiset_overlap

# Noise floors and the container a store has to fit.
NOISE_FLOOR_MB = 5.0
NOISE_FLOOR_SHARE = 0.10
CONTAINER_MB = 8 * 1024
MIN_SIGNAL_TO_NOISE = 3.0


def trapezoid(samples: DataFrame, by: Sequence[str], ts: str, value: str, order: str, slice_unit: str = "hour") -> DataFrame:
    """``by..., joules, seconds``: the area under a gauge, by trapezoids.

    Neighbours are found inside time slices, and the joints between slices from each slice's ends,
    so a busy gauge is not one task. ``ts`` is a timestamp column.
    """
    by = list(by)
    rows = samples.select(*by, (F.unix_micros(ts) / 1e6).alias("_t"), F.col(value).cast("double").alias("_v"),
                          F.date_trunc(slice_unit, F.col(ts)).alias("_s"), F.col(order).alias("_o"))
    inside = Window.partitionBy(*by, "_s").orderBy("_t", "_o")
    areas = rows.withColumn("_pt", F.lag("_t").over(inside)).withColumn("_pv", F.lag("_v").over(inside))
    first, last = F.struct("_t", "_o", "_v"), F.struct("_t", "_o", "_v")
    slices = areas.groupBy(*by, "_s").agg(
        F.sum((F.col("_v") + F.col("_pv")) / 2 * (F.col("_t") - F.col("_pt"))).alias("_area"), F.min(first).alias("_f"), F.max(last).alias("_l")
    )
    across = Window.partitionBy(*by).orderBy("_s")
    joined = slices.withColumn("_p", F.lag("_l").over(across))
    joint = (F.col("_f._v") + F.col("_p._v")) / 2 * (F.col("_f._t") - F.col("_p._t"))
    return joined.groupBy(*by).agg(
        F.sum(F.coalesce("_area", F.lit(0.0)) + F.coalesce(joint, F.lit(0.0))).alias("joules"),
        (F.max("_l._t") - F.min("_f._t")).alias("seconds"),
    )


def energy(total_j: Column, seconds: Column, idle_w: Column, idle_spread_w: Column, units: Column, tariff: float) -> dict[str, Column]:
    """The part of a run's energy its work added, per unit, its price, and whether it can be told."""
    marginal = F.when(seconds <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), total_j - idle_w * seconds))
    per_unit = F.when(units > 0, marginal / units).otherwise(F.lit(0.0))
    watts = F.when(seconds > 0, marginal / seconds).otherwise(F.lit(0.0))
    ratio = F.when(idle_spread_w > 0, watts / idle_spread_w).otherwise(F.lit(float("inf")))
    return {
        "marginal_j": marginal, "marginal_j_per_unit": per_unit, "signal_to_noise": ratio,
        "resolved": ratio >= MIN_SIGNAL_TO_NOISE, "cost_per_million": per_unit * 1_000_000 / 3_600_000 * tariff,
    }


def counter_delta(before: Column, after: Column, max_range: int) -> Column:
    """The step of a counter that wraps to zero at ``max_range``."""
    return F.when(after >= before, after - before).otherwise(after - before + max_range)


def rows_per_gb(series: DataFrame, by: str, rows: str = "rows", size: str = "resident_mb") -> DataFrame:
    """``by, verdict, capacity``: how many rows fit, by a straight line, where one is honest.

    A footprint that falls on the way (a change of regime) or stays flat gets no figure.
    """
    order = Window.partitionBy(by).orderBy(rows)
    steps = series.withColumn("_prev", F.lag(size).over(order))
    ends = F.struct(rows, size)
    grouped = steps.groupBy(by).agg(
        F.count("*").alias("_n"), F.min(ends).alias("_a"), F.max(ends).alias("_z"), F.min(F.col(size) - F.col("_prev")).alias("_fall")
    ).where("_n >= 2")
    floor = F.greatest(F.lit(NOISE_FLOOR_MB), F.col(f"_a.{size}") * NOISE_FLOOR_SHARE)
    grew = F.col(f"_z.{size}") - F.col(f"_a.{size}")
    per_row_kb = grew / (F.col(f"_z.{rows}") - F.col(f"_a.{rows}")) * 1024
    room = F.col(f"_z.{rows}") + ((F.lit(CONTAINER_MB) - F.col(f"_z.{size}")) * 1024 / per_row_kb).cast("long")
    verdict = F.when(F.col("_fall") < -floor, "not extrapolated").when(grew < floor, "flat").otherwise("linear")
    return grouped.withColumn("_g", grew).select(
        by, verdict.alias("verdict"), F.when(verdict == "linear", room).alias("capacity")
    )


def edit_similarity(left: Column, right: Column, size: int = 3) -> Column:
    """Likeness of two normalised texts, 1 when both are empty and 0 when one is: the share of their ``size``-letter
    pieces that both have, repeated ones as often as both have them. A longest-matching-block ratio orders pieces too;
    this one does not, so moved passages count as kept."""

    def grams(text: Column) -> Column:
        flat = F.lower(collapse(F.coalesce(text, F.lit(""))))
        padded = F.concat(F.lit(" " * (size - 1)), flat, F.lit(" " * (size - 1)))
        places = F.sequence(F.lit(1), F.char_length(padded) - (size - 1))
        return F.when(flat == "", F.array().cast("array<string>")).otherwise(let(padded, lambda p: F.transform(places, lambda i: F.substr(p, i, F.lit(size)))))

    def ratio(a: Column, b: Column) -> Column:
        total = F.size(a) + F.size(b)
        return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * multiset_overlap(a, b) / total)

    return let(grams(left), lambda a: let(grams(right), lambda b: ratio(a, b)))
