"""Turning a computed array into rows without computing it twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import let


def fan_out(df: DataFrame, keep: Sequence[str | Column], array: Column, name: str, at: str | None = None) -> DataFrame:
    """``keep..., [at], name``: one row per element of ``array``, none for an empty one.

    A plain ``explode`` makes the optimizer infer "not empty" from the array's own expression and
    evaluate that in a filter at the scan, so a costly array is built twice, the first time with
    the scan's parallelism. The outer form has no such filter; the row it gives for an empty array
    is dropped by looking at its output.
    """
    if at is None:
        out = df.select(*keep, F.explode_outer(array).alias(name))
        return out.where(F.col(name).isNotNull())
    out = df.select(*keep, F.posexplode_outer(array).alias(at, name))
    return out.where(F.col(at).isNotNull())


def offsets(lengths: Column) -> Column:
    """The sum of all lengths before each place, in blocks of about the square root of their number.

    ``lengths`` may be any expression: it is bound first, as every block reads it again.
    """

    def total(some: Column) -> Column:
        return F.aggregate(some, F.lit(0), lambda a, x: a + x)

    def in_blocks(bound: Column, width: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.ceil(F.size(bound) / width).cast("int")), lambda b: total(F.slice(bound, b * width + 1, width)))
        return let(sums, lambda s: let(
            F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))),
            lambda begun: F.transform(bound, lambda _, i: F.get(begun, F.floor(i / width).cast("int"))
                + total(F.slice(bound, F.floor(i / width).cast("int") * width + 1, i % width))),
        ))

    def walk(bound: Column) -> Column:
        summed = let(F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(bound))).cast("int")), lambda width: in_blocks(bound, width))
        return F.when(F.size(bound) == 0, F.array().cast("array<int>")).otherwise(summed)

    return let(lengths, walk)
