"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_partitions, stored


FEW = 250_000  # links of two ids each, some 4 MB


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``id, component``: every id of a link with the smallest id that it reaches; ids without links are left out.

    Alternating large and small stars: each id's larger neighbours move to its smallest one, then each id's
    smaller neighbours do. Links halve their distance to the root, so a path of n ids takes about log n
    rounds. A busy id is joined with its one minimum, never gathered; each round ends in a written table.

    At most ``FEW`` links, at the start or after a round, are united in one pass: a round is some ten plans and as many
    threads and small broadcasts in the driver, whatever it moves.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    edges, mark = settled(edges)
    while mark[0] > FEW:
        ends = F.array(F.struct(F.col("hi").alias("u"), F.col("lo").alias("v")), F.struct(F.col("lo").alias("u"), F.col("hi").alias("v")))
        both = edges.select(F.inline(ends))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        moved = small.union(least.select("hi", F.col("m").alias("lo")))
        edges, now = settled(moved.distinct())
        if now == mark:
            roots = edges.select("lo").distinct()
            return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(roots.select("lo", "lo"))
        mark = now
    return map_partitions(edges.coalesce(1), united, "id long, component long")


def settled(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The written table and a mark of its content: stars that no round changes any more keep it."""
    table = stored(edges, "stars")
    seen = table.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return table, (seen["n"], seen["x"])


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every id of at most ``FEW`` links with the smallest that it reaches: a larger root moves below a smaller one."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for hi, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = root(hi), root(lo)
            above[max(x, y)] = min(x, y)
    ids = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], ["id", "component"])
