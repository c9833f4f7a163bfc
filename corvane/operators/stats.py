"""Means with intervals, paired comparisons, rank agreement and query power."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.stats import poisson_matrix
from corvane.session import cut_lineage

# The bootstrap's resamples and level, and the smallest difference that counts.
RESAMPLES = 10_000
ALPHA = 0.05
MATERIAL_FLOOR = 0.005
NEGLIGIBLE_DELTA = 1e-4
NEAR_DUPLICATE_RHO = 0.95
SLICE = 20_000  # units that one task sums
GROUPS = 256  # groups that one task sums
CHUNK = 512  # units whose weights are held at once


def bootstrap(
    values: DataFrame, by: Sequence[str], *, unit: str = "qid", value: str = "value", resamples: int = RESAMPLES,
    alpha: float = ALPHA,
) -> DataFrame:
    """``by..., ci_lo, ci_hi`` by Poisson resampling: additive, so no group is ever gathered.

    Every value gets a weight per resample that depends on its unit alone, so the same unit weighs the
    same in every group, which keeps groups comparable. Rows are dealt by slices of units and of groups, so that the
    weights of a unit are drawn once for all groups of a task. A task adds up two vectors of weighted sums per group;
    vectors of tasks add up. No row is multiplied by the resamples.
    """
    by = list(by)
    rows = values.select(*by, F.col(unit).cast("string").alias("_u"), F.col(value).cast("double").alias("_x"))
    seen = rows.agg(F.approx_count_distinct("_u").alias("units"), F.approx_count_distinct(F.struct(*by)).alias("groups")).first()
    slices, parts = (max(1, -(-n // most)) for n, most in ((seen["units"], SLICE), (seen["groups"], GROUPS)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return weighted_sums(batches, by, resamples)

    def ends(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weighted = np.zeros(resamples), np.zeros(resamples)
        for batch in batches:
            for into, c in ((total, "_w"), (weighted, "_wx")):
                into += batch.column(c).flatten().to_numpy().reshape(-1, resamples).sum(axis=0)
        means = np.round(weighted[total > 0] / total[total > 0], 12)
        lo, hi = np.percentile(means, [alpha / 2 * 100, (1 - alpha / 2) * 100]) if len(means) else (None, None)
        named = [pa.array([k.as_py()], type=k.type) for k in key]
        yield pa.RecordBatch.from_arrays([*named, pa.array([lo], pa.float64()), pa.array([hi], pa.float64())], [*by, "ci_lo", "ci_hi"])

    kinds = values.select(*by).schema
    vectors = T.StructType([*kinds.fields, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("_w", "_wx")]])
    limits = T.StructType([*kinds.fields, *[T.StructField(c, T.DoubleType()) for c in ("ci_lo", "ci_hi")]])
    task = F.pmod(F.xxhash64("_u"), F.lit(slices)) * parts + F.pmod(F.xxhash64(*by), F.lit(parts))
    dealt = rows.repartitionById(slices * parts, task.cast("int")).sortWithinPartitions("_u")
    return dealt.mapInArrow(sums, vectors).groupBy(*by).applyInArrow(ends, limits)


def weighted_sums(batches: Iterator[pa.RecordBatch], by: list[str], resamples: int) -> Iterator[pa.RecordBatch]:
    """``by..., _w, _wx``: the sums of weights and of weighted values per group of a task; rows come sorted by unit ``_u``.

    With more than twice ``GROUPS`` groups, sums are given in parts.
    """
    sums: dict[tuple, np.ndarray] = {}
    kinds: list[pa.DataType] = []

    def given() -> Iterator[pa.RecordBatch]:
        for some in itertools.batched(list(sums), 16):
            names = [pa.array(column, kind) for column, kind in zip(zip(*some, strict=True), kinds, strict=True)]
            ends = pa.array(np.arange(len(some) + 1, dtype=np.int32) * resamples)
            sides = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([sums[g][k] for g in some]))) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*names, *sides], [*by, "_w", "_wx"])
        sums.clear()

    for batch in batches:
        kinds = [batch.column(c).type for c in by]
        units = pc.fill_null(batch.column("_u"), "None").dictionary_encode()
        at, x = units.indices.to_numpy(), batch.column("_x").to_numpy(zero_copy_only=False)
        of: dict[tuple, int] = {}
        group = np.array([of.setdefault(g, len(of)) for g in zip(*(batch.column(c).to_pylist() for c in by), strict=True)], dtype=np.int64)
        known = list(of)
        for first in range(0, len(units.dictionary), CHUNK):
            weights = poisson_matrix(units.dictionary[first : first + CHUNK].to_pylist(), resamples).astype(np.float64)
            mine = slice(*np.searchsorted(at, [first, first + CHUNK]))
            met, row = np.unique(group[mine], return_inverse=True)
            for start in range(0, len(met), GROUPS):
                here = (row >= start) & (row < start + GROUPS)
                table = np.zeros((2, min(GROUPS, len(met) - start), len(weights)))
                for side, value in enumerate((1.0, x[mine][here])):
                    np.add.at(table[side], (row[here] - start, at[mine][here] - first), value)
                for g, total, weighted in zip(met[start:].tolist(), *(side @ weights for side in table)):
                    held = sums.setdefault(known[g], np.zeros((2, resamples)))
                    held[0] += total
                    held[1] += weighted
                if len(sums) > 2 * GROUPS:
                    yield from given()
    yield from given()


def mean_interval(values: DataFrame, by: Sequence[str], *, unit: str = "qid", value: str = "value", **options) -> DataFrame:
    """``by..., mean, sd, n, ci_lo, ci_hi, half_width``; one value gives an interval of no width."""
    interval = bootstrap(values, by, unit=unit, value=value, **options)
    stats = values.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.count("*").alias("n")
    )
    return stats.join(interval, list(by)).withColumn("half_width", (F.col("ci_hi") - F.col("ci_lo")) / 2)


def paired_deltas(pairs: DataFrame, scores: DataFrame, *, cell: str = "cell", value: str = "value") -> DataFrame:
    """``pair columns..., qid, delta`` (to minus from) over the queries both cells scored."""
    to = scores.select(F.col(cell).alias("to_cell"), "qid", F.col(value).alias("_to"))
    frm = scores.select(F.col(cell).alias("from_cell"), "qid", F.col(value).alias("_from"))
    joined = pairs.join(to, "to_cell").join(frm, ["from_cell", "qid"])
    return joined.withColumn("delta", F.round(F.col("_to") - F.col("_from"), 9)).drop("_to", "_from")


def paired_summary(deltas: DataFrame, by: Sequence[str], *, drop_same: bool = False, places: int = 6, **options) -> DataFrame:
    """``by..., mean_delta, ci_lo, ci_hi, wins, ties, losses, n_shared, resolved, material``.

    ``drop_same`` leaves out pairs that score alike on every shared query: one ranking under two
    names is not a comparison. Material is judged on the rounded figure that is published.
    """
    by = list(by)
    counts = deltas.groupBy(*by).agg(
        F.round(F.avg("delta"), places).alias("mean_delta"),
        F.count_if(F.col("delta") > 0).alias("wins"),
        F.count_if(F.col("delta") == 0).alias("ties"),
        F.count_if(F.col("delta") < 0).alias("losses"),
        F.count("*").alias("n_shared"),
    )
    if drop_same:
        counts = counts.where(F.col("ties") < F.col("n_shared"))
    interval = bootstrap(deltas, by, value="delta", **options)
    return (
        counts.join(interval, by)
        .withColumn("ci_lo", F.round("ci_lo", places))
        .withColumn("ci_hi", F.round("ci_hi", places))
        .withColumn("resolved", resolved(F.col("ci_lo"), F.col("ci_hi")))
        .withColumn("material", material(F.col("resolved"), F.col("mean_delta")))
    )


def resolved(ci_lo: Column, ci_hi: Column) -> Column:
    return (ci_lo > 0) | (ci_hi < 0)


def material(is_resolved: Column, mean_delta: Column, floor: float = MATERIAL_FLOOR) -> Column:
    return is_resolved & (F.abs(mean_delta) >= floor)


def prefix_sums(rows: DataFrame, by: Sequence[str], value: str, weight: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over the rows of smaller ``value`` inside ``by``; values are distinct there.

    Rows are range-partitioned by ``by`` and ``value``. A row's sum is that of the earlier ranges of its group, of
    which there are as many as partitions at most, and what comes before it in its own range; so no task
    sees a whole group, however large.
    """
    by = list(by)
    ranged = cut_lineage(rows.repartitionByRange(*by, value).withColumn("_range", F.spark_partition_id()))
    ranges = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ranged.groupBy(*by, "_range").agg(F.sum(weight).alias("_sum"))
    earlier = earlier.select(*by, "_range", F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("_own", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return own.join(earlier, [*by, "_range"]).withColumn(out, F.col("_earlier") + F.col("_own")).drop("_range", "_earlier", "_own")


def average_ranks(rows: DataFrame, by: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the 1-based rank of ``value`` inside ``by``; equal values share their mean rank.

    Values are counted before they are ranked; the ranks are prefix sums over ranges of values.
    """
    by = list(by)
    counted = prefix_sums(rows.groupBy(*by, value).agg(F.count("*").alias("_n")), by, value, "_n", "_before")
    ranked = counted.select(*by, value, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return rows.join(ranked, [*by, value])


def spearman(cells: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``by..., left, right, rho, n`` for every pair of metrics over a group's cells.

    0 where either metric is constant or fewer than two cells exist. The metrics sit in the row,
    so each pair's correlation is one aggregate: no row meets another row.
    """
    by = list(by)
    # all metrics are ranked in one pass: a row per cell and metric, and back to a row per cell
    numbered = cut_lineage(cells.select(*by, *metrics).withColumn("_cell", F.monotonically_increasing_id()))
    long = numbered.select(*by, "_cell", F.inline(F.array(*[F.struct(F.lit(m).alias("_m"), F.col(m).alias("_v")) for m in metrics])))
    ranks = average_ranks(long, [*by, "_m"], "_v", "_r")
    ranked = ranks.groupBy(*by, "_cell").agg(*[F.max(F.when(F.col("_m") == m, F.col("_r"))).alias(f"_r_{m}") for m in metrics])
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]

    def rho(a: str, b: str) -> Column:
        x, y = f"_r_{a}", f"_r_{b}"
        flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
        linear = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
        return F.when(flat, F.lit(0.0)).otherwise(F.coalesce(linear, F.lit(0.0)))

    table = ranked.groupBy(*by).agg(F.count("*").alias("n"), *[rho(a, b).alias(f"_{a}_{b}") for a, b in pairs])
    return table.select(
        *by, "n", F.inline(F.array(*[
            F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_{a}_{b}").alias("rho")) for a, b in pairs
        ]))
    )


def pair_disagreement(cells: DataFrame, by: Sequence[str], left: str, right: str, key: str) -> DataFrame:
    """``by..., pairs, disagreements``: how often two metrics pick different winners.

    Pairs where either metric ties do not count. A pair disagrees when it is an inversion: sorted by one metric, its
    members stand the other way round by the other. Points are cut into ranges of either metric. Inversions between
    points that differ in both ranges follow from the points per pair of ranges; those inside a range of the second
    metric, and those inside one of the first but not of the second, are counted by merging sorted runs in the
    range's task. No point meets another as a row.
    """
    by = list(by)
    points = cells.where(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(*by, left, right).agg(F.count("*").alias("n"))

    def pairs_of(n: Column) -> Column:
        return n * (n - 1) / 2

    def tied(*values: str) -> Column:
        return points.groupBy(*by, *values).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.sum(pairs_of(F.col("n"))).alias("tied"))

    sides = [tied(left), tied(right).withColumnRenamed("tied", "tied_right"), tied(left, right).withColumnRenamed("tied", "tied_both")]
    whole = points.groupBy(*by).agg(pairs_of(F.sum("n")).alias("all"))
    for side in sides:
        whole = whole.join(side, by)
    pairs = (F.col("all") - F.col("tied") - F.col("tied_right") + F.col("tied_both")).cast("long")

    by_left = cut_lineage(points.repartitionByRange(*by, left).withColumn("_x", F.spark_partition_id()))
    both = cut_lineage(by_left.repartitionByRange(*by, right).withColumn("_y", F.spark_partition_id()))
    names, shape = [*by, left, right, "n", "_x", "_y"], both.select(*by).schema.add("inversions", "long")

    def counted(apart: str | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            found = inversions(pdf[left].to_numpy(), pdf[right].to_numpy(), pdf["n"].to_numpy())
            if apart:  # those inside one range of the other metric are counted there
                found -= sum(inversions(p[left].to_numpy(), p[right].to_numpy(), p["n"].to_numpy()) for _, p in pdf.groupby(apart))
            return pd.DataFrame([[*pdf.iloc[0][by], found]], columns=[*by, "inversions"])

        return one

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.unique(pdf[c], return_inverse=True)[1] for c in ("_x", "_y"))
        grid = np.zeros((x.max() + 1, y.max() + 1), dtype=np.int64)
        np.add.at(grid, (x, y), pdf["n"].to_numpy())
        # points of later ranges of the first metric and earlier ones of the second
        below = np.zeros_like(grid)
        below[:-1, 1:] = grid[::-1].cumsum(axis=0)[::-1].cumsum(axis=1)[1:, :-1]
        return pd.DataFrame([[*pdf.iloc[0][by], int((grid * below).sum())]], columns=[*by, "inversions"])

    in_y = both.select(*names).groupBy(*by, "_y").applyInPandas(counted(None), shape)
    in_x = both.select(*names).groupBy(*by, "_x").applyInPandas(counted("_y"), shape)
    # a row per pair of ranges, so at most the square of the number of partitions
    apart = both.groupBy(*by, "_x", "_y").agg(F.sum("n").alias("n")).groupBy(*by).applyInPandas(between, shape)
    total = in_y.union(in_x).union(apart).groupBy(*by).agg(F.sum("inversions").alias("disagreements"))
    return whole.select(*by, pairs.alias("pairs")).where("pairs > 0").join(total, by)


def inversions(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """The weighted pairs with ``x`` the one way round and ``y`` the other, by merging sorted runs of doubling length."""
    order = np.lexsort((y, x))  # equal x in order of y: no inversion
    rank = np.unique(y, return_inverse=True)[1][order].astype(np.int64)
    weight = n[order].astype(np.int64)
    size, width, found = len(rank), 1, 0
    place = np.arange(size)
    span = int(rank.max()) + 1 if size else 1
    while width < size:
        block, second = place // (2 * width), (place // width) % 2 == 1
        key = block * span + rank
        first = np.flatnonzero(~second)[np.argsort(key[~second], kind="stable")]
        sums = np.concatenate([[0], np.cumsum(weight[first])])
        upto = np.searchsorted(key[first], key[second], side="right")  # first runs up to an equal rank
        ends = np.searchsorted(key[first], (block[second] + 1) * span)
        found += int(((sums[ends] - sums[upto]) * weight[second]).sum())
        width *= 2
    return found


def effective_views(rhos: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``by..., views``: the participation ratio of each group's correlation matrix.

    For a symmetric matrix with unit diagonal the eigenvalues sum to its size; their squares need
    the eigenvalues only when some are negative (a pairwise matrix may be indefinite), so the
    small matrix of each group is decomposed in one Arrow call per group.
    """
    by, names = list(by), list(metrics)
    schema = rhos.select(*by).schema.add("views", "double")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        matrix = np.eye(len(names))
        for a, b, r in zip(pdf["left"], pdf["right"], pdf["rho"], strict=True):
            matrix[names.index(a), names.index(b)] = matrix[names.index(b), names.index(a)] = r
        roots = np.clip(np.linalg.eigvalsh(matrix), 0.0, None)
        squares = float((roots**2).sum())
        views = float(roots.sum() ** 2 / squares) if squares > 0 else 0.0
        return pd.DataFrame([[*pdf.iloc[0][by], views]], columns=[*by, "views"])

    return rhos.groupBy(*by).applyInPandas(one, schema)


def queries_to_resolve(half_width: Column, mean_delta: Column, queries: Column) -> Column:
    """Queries the interval needs to clear the effect; infinite for a negligible one."""
    endless = (F.abs(mean_delta) < NEGLIGIBLE_DELTA) | (half_width <= 0) | (queries <= 0)
    return F.when(endless, F.lit(float("inf"))).otherwise(
        queries * F.pow(half_width / F.when(mean_delta == 0, F.lit(1.0)).otherwise(mean_delta), 2)
    )


def query_power(effects: DataFrame, by: Sequence[str], ladder: Sequence[int]) -> DataFrame:
    """Per corpus: how many comparisons are ties, and what it would take to settle them."""
    half = (F.col("ci_hi") - F.col("ci_lo")) / 2
    needed = queries_to_resolve(half, F.col("mean_delta"), F.col("n_shared"))
    rows = effects.withColumn("_half", half).withColumn("_need", F.when(~F.col("resolved"), needed))
    finite = F.when(F.col("_need") < float("inf"), F.col("_need"))
    return rows.groupBy(*by).agg(
        F.max("n_shared").alias("queries"),
        F.count("*").alias("comparisons"),
        F.count_if(~F.col("resolved")).alias("unresolved"),
        F.round(F.count_if(~F.col("resolved")) / F.count("*"), 4).alias("unresolved_share"),
        F.round(F.percentile(F.abs("mean_delta"), 0.5), 4).alias("median_effect"),
        F.round(F.percentile("_half", 0.5), 4).alias("median_half_width"),
        F.round(F.percentile(finite, 0.5), 0).alias("median_required_queries"),
        F.count_if(F.col("_need") == float("inf")).alias("never_resolvable"),
        *[F.count_if(F.col("_need") <= n).alias(f"resolved_at_{n}") for n in ladder],
    )


def position(convention: str, q: float, n: Column) -> Column:
    """The 0-based place of a percentile among ``n`` sorted values: ``floor``: ``int(q n)``, ``round``:
    ``round(q (n - 1))``, ``middle``: ``n // 2``."""
    if convention == "floor":
        return F.least(F.floor(F.lit(q) * n), n - 1)
    return F.bround(F.lit(q) * (n - 1), 0).cast("long") if convention == "round" else F.floor(n / 2)


def order_statistics(rows: DataFrame, by: Sequence[str], value: str, picks: dict[str, tuple[str, float]]) -> DataFrame:
    """``by..., <picks>``: each pick is a convention and a quantile; all are read from one pass.

    Values are counted first and located by prefix sums over ranges of values, so no task sees a whole group.
    """
    by = list(by)
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = prefix_sums(counted, by, value, "_n", "_before")
    totals = placed.groupBy(*by).agg(F.sum("_n").alias("_total"))
    at = {name: position(how, q, F.col("_total")) for name, (how, q) in picks.items()}
    holds = {name: (F.col("_before") <= p) & (p < F.col("_before") + F.col("_n")) for name, p in at.items()}
    met = placed.join(totals, by)
    return met.groupBy(*by).agg(*[F.min(F.when(h, F.col(value))).alias(name) for name, h in holds.items()])


def picked_percentile(rows: DataFrame, by: Sequence[str], value: str, quantiles: Sequence[float], convention: str) -> DataFrame:
    """:func:`order_statistics` under one convention: ``p50``, ``p95`` and so on."""
    return order_statistics(rows, by, value, {f"p{round(q * 100)}": (convention, q) for q in quantiles})
