"""Approximate search, opt-in and always reported next to the exact result.

k-means cells: a query probes its nearest few cells and ranks their rows exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.rows import fan_out
from corvane.functions.vectors import TINY, cosine, normalize
from corvane.operators.topk import best_of, exact_topk, topk_by
from corvane.schema import ConfigError
from corvane.session import cut_lineage, shared_folder

ANN_MIN_ROWS = 100_000  # fixed value: below this an exact scan is used


@dataclass(frozen=True)
class AnnParams:
    """Approximate-search knobs; ``None`` leaves a knob to the preset or the backend."""

    nprobes: int | None = None
    refine_factor: int | None = None
    ef_search: int | None = None

    def over(self, preset: AnnParams) -> AnnParams:
        """These knobs where set, the preset's elsewhere."""
        set_here = {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}
        return replace(preset, **set_here)


# The measured presets per store and recall level (an unset knob is the store's own).
PRESETS = {
    ("lancedb", "fast"): AnnParams(nprobes=10),
    ("lancedb", "balanced"): AnnParams(nprobes=10, refine_factor=5),
    ("lancedb", "accurate"): AnnParams(nprobes=40, refine_factor=10),
    ("pgvector", "fast"): AnnParams(ef_search=20),
    ("pgvector", "balanced"): AnnParams(),
    ("pgvector", "accurate"): AnnParams(ef_search=200),
    ("mariadb", "fast"): AnnParams(ef_search=20),
    ("mariadb", "balanced"): AnnParams(),
    ("mariadb", "accurate"): AnnParams(ef_search=200),
}


def resolve_params(store: str, recall: str, overrides: AnnParams | None = None) -> AnnParams:
    """The preset with the caller's knobs on top; an exact store has none."""
    preset = PRESETS.get((store, recall))
    if preset is None:
        return AnnParams()
    return (overrides or AnnParams()).over(preset)


def search_mode(rows: Column, threshold: int = ANN_MIN_ROWS) -> Column:
    """Which search a collection of ``rows`` rows gets."""
    return F.when(rows >= threshold, F.lit("approximate")).otherwise(F.lit("exact"))


def ivf_centroids(vectors: DataFrame, cells: int, *, seed: int = 7) -> np.ndarray:
    """k-means centroids over all unit vectors, one row per cell; ``cells`` is fixed by the caller."""
    unit = vectors.select(array_to_vector(normalize(F.col("vector"))).alias("features"))
    return np.asarray(KMeans(k=cells, seed=seed, maxIter=10).fit(unit).clusterCenters())


def nearest_cells(rows: DataFrame, centroids: np.ndarray, count: int) -> DataFrame:
    """Each row with its unit vector and its ``count`` nearest cells (``cells array<int>``)."""
    shipped = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.arrow_udf("array<int>")
    def nearest(units: pa.Array) -> pa.Array:
        table = shipped.value
        flat = pc.list_flatten(units).to_numpy(zero_copy_only=False).reshape(len(units), table.shape[1])
        # |u - c|^2 without |u|^2, which is the same for every cell of a row
        distance = (table * table).sum(axis=1) - 2 * flat @ table.T
        best = np.argsort(distance, axis=1, kind="stable")[:, :count].astype(np.int32)
        offsets = pa.array(np.arange(len(units) + 1, dtype=np.int32) * count)
        return pa.ListArray.from_arrays(offsets, pa.array(best.reshape(-1)))

    unit = rows.withColumn("_unit", normalize(F.col("vector")))
    return unit.withColumn("cells", nearest(F.col("_unit")))


class IvfIndex:
    """A stored inverted-file index: unit vectors filed by their nearest centroid, and the centroids beside them."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, cells: int) -> IvfIndex:
        """Train on all rows and file them; ``vectors`` has a ``vector`` and any key columns."""
        centroids = ivf_centroids(vectors, cells)
        rows = [(i, [float(x) for x in c]) for i, c in enumerate(centroids)]
        self.spark.createDataFrame(rows, "cell int, centroid array<double>").write.parquet(f"{self.path}/centroids")
        filed = nearest_cells(vectors, centroids, 1).withColumn("vector", F.col("_unit")).withColumn("cell", F.get("cells", F.lit(0)))
        filed.drop("_unit", "cells").hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{self.path}/rows")
        return self

    def search(self, queries: DataFrame, k: int, *, dim: int, keys: Sequence[str], nprobes: int, decimals: int = 6) -> DataFrame:
        """``qid, keys..., score, rank``: the best ``k`` rows among each query's ``nprobes`` nearest cells.

        Only the folders of cells that some query probes are read. The kernel keeps the best ``k`` of every cell
        and query inside the scan, so no pair of a row and a query becomes a row of its own.
        """
        table = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        if nprobes < 1 or nprobes > len(table):
            raise ConfigError("nprobes must be between 1 and the number of cells")
        centroids = np.array([r["centroid"] for r in table])
        probes = fan_out(nearest_cells(queries, centroids, nprobes), ["qid"], F.col("cells"), "cell")
        wanted = [r["cell"] for r in probes.select("cell").distinct().collect()]  # at most one per cell
        rows = self.spark.read.parquet(f"{self.path}/rows").where(F.col("cell").isin(wanted))
        best = exact_topk(rows, queries, k, dim=dim, keys=keys, segments=["cell"], decimals=decimals)
        order = Window.partitionBy("qid").orderBy(F.desc("score"), *keys)
        near = best.drop("rank").join(probes, ["qid", "cell"]).drop("cell")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- codes ----------------------------------------------------------------------------------------------------------

TRAIN_ROWS = 65_536  # rows that centroids and code books are fitted to, at most
PART = 4  # components that share a code
CODES = 256  # codes of a part, so that a code is one byte


def default_cells(rows: int) -> int:
    return max(1, min(4096, round(rows**0.5 / 2)))


def fitted_codes(points: np.ndarray, codes: int, rounds: int = 8) -> np.ndarray:
    """k-means of a bounded sample, from points spread over it; a code that nothing is near keeps its place."""
    return _moved(points, points[np.linspace(0, len(points) - 1, codes).astype(np.int64)].copy(), rounds)


def fitted_cells(points: np.ndarray, cells: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k-means of a bounded sample, from points drawn by their distance to those drawn before; as many as differ, at most."""
    draw = np.random.default_rng(seed)
    chosen = [int(draw.integers(len(points)))]
    # differences are squared, not multiplied out, so that a copy of a chosen point is at 0 and is never drawn
    far = ((points - points[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < cells and far.any():
        upto = np.cumsum(far)
        chosen.append(int(np.searchsorted(upto, draw.random() * upto[-1], side="right").clip(0, len(points) - 1)))
        for first in range(0, len(points), 8192):
            part = slice(first, first + 8192)
            np.minimum(far[part], ((points[part] - points[chosen[-1]]) ** 2).sum(axis=1), out=far[part])
    return _moved(points, points[chosen], rounds)


def _moved(points: np.ndarray, book: np.ndarray, rounds: int) -> np.ndarray:
    """Every entry moved to the mean of the points nearest to it, ``rounds`` times."""
    for _ in range(rounds):
        near = _nearest(points, book)
        many = np.bincount(near, minlength=len(book))
        sums = np.stack([np.bincount(near, weights=points[:, c], minlength=len(book)) for c in range(points.shape[1])], axis=1)
        book[many > 0] = sums[many > 0] / many[many > 0][:, None]
    return book


def _units(vectors: pa.Array, dim: int) -> np.ndarray:
    """:func:`normalize` in bulk."""
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).reshape(-1, dim)
    return flat / np.maximum(np.sqrt((flat * flat).sum(axis=1, keepdims=True)), TINY)


DISTANCES = 1 << 21  # distances that are held at once, 16 MB


def _nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """The nearest entry of each point; the distances of some points at a time."""
    out, step, own = np.empty(len(points), np.int64), max(1, DISTANCES // max(1, len(book))), (book * book).sum(axis=1)
    for first in range(0, len(points), step):
        distance = points[first : first + step] @ (-2 * book.T)
        distance += own
        out[first : first + step] = distance.argmin(axis=1)
    return out


class CodeIndex:
    """Product-quantised codes of unit vectors, filed by their nearest centroid.

    What a row differs from its centroid is cut into parts of ``PART`` components, and each part is the number of the
    nearest entry of its code book: a byte each instead of eight bytes a component. Centroids and books are fitted
    to at most ``TRAIN_ROWS`` rows; every row is encoded.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def train(self, rows: DataFrame, dim: int, cells: int | None = None) -> CodeIndex:
        """Fit centroids and books and write them; ``rows`` has a ``vector``. One task holds the sample, the driver none of it."""
        total = rows.count()
        cells = min(total, cells or default_cells(total))
        share = min(1.0, 1.2 * TRAIN_ROWS / max(1, total))
        some = rows.select("vector").sample(share, seed=7).limit(TRAIN_ROWS) if share < 1 else rows.select("vector")

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            units = np.concatenate([np.empty((0, dim)), *[_units(b.column(0), dim) for b in batches]])
            if not len(units):
                return
            centroids = fitted_cells(units, cells)
            rest = units - centroids[_nearest(units, centroids)]
            books = [fitted_codes(rest[:, at : at + PART], min(CODES, len(rest))) for at in range(0, dim, PART)]
            for part, table in enumerate([centroids, *books], -1):
                ends = pa.array(np.arange(len(table) + 1, dtype=np.int32) * table.shape[1])
                entries = pa.ListArray.from_arrays(ends, pa.array(table.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(table), part, np.int32)), pa.array(np.arange(len(table), dtype=np.int32)), entries], ["part", "code", "entry"])

        fitted = cut_lineage(some.repartition(1).mapInArrow(fit, "part int, code int, entry array<double>"))
        centroids = fitted.where("part < 0").select(F.col("code").alias("cell"), F.col("entry").alias("centroid"))
        centroids.coalesce(1).write.parquet(f"{self.path}/centroids")
        fitted.where("part >= 0").coalesce(1).write.parquet(f"{self.path}/books")
        return self

    def follow(self, last: CodeIndex, gone: DataFrame) -> CodeIndex:
        """Take over an earlier index without the codes of the URIs in ``gone``."""
        for kind in ("centroids", "books"):
            self.spark.read.parquet(f"{last.path}/{kind}").coalesce(1).write.parquet(f"{self.path}/{kind}")
        kept = self.spark.read.parquet(f"{last.path}/codes").join(gone, "uri", "left_anti")
        kept.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(f"{self.path}/codes")
        return self

    def _fitted(self) -> tuple[np.ndarray, list[np.ndarray]]:
        cells = self.spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()
        books: dict[int, list] = {}
        for r in self.spark.read.parquet(f"{self.path}/books").orderBy("part", "code").collect():
            books.setdefault(r["part"], []).append(r["entry"])
        return np.array([r["centroid"] for r in cells]), [np.array(b) for _, b in sorted(books.items())]

    def add(self, rows: DataFrame, keys: Sequence[str]) -> CodeIndex:
        """Encode ``rows`` and file their codes; ``keys`` name a row."""
        shipped = self.spark.sparkContext.broadcast(self._fitted())

        @F.arrow_udf("struct<cell: int, code: binary>")
        def encoded(vectors: pa.Array) -> pa.Array:
            centroids, books = shipped.value
            units = _units(vectors, centroids.shape[1])
            cell = _nearest(units, centroids)
            rest = units - centroids[cell]
            at = np.cumsum([0, *(b.shape[1] for b in books)])
            code = np.stack([_nearest(rest[:, s : s + b.shape[1]], b) for s, b in zip(at, books, strict=False)], axis=1).astype(np.uint8)
            return pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], ["cell", "code"])

        filed = rows.select(*keys, encoded(F.col("vector")).alias("_found")).select(*keys, "_found.code", "_found.cell")
        filed.hint("rebalance", F.col("cell")).write.mode("append").partitionBy("cell").parquet(f"{self.path}/codes")
        return self

    def candidates(self, queries: DataFrame, many: int, *, dim: int, keys: Sequence[str], nprobes: int) -> DataFrame:
        """``qid, keys...``: for each query the ``many`` rows of best coded score in its ``nprobes`` nearest cells.

        Only folders of cells that some query probes are read, and the kernel keeps the best of every cell and query
        inside the scan.
        """
        centroids, books = self._fitted()
        probes = fan_out(nearest_cells(queries, centroids, min(nprobes, len(centroids))), ["qid"], F.col("cells"), "cell")
        probes = cut_lineage(probes)
        wanted = [r["cell"] for r in probes.select("cell").distinct().collect()]  # at most one per cell
        rows = self.spark.read.parquet(f"{self.path}/codes").where(F.col("cell").isin(wanted))

        def decoded(part: pa.RecordBatch) -> np.ndarray:
            code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, len(books))
            return centroids[part.column("cell").to_numpy()] + np.concatenate([b[code[:, p]] for p, b in enumerate(books)], axis=1)

        best = topk_by(rows, queries, many, decoded, dim=dim, keys=keys, segments=["cell"], payload=["code"])
        return best_of(best.drop("rank").join(probes, ["qid", "cell"]).drop("cell"), many, keys).select("qid", *keys)

    def rescored(self, near: DataFrame, rows: DataFrame, queries: DataFrame, keys: Sequence[str], few: int) -> DataFrame:
        """``qid, keys..., score`` of candidates by their vectors; few candidates go to the vectors, not the other way round."""
        asked = near.join(queries.select("qid", F.col("vector").alias("_asked")), "qid")
        asked = F.broadcast(asked) if near.count() * len(self._fitted()[0][0]) <= few * 64 else asked
        met = rows.select(*keys, "vector").join(asked, list(keys))
        return met.select("qid", *keys, F.round(cosine(F.col("vector"), F.col("_asked")), 6).alias("score"))


def ivf_topk(vectors: DataFrame, queries: DataFrame, k: int, *, key: str, cells: int, nprobes: int, dim: int = 64) -> DataFrame:
    """An index built for one search, in the shared folder."""
    spark = vectors.sparkSession
    index = IvfIndex(spark, f"{shared_folder(spark)}/ivf-{uuid.uuid4().hex}").build(vectors.select(key, "vector"), cells)
    return index.search(queries, k, dim=dim, keys=[key], nprobes=nprobes)
