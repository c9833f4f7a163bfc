"""Exact batch top-k: every query against every vector, without emitting the pairs.

Each task multiplies its Arrow batches with the query matrix and keeps a running best ``k`` per
query, so a task emits at most ``queries x k`` rows however many vectors it reads; only those
meet in the shuffle. Vectors never move. The k-th best score so far is a floor: after the first
batches few scores reach it, and only those are rounded, labelled and sorted.

The query matrix is broadcast, so its size is checked first. A query set beyond the bound is
hash-split into blocks that each fit; the vectors are then scanned once per block and every
block's result is written to the shared folder before the next is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.schema import ConfigError, DimensionError
from corvane.session import cut_lineage

BROADCAST_VALUES = 8_000_000  # 64 MB of doubles
SCORE_BLOCK_VALUES = 16_000_000  # 128 MB per score block in a task
WAITING = 200_000  # rows at or above the floor that wait to be sorted


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    sizes = pc.list_value_length(column)
    if len(column) and (pc.min(sizes).as_py() != dim or pc.max(sizes).as_py() != dim):
        raise DimensionError(f"expected vectors of width {dim}, got {pc.min(sizes)} to {pc.max(sizes)}")
    flat = pc.list_flatten(column).cast(pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _best(found: pa.Table, k: int, groups: list[str], ties: list[str], unique: list[str]) -> pa.Table:
    """The first ``k`` rows per group by (score desc, ties asc); one row per ``unique`` key."""
    if found.num_rows == 0:
        return found
    order = [(g, "ascending") for g in groups] + [("score", "descending")] + [(t, "ascending") for t in ties]
    found = found.sort_by(order)
    if unique:
        found = found.append_column("_at", pa.array(np.arange(found.num_rows)))
        first = found.group_by([*groups, *unique]).aggregate([("_at", "min")]).column("_at_min")
        found = found.take(pa.array(np.sort(first.to_numpy()))).drop_columns(["_at"])
    codes = _codes(found, groups)
    starts = np.r_[0, np.flatnonzero(np.diff(codes)) + 1]
    position = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
    return found.filter(pa.array(position < k))


def _codes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """One integer per row, changing whenever any of the sorted ``columns`` changes."""
    changed = np.zeros(table.num_rows, dtype=bool)
    for name in columns:
        column = table.column(name).combine_chunks()
        if table.num_rows > 1:
            changed[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(changed)


@dataclass(frozen=True)
class Expansion:
    """Rows that are made of each row read, in the task that ranks them (the chunks of a document)."""

    columns: Sequence[str]  # read
    schema: T.StructType  # made: segments, keys and payload
    rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]


def _scan(batches, queries, build, width, k, keys, segments, unique, decimals, qid_type, expand):
    """One task's running top-k. ``queries`` broadcasts ``(qids, weights)``, one row per query;
    ``build`` turns a batch into the matrix those weights multiply."""
    qids, qmatrix = queries.value
    wanted = pa.array(qids, type=qid_type)
    step = max(1, SCORE_BLOCK_VALUES // max(1, len(qids), width))
    numbers: dict[tuple, int] = {}  # of the segments met so far
    floors = np.empty((0, len(qids)))
    state: pa.Table | None = None
    new: list[pa.Table] = []
    waiting = 0

    def settle() -> pa.Table:
        """The best of the rows kept and the rows that wait; the last of each full group is its floor."""
        found = pa.concat_tables([state, *new] if state is not None else new)
        at = found.column("_s").to_numpy() * len(qids) + found.column("_q").to_numpy()
        found = found.filter(pa.array(found.column("score").to_numpy() >= floors.reshape(-1)[at]))
        found = _best(found, k, ["_s", "_q"], keys, unique).combine_chunks()
        group = found.column("_s").to_numpy() * len(qids) + found.column("_q").to_numpy()
        sizes = np.bincount(group, minlength=floors.size)
        full = np.flatnonzero(sizes == k)
        floors.reshape(-1)[full] = found.column("score").to_numpy()[np.cumsum(sizes)[full] - 1]
        return found

    for batch in batches:
        for made in expand.rows(batch) if expand else (batch,):
            for at in range(0, made.num_rows, step):
                part = made.slice(at, step)
                labels = pa.Table.from_batches([part.select([*segments, *keys])])
                matrix = build(part)
                of, named = _segments_of(labels, segments)
                for code, name in enumerate(named):
                    rows = np.flatnonzero(of == code)
                    number = numbers.setdefault(name, len(numbers))
                    if number == len(floors):
                        floors = np.vstack([floors, np.full((1, len(qids)), -np.inf)])
                    lead = table_codes(labels.select(unique).take(pa.array(rows)), unique) if unique else None
                    near, cols, score = _above_floor(matrix[rows] @ qmatrix.T, floors[number], lead, k, decimals)
                    found = labels.select(keys).take(pa.array(rows[near]))
                    found = found.append_column("_s", pa.array(np.full(len(near), number))).append_column("_q", pa.array(cols))
                    new.append(found.append_column("score", pa.array(score)))
                    waiting += len(near)
                if waiting > max(WAITING, 0 if state is None else state.num_rows):
                    state, new, waiting = settle(), [], 0
    if new:
        state = settle()
    if state is not None and state.num_rows:
        out = state.append_column("qid", wanted.take(state.column("_q").combine_chunks()))
        names = list(numbers)
        for i, segment in enumerate(segments):
            values = pa.array([name[i] for name in names], labels.schema.field(segment).type)
            out = out.append_column(segment, values.take(state.column("_s").combine_chunks()))
        yield from out.select(["qid", *segments, *keys, "score"]).to_batches()


def _segments_of(labels: pa.Table, segments: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """A number per row and what each number stands for."""
    if not segments:
        return np.zeros(labels.num_rows, dtype=np.int64), [()]
    _, first, of = np.unique(table_codes(labels, segments), return_index=True, return_inverse=True)
    return of, [tuple(r.values()) for r in labels.select(segments).take(pa.array(first)).to_pylist()]


def _above_floor(scores: np.ndarray, floor: np.ndarray, lead: np.ndarray | None, k: int, decimals: int | None):
    """Rows, queries and scores that can still be among the best ``k`` of a segment; raises the ``floor`` by what is found.

    ``lead`` numbers the rows' unique keys; only the best rows of a key are kept.
    """
    if np.isneginf(floor).any():
        if decimals is not None:
            scores = np.round(scores, decimals) + 0.0
        best = scores
        if lead is not None:
            order = np.argsort(lead, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(lead[order]) != 0])
            best = np.maximum.reduceat(scores[order], starts, axis=0)
        if len(best) >= k:
            np.maximum(floor, np.partition(best, len(best) - k, axis=0)[len(best) - k], out=floor)
        keep = scores >= floor
        if lead is not None:
            full = np.empty_like(scores)
            full[order] = np.repeat(best, np.diff(np.r_[starts, len(lead)]), axis=0)
            keep &= scores == full
        rows, cols = np.nonzero(keep)
        return rows, cols, scores[rows, cols]
    slack = 0.0 if decimals is None else 10.0**-decimals
    rows, cols = np.divmod(np.flatnonzero(scores >= floor - slack), len(floor))
    found = scores[rows, cols]
    if decimals is not None:
        found = np.round(found, decimals) + 0.0
        reach = found >= floor[cols]
        rows, cols, found = rows[reach], cols[reach], found[reach]
    return rows, cols, found


def table_codes(labels: pa.Table, columns: list[str]) -> np.ndarray:
    codes = np.zeros(labels.num_rows, dtype=np.int64)
    for name in columns:
        column = labels.column(name).combine_chunks().dictionary_encode("encode")
        codes = codes * (len(column.dictionary) + 1) + column.indices.to_numpy(zero_copy_only=False)
    return codes


def _collect_queries(queries: DataFrame, dim: int) -> tuple[list, np.ndarray, pa.DataType]:
    """A query block the caller has already bounded, as ids and a unit matrix."""
    table = queries.select("qid", "vector").toArrow()
    column = table.column("vector").combine_chunks()
    return table.column("qid").to_pylist(), _unit_rows(_matrix(column, dim)), table.schema.field("qid").type


def rank_against(
    source: DataFrame,
    qids: list,
    weights: np.ndarray,
    build: Callable[[pa.RecordBatch], np.ndarray],
    k: int,
    *,
    qid_field: tuple[T.DataType, pa.DataType],
    keys: list[str],
    segments: list[str],
    unique: list[str],
    decimals: int | None,
    expand: Expansion | None = None,
) -> DataFrame:
    """Rank the rows of ``source`` for one bounded block of queries (a matrix product per batch)."""
    shipped = source.sparkSession.sparkContext.broadcast((qids, weights))
    width, qid_type = weights.shape[1], qid_field[1]
    ranked_rows = expand.schema if expand else source.schema
    out = T.StructType(
        [T.StructField("qid", qid_field[0])]
        + [T.StructField(c, ranked_rows[c].dataType) for c in [*segments, *keys]]
        + [T.StructField("score", T.DoubleType())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scan(batches, shipped, build, width, k, keys, segments, unique, decimals, qid_type, expand)

    ranked = source.mapInArrow(scan, out)
    if unique:
        best = Window.partitionBy("qid", *segments, *unique).orderBy(F.desc("score"), *keys)
        ranked = ranked.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    order = Window.partitionBy("qid", *segments).orderBy(F.desc("score"), *keys)
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of(scored: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    """The ``k`` best of candidates ``qid, keys..., score``; bounded by what the scans before let through."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *keys)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def in_blocks(
    queries: DataFrame, cap: int, one_pass: Callable[[DataFrame], DataFrame], depth: int = 0
) -> DataFrame:
    """Run ``one_pass`` over query blocks of at most ``cap`` rows.

    One block when the set is small; otherwise the set is hash-split and each block's result is
    written out before the next block is broadcast. A block the hash overfilled is split again.
    """
    if queries.select("qid").limit(cap + 1).count() <= cap:
        return one_pass(queries)
    if depth > 16:
        raise ConfigError("query ids repeat: no split brings them under the broadcast bound")
    blocks = -(-2 * queries.count() // cap)
    number = F.pmod(F.xxhash64("qid", F.lit(depth)), F.lit(blocks))
    split = cut_lineage(queries.withColumn("_block", number))
    result: DataFrame | None = None
    for one in range(blocks):
        done = cut_lineage(in_blocks(split.where(F.col("_block") == one).drop("_block"), cap, one_pass, depth + 1))
        result = done if result is None else result.unionByName(done)
    return result


def exact_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    dim: int,
    keys: Sequence[str],
    segments: Sequence[str] = (),
    unique: Sequence[str] = (),
    decimals: int | None = 6,
    max_values: int = BROADCAST_VALUES,
) -> DataFrame:
    """The ``k`` best rows of ``vectors`` per query: ``qid, segments..., keys..., score, rank``.

    ``segments`` asks for the top-k inside each segment value (one corpus, one collection).
    ``unique`` keeps only the best row per value of those key columns, which turns a ranking of
    chunks into one of documents before anything is cut, so no over-fetch factor is needed.
    Ties break on ``keys`` in the order given. ``decimals`` rounds scores before ranking, so that
    the last bits of a matrix product, which depend on how rows fell into batches, decide nothing.
    """
    if k < 1:
        raise ConfigError("k must be at least 1")
    keys, segments, unique = list(keys), list(segments), list(unique)
    if not set(unique) <= set(keys):
        raise ConfigError("unique columns must be among the keys")

    def unit(part: pa.RecordBatch) -> np.ndarray:
        return _unit_rows(_matrix(part.column("vector"), dim))

    return topk_by(
        vectors, queries, k, unit, dim=dim, keys=keys, segments=segments, unique=unique, payload=["vector"],
        decimals=decimals, max_values=max_values,
    )


def folded(dim: int, width: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Unit vectors of ``width`` buckets from hashed bags of ``dim``: a bucket number modulo a divisor of ``dim`` is that of the
    narrower bag, so one embedded table serves every width."""
    if dim % width:
        raise ConfigError(f"{width} buckets do not divide {dim}")

    def build(part: pa.RecordBatch) -> np.ndarray:
        return _unit_rows(_matrix(part.column("vector"), dim).reshape(part.num_rows, dim // width, width).sum(axis=1))

    return build


def topk_by(
    rows: DataFrame,
    queries: DataFrame,
    k: int,
    build: Callable[[pa.RecordBatch], np.ndarray],
    *,
    dim: int,
    keys: Sequence[str],
    segments: Sequence[str] = (),
    unique: Sequence[str] = (),
    payload: Sequence[str] = (),
    decimals: int | None = 6,
    max_values: int = BROADCAST_VALUES,
    expand: Expansion | None = None,
) -> DataFrame:
    """:func:`exact_topk` over whatever vectors ``build`` makes of a batch of ``segments``, ``keys`` and ``payload``, read or made by ``expand``."""
    keys, segments, unique = list(keys), list(segments), list(unique)
    slim = rows.select(*(expand.columns if expand else [*segments, *keys, *payload]))

    def one_pass(block: DataFrame) -> DataFrame:
        qids, matrix, qid_type = _collect_queries(block, dim)
        return rank_against(
            slim, qids, matrix, build, k, qid_field=(block.schema["qid"].dataType, qid_type),
            keys=keys, segments=segments, unique=unique, decimals=decimals, expand=expand,
        )

    return in_blocks(queries.select("qid", "vector"), max(1, max_values // dim), one_pass)
