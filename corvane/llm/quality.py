"""An ordinal quality classifier: cumulative-link regression on hashed text, for graded ratings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BLANKS, NO_ID, id_back, keyed, lists, map_batches, map_partitions, stored, texts

SPACE = 1 << 18  # hashed features
SAMPLE = 10_000  # rated rows at most that a fit sees
LEAST_ROWS = 5  # rated rows that a feature needs
TELLING = 4.0  # standard errors by which its share must differ between grades
EDGE = b".,;:!?()[]\"'"
MARKS = b"#*$%&|<>!"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LETTERS = UPPER + UPPER.lower()


@dataclass(frozen=True)
class OrdinalModel:
    """``P(grade > k) = sigmoid(w . x - threshold[k])``: one weight vector for all grades, thresholds in ascending order."""

    weights: np.ndarray
    thresholds: np.ndarray


def words_of(text: bytes) -> set[bytes]:
    return {w.strip(EDGE) for w in text.lower().split()} - {b""}


def shape(text: bytes) -> list[bytes]:
    """What the words do not tell: the shares of marks, capitals, other words and repeated lines, in steps."""
    words = text.split()
    if not words:
        return [b"\x00empty"]
    chars = len(text.translate(None, BLANKS))
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    shares = {
        b"mark": (len(text) - len(text.translate(None, MARKS))) / chars,
        b"upper": (len(text) - len(text.translate(None, UPPER))) / chars,
        b"letter": (len(text) - len(text.translate(None, LETTERS))) / chars,
        b"distinct": len(set(words)) / len(words),
        b"lines": len(set(lines)) / len(lines),
    }
    steps = (0.01, 0.03, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
    return [b"\x00%s>%d" % (name, k) for name, share in shares.items() for k, step in enumerate(steps) if share > step]


def features(text: bytes) -> np.ndarray:
    """Places of the distinct words and of the shape in the hashed space."""
    found = [*words_of(text), *shape(text)]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    return np.unique((h & np.uint64(SPACE - 1)).astype(np.int32))


def featured(df: DataFrame, keep: str) -> DataFrame:
    """``df``'s rows ``id, text, <keep>`` with the text turned into ``x array<int>``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = lists([features(t) for t in texts(batch.column(1))], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), x], ["id", keep, "x"])

    return map_batches(df.select("id", "text", keep), run, f"id long, {keep} int, x array<int>")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def screened(rows: list[np.ndarray], grades: np.ndarray, n_grades: int) -> np.ndarray:
    """Which features occur clearly more or less often above some grade than up to it; the rest is noise to a fit."""
    all_of = np.bincount(np.concatenate(rows), minlength=SPACE).astype(float)
    keep = np.zeros(SPACE, dtype=bool)
    for k in range(n_grades - 1):
        above = np.flatnonzero(grades > k)
        n, m = len(rows), len(above)
        if not 0 < m < n:
            continue
        high = np.bincount(np.concatenate([rows[i] for i in above]), minlength=SPACE)
        share = all_of / n
        error = np.sqrt(share * (1 - share) * (1 / m + 1 / (n - m))) + 1e-12
        keep |= np.abs(high / m - (all_of - high) / (n - m)) > TELLING * error
    return keep & (all_of >= LEAST_ROWS)


def train(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, epochs: int = 30, rate: float = 0.4, decay: float = 1e-3) -> OrdinalModel:
    """Cumulative-link fit by mini-batches with per-weight steps; the same rows in the same order give the same model."""
    w, square = np.zeros(SPACE), np.full(SPACE, 1e-6)
    grades = grades.astype(np.int64)
    share = np.array([(grades > k).mean() for k in range(n_grades - 1)]) if len(grades) else np.full(n_grades - 1, 0.5)
    share = np.clip(share, 0.01, 0.99)
    theta = np.sort(-np.log(share / (1 - share)))
    if not rows:
        return OrdinalModel(w, theta)
    telling = screened(rows, grades, n_grades)
    rows = [r[telling[r]] for r in rows]
    order = np.random.default_rng(7)
    theta_square = np.full(n_grades - 1, 1e-8)
    for _ in range(epochs):
        places = order.permutation(len(rows))
        for start in range(0, len(rows), 256):
            at = places[start : start + 256]
            sizes = [len(rows[i]) for i in at]
            flat = np.concatenate([rows[i] for i in at])  # may be empty: the thresholds still learn
            owner = np.repeat(np.arange(len(at)), sizes)
            score = np.bincount(owner, weights=w[flat], minlength=len(at))
            y = grades[at]
            f = sigmoid(np.append(theta, np.inf) - score[:, None])  # P(grade <= k), last column 1
            low = np.where(y > 0, f[np.arange(len(at)), y - 1], 0.0)
            high = f[np.arange(len(at)), y]
            high = np.where(y == n_grades - 1, 1.0, high)
            mass = np.maximum(high - low, 1e-9)
            # d(-log mass): by the score, and by the two thresholds around the grade
            d_high, d_low = high * (1 - high) / mass, low * (1 - low) / mass
            g_score = (d_high - d_low) / len(at)
            g = np.bincount(flat, weights=g_score[owner], minlength=SPACE)
            hit = np.unique(flat)
            gw = g[hit] + decay * w[hit]
            square[hit] += gw * gw
            w[hit] -= rate * gw / np.sqrt(square[hit])
            g_theta = np.zeros(n_grades - 1)
            for k in range(n_grades - 1):
                g_theta[k] = (np.where(y - 1 == k, d_low, 0).sum() - np.where(y == k, d_high, 0).sum()) / len(at)
            theta_square += g_theta * g_theta
            theta = np.maximum.accumulate(theta - rate * g_theta / np.sqrt(theta_square))
    return OrdinalModel(w, theta)


def fit(
    docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
    sample: int = SAMPLE,
) -> OrdinalModel:
    """A model from at most ``sample`` rated documents, those with the least hashed ids.

    A rating without a document, a grade outside ``0 .. n_grades - 1`` and a null id or grade are not used; of several ratings
    of an id the lowest counts, and so does one text of a repeated id. Without usable ratings the weights are zero.
    """
    rated = ratings.select(F.col(id_col).cast("long").alias("id"), F.col(grade_col).cast("int").alias("grade"))
    rated = rated.where(F.col("id").isNotNull() & F.col("grade").between(0, n_grades - 1)).groupBy("id").agg(F.min("grade").alias("grade"))
    rows = keyed(docs, id_col, text_col)
    # bounded by ``sample`` rows of an id and a grade; half as many again, since some may have no document
    chosen = rated.orderBy(F.xxhash64("id"), "id").limit(sample + sample // 2)
    found = rows.where(F.col("id") != NO_ID).join(F.broadcast(chosen), "id")
    table = stored(featured(found, "grade"), "rated")
    model = trained(first_rated(table, sample), n_grades).toArrow()
    weights = np.zeros(SPACE)
    weights[model.column("place").combine_chunks().flatten().to_numpy()] = model.column("weight").combine_chunks().flatten().to_numpy()
    return OrdinalModel(weights, model.column("thresholds").combine_chunks().flatten().to_numpy())


def trained(first: DataFrame, n_grades: int) -> DataFrame:
    """``place, weight, thresholds``: one row, the fit to ``first``. A task sees the sample; the driver sees the weights only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        model = train(*columns_of(pa.Table.from_batches(held)) if held else ([], np.empty(0, np.int64)), n_grades)
        at = np.flatnonzero(model.weights).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [lists([at], pa.int32()), lists([model.weights[at]], pa.float64()), lists([model.thresholds], pa.float64())], ["place", "weight", "thresholds"]
        )

    return map_partitions(first.coalesce(1), run, "place array<int>, weight array<double>, thresholds array<double>")


def first_rated(table: DataFrame, sample: int) -> DataFrame:
    """The first ``sample`` rows by hashed id, in this order."""
    return table.orderBy(F.xxhash64("id"), "id", "x").limit(sample)


def drawn(table: DataFrame, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    """``columns_of`` the first ``sample`` rows; they stay columns on their way to the driver."""
    return columns_of(first_rated(table, sample).toArrow())


def columns_of(first: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of rows in order, one row per id."""
    first = first.combine_chunks()
    if not first.num_rows:
        return [], np.empty(0, np.int64)
    at = np.sort(np.unique(first.column("id").to_numpy(), return_index=True)[1])
    x = first.column("x").chunk(0)
    flat, ends = x.values.to_numpy(), x.offsets.to_numpy()
    return [flat[ends[i] : ends[i + 1]] for i in at], first.column("grade").to_numpy()[at]


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, expected_grade, tail``: one row per document; ``tail[k]`` is the chance of a grade above ``k``.

    The model, ``SPACE`` numbers whatever the data, is broadcast. A null text is scored as an empty one; repeated rows
    are scored one by one; a null id stays null; an empty table gives an empty one; other columns are not read.
    """
    known = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        weights, thresholds = known.value
        z = np.array([weights[features(t)].sum() for t in texts(batch.column(1))])
        tail = sigmoid(z[:, None] - thresholds)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(tail.sum(axis=1)), lists(list(tail), pa.float64())], ["id", "expected_grade", "tail"]
        )

    out = map_batches(keyed(docs, id_col, text_col), run, "id long, expected_grade double, tail array<double>")
    return out.select(id_back("id").alias("doc_id"), "expected_grade", "tail")


def keep(docs: DataFrame, model: OrdinalModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose chance of the best grade is at least ``least``."""
    known = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        weights, thresholds = known.value
        z = np.array([weights[features(t)].sum() for t in texts(batch.column(at))])
        yield batch.filter(pa.array(sigmoid(z - thresholds[-1]) >= least, pa.bool_()))

    return map_batches(docs, run, docs.schema)


def grades(labels: DataFrame) -> DataFrame:
    """Grades from two marks: 0 poor, 1 good but toxic, 2 good. A null mark counts as poor, or as toxic."""
    good, clean = F.coalesce(F.col("quality"), F.lit(0)) == 1, F.coalesce(F.col("toxic"), F.lit(1)) == 0
    return labels.select("doc_id", F.when(~good, 0).when(~clean, 1).otherwise(2).alias("grade"))
