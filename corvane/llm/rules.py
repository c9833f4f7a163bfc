"""Quality rules: fixed limits on counts, then robust multivariate outliers per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import BLANKS, NO_ID, id_back, lists, map_batches, mix64, stored, texts
from corvane.llm.shingles import word_hashes

SYMBOLS = b"#*$%&|<>"
NOT_START = bytes(range(0x80, 0xC0))  # UTF-8 bytes that continue a code point
UPPER = bytes(range(ord("A"), ord("Z") + 1))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

# The transformed statistics, and the least spread each is given: most texts have no symbol at all, and a
# group that agrees exactly must not turn one odd character into an infinite distance.
STATISTICS = ("log_word_length", "root_symbol_share", "root_dup_line_share", "root_repeat_share", "root_upper_share")
LEAST_SPREAD = (0.05, 0.06, 0.15, 0.12, 0.10)
# Chi-square quantile for five statistics at one clean text in a million.
CUT = 35.89
CORE = 0.75  # share of a group whose scatter has the least determinant
STEPS = 3
LEAST_GROUP = 200  # smaller groups are judged with their language, smaller languages with everything
FEW = 20_000  # rows of a parameter table up to which it is broadcast


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(hashes)
    if n < 4:
        return 0
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    windows = mix64(hashes[:-2] * a + hashes[1:-1]) * b + hashes[2:]
    _, where, many = np.unique(windows, return_inverse=True, return_counts=True)
    at = np.flatnonzero(many[where] > 1)
    covered = np.zeros(n, dtype=bool)
    for step in range(3):
        covered[at + step] = True
    return int(covered.sum())


def counts(text: bytes) -> tuple[int, int, int, int, int, int, int]:
    """``COUNTS``, then lines with a word and upper-case letters, of one whole text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text.translate(None, NOT_START + BLANKS)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(word_hashes(words)),
        len(lines),
        len(text) - len(text.translate(None, UPPER)),
    )


def statistics(c: tuple[int, ...]) -> list[float]:
    words, chars, symbols, dup, repeat, lines, upper = c
    if not words:
        return [0.0] * len(STATISTICS)
    return [
        float(np.log(chars / words)), (symbols / chars) ** 0.5, (dup / lines) ** 0.5, (repeat / words) ** 0.5,
        min(1.0, upper / chars) ** 0.5,
    ]


def measured(df: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [counts(t) for t in texts(batch.column(1))]
        columns = [pa.array([c[k] for c in found], type=pa.int64()) for k in range(len(COUNTS))]
        failed = pa.array([c[0] < 50 or 100 * c[4] > 50 * c[0] for c in found], type=pa.bool_())
        x = lists([np.array(statistics(c)) for c in found], pa.float64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), *columns, failed, x],
            ["id", "lang", "source", *COUNTS, "base_failed", "x"],
        )

    # a null group is one of its own: every name gets a mark in front, so that neither it nor the pooled one can be a name
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    rows = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"),
        group(lang_col).alias("lang"), group(source_col).alias("source"),
    )
    schema = "id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, x array<double>"
    return map_batches(rows, run, schema)


def small(df: DataFrame) -> DataFrame:
    """A written parameter table, broadcast only while it is small; its rows are groups, not documents."""
    table = stored(df, "groups")
    return F.broadcast(table) if table.count() <= FEW else table


def pooled(rows: DataFrame) -> DataFrame:
    """``rows`` with ``lang, source`` widened to ``*`` where a group is too small to be estimated."""
    n = rows.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    n = rows.select("lang", "source").distinct().join(n, ["lang", "source"], "left").fillna(0, ["n"])
    first = n.withColumn("s", F.when(F.col("n") >= LEAST_GROUP, F.col("source")).otherwise("*"))
    wide = first.groupBy(F.col("lang").alias("l0"), F.col("s").alias("s0")).agg(F.sum("n").alias("m"))
    known = first.join(wide, (F.col("lang") == F.col("l0")) & (F.col("s") == F.col("s0"))).select(
        "lang", "source", F.when(F.col("m") >= LEAST_GROUP, F.concat_ws("\u0001", "lang", "s")).otherwise("*").alias("grp")
    )
    return rows.join(small(known), ["lang", "source"])


def distance(x, centre, inverse):
    """Squared Mahalanobis distance, as one expression over arrays."""
    d = len(STATISTICS)
    off = [F.get(x, F.lit(i)) - F.get(centre, F.lit(i)) for i in range(d)]
    return sum(off[i] * off[j] * F.get(inverse, F.lit(d * i + j)) * F.lit(1.0 if i == j else 2.0) for i in range(d) for j in range(i, d))


def inverted(moments: DataFrame, factor: float) -> DataFrame:
    """``grp, centre, inverse`` from ``grp, n, s (sums), p (products)``, with the least spread added to the scatter."""
    d = len(STATISTICS)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        centres, inverses = [], []
        for n, s, p in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            centre = np.array(s) / n
            scatter = np.zeros((d, d))
            scatter[np.triu_indices(d)] = np.array(p) / n
            scatter = scatter + np.triu(scatter, 1).T - np.outer(centre, centre)
            centres.append(centre)
            inverses.append(np.linalg.inv(factor * scatter + np.diag(np.square(LEAST_SPREAD))).ravel())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), lists(centres, pa.float64()), lists(inverses, pa.float64())], ["grp", "centre", "inverse"]
        )

    return map_batches(moments, run, "grp string, centre array<double>, inverse array<double>")


def consistency(d: int, core: float) -> float:
    """The scatter of a normal cloud in ``d`` dimensions by that of its nearest ``core`` share: core / P(chi2_{d+2} <= q).

    ``q`` is the chi-square quantile of ``d`` at ``core``. Probabilities fall by x^(k/2) e^(-x/2) / 2^(k/2) / Gamma(k/2 + 1) from k to k + 2.
    """
    fall = lambda k, x: math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))

    def below(x: float) -> float:
        first = 2 - d % 2
        start = math.erf(math.sqrt(x / 2)) if first == 1 else 1 - math.exp(-x / 2)
        return start - sum(fall(k, x) for k in range(first, d, 2))

    low, high = 1e-9, 100.0 + 10 * d
    for _ in range(100):
        q = (low + high) / 2
        low, high = (q, high) if below(q) < core else (low, q)
    return core / (core - fall(d, q))


def estimates(rows: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates: ``grp, centre, inverse``.

    The start is the median with quartile spreads; each step measures every row, takes the ``CORE`` share
    that lies nearest in its group and estimates mean and scatter again, which never raises the
    determinant. Groups are never collected: a step is a mergeable quantile and a sum per group, so a
    source with a third of all rows is summed where its rows are.
    """
    d = len(STATISTICS)
    at = [F.get("x", F.lit(i)) for i in range(d)]
    quart = rows.groupBy("grp").agg(*[F.percentile_approx(at[i], [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(d)])
    spread = [((F.get(f"q{i}", F.lit(2)) - F.get(f"q{i}", F.lit(0))) / 1.349) ** 2 + LEAST_SPREAD[i] ** 2 for i in range(d)]
    now = quart.select(
        "grp", F.array(*[F.get(f"q{i}", F.lit(1)) for i in range(d)]).alias("centre"),
        F.array(*[F.lit(1.0) / spread[i] if i == j else F.lit(0.0) for i in range(d) for j in range(d)]).alias("inverse"),
    )
    factor = consistency(d, CORE)
    for _ in range(STEPS):
        near = rows.join(small(now), "grp").select("grp", "x", distance(F.col("x"), F.col("centre"), F.col("inverse")).alias("d2"))
        edge = near.groupBy("grp").agg(F.percentile_approx("d2", CORE, 1000).alias("edge"))
        core = near.join(small(edge), "grp").where("d2 <= edge")
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        moments = core.groupBy("grp").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(at[i]).alias(f"s{i}") for i in range(d)],
            *[F.sum(at[i] * at[j]).alias(f"p{i}{j}") for i, j in pairs],
        )
        moments = moments.select("grp", "n", F.array(*[f"s{i}" for i in range(d)]).alias("s"), F.array(*[f"p{i}{j}" for i, j in pairs]).alias("p"))
        now = inverted(moments, factor)
    return small(now)


def judge(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """``doc_id``, ``COUNTS``, ``base_failed, distance2, kept``: one row per row of ``df``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated three-word windows. Texts that
    pass are measured against their group (language and source); those beyond ``CUT`` are not kept.

    A null text is empty and fails; null languages or sources form a group of their own; groups under
    ``LEAST_GROUP`` passing rows are judged with their language, and if that is small too with all such rows. Repeated
    rows and ids are judged one by one; an empty table gives an empty one; other columns are not read.
    """
    rows = pooled(stored(measured(df, id_col, text_col, lang_col, source_col), "counts"))
    known = estimates(rows.where(~F.col("base_failed")))
    d2 = distance(F.col("x"), F.col("centre"), F.col("inverse"))
    return rows.join(known, "grp", "left").select(
        id_back("id").alias("doc_id"), *COUNTS, "base_failed", d2.alias("distance2"),
        (~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= CUT)).alias("kept"),
    )
