"""Intervals, agreement, claims and gates."""

import random
from collections import Counter
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions.stats import POISSON_CDF, poisson_matrix, poisson_weights
from corvane.functions.text import within_tolerance
from corvane.operators import metrics as M
from corvane.operators import stats as S
from corvane.operators.claims import Claim, check_file, derive, rowset, select
from corvane.operators.fusion import fuse_datasets
from corvane.operators.gate import paired_verdicts
from corvane.operators.metrics import per_query_metrics
from corvane.schema import ConfigError

VALUES = [0.0, 0.2, 0.4, 0.4, 1.0, 0.9, 0.1]


def test_bootstrap_is_close_to_the_percentile_bootstrap(spark):
    rows = spark.createDataFrame([("a", f"q{i}", v) for i, v in enumerate(VALUES)] + [("one", "q0", 0.5)], "cell string, qid string, value double")
    got = {r.cell: r for r in S.mean_interval(rows, ["cell"]).collect()}
    rng, x = np.random.default_rng(1), np.array(VALUES)
    means = np.concatenate([x[rng.integers(0, len(x), size=(min(256, 10_000 - s), len(x)))].mean(axis=1) for s in range(0, 10_000, 256)])
    lo, hi = np.percentile(means, [2.5, 97.5])
    assert got["a"].ci_lo == pytest.approx(lo, abs=0.06) and got["a"].ci_hi == pytest.approx(hi, abs=0.06)
    w = np.stack([poisson_weights(f"q{i}", S.RESAMPLES) for i in range(len(VALUES))])
    total, weighted = w.sum(axis=0), x @ w
    brute = np.percentile(np.round(weighted[total > 0] / total[total > 0], 12), [2.5, 97.5])
    assert [got["a"].ci_lo, got["a"].ci_hi] == pytest.approx(list(brute))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03
    assert got["a"].sd == pytest.approx(np.std(VALUES, ddof=1)) and (got["one"].ci_lo, got["one"].ci_hi, got["one"].sd) == (0.5, 0.5, 0.0)


def test_slices_of_a_group_add_up(spark, monkeypatch):
    rows = spark.range(4000).select(F.lit("a").alias("cell"), F.col("id").alias("qid"), (F.rand(1)).alias("value")).persist()
    whole = S.bootstrap(rows, ["cell"]).first()
    monkeypatch.setattr(S, "SLICE", 500)
    additive = S.bootstrap(rows, ["cell"]).first()
    assert [additive.ci_lo, additive.ci_hi] == pytest.approx([whole.ci_lo, whole.ci_hi], abs=1e-9)
    mean, sd = rows.agg(F.avg("value"), F.stddev("value")).first()
    assert additive.ci_lo == pytest.approx(mean - 1.96 * sd / 4000**0.5, abs=0.004)
    assert additive.ci_hi == pytest.approx(mean + 1.96 * sd / 4000**0.5, abs=0.004)


def test_weights_of_a_unit_are_drawn_once_for_all_its_groups(monkeypatch):
    drawn = []
    monkeypatch.setattr(S, "poisson_matrix", lambda units, n: drawn.extend(units) or poisson_matrix(units, n))
    rows = [(g, str(u), float(u % (g + 2))) for u in range(600) for g in range(9)]
    columns = {"g": [r[0] for r in rows], "_u": [r[1] for r in rows], "_x": [r[2] for r in rows]}
    got = pa.Table.from_batches(S.weighted_sums(pa.table(columns).to_batches(), ["g"], 64)).sort_by("g")
    assert drawn == [str(u) for u in range(600)]
    w = poisson_matrix(drawn, 64).astype(float)
    for g, total, weighted in zip(*(c.to_pylist() for c in got.columns), strict=True):
        assert total == w.sum(axis=0).tolist() and weighted == (np.array([u % (g + 2) for u in range(600)]) @ w).tolist()


def test_weights_are_those_of_md5():
    units = ["", "0", "17", "ä" * 9, "x" * 50, "y" * 51, "z" * 90]
    for some in (units[:3], units[:5], units):
        for unit, found in zip(some, poisson_matrix(some, 9000), strict=True):
            raw = b"".join(md5(f"{unit}|{k}".encode()).digest() for k in range(9000 // 8))
            u = np.frombuffer(raw, dtype=">u2") / 65536.0
            assert (found == np.searchsorted(np.array(POISSON_CDF), u, side="right")).all()


def test_spearman_ties_and_constants(spark):
    rows = [("c", 1.0, 1.0, 5.0), ("c", 2.0, 4.0, 5.0), ("c", 2.0, 3.0, 5.0), ("c", 9.0, 9.0, 5.0)]
    got = S.spearman(spark.createDataFrame(rows, "k string, a double, b double, z double"), ["k"], ["a", "b", "z"])
    rho = {(r.left, r.right): r.rho for r in got.collect()}
    assert rho[("a", "b")] == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [1, 3, 2, 4])[0, 1]) and rho[("a", "z")] == 0.0
    views = S.effective_views(got, ["k"], ["a", "b", "z"]).first().views
    r = rho[("a", "b")]
    assert views == pytest.approx(9 / ((1 + r) ** 2 + (1 - r) ** 2 + 1))


def points():
    rng = random.Random(8)
    return [(g, round(rng.random(), 1 + g % 2), rng.randrange(25) / 10) for g in range(3) for _ in range(150 - 60 * g)] + [(9, 1.0, 1.0)] * 3


def test_disagreements_are_inversions(spark):
    want = {}
    for g, x, y in points():
        for h, u, v in points():
            if g == h and x > u and y != v:
                pairs, wrong = want.get(g, (0, 0))
                want[g] = (pairs + 1, wrong + (y < v))
    cells = spark.createDataFrame([(*p, str(i)) for i, p in enumerate(points())], "g int, a double, b double, cell string").repartition(7)
    assert {r.g: (r.pairs, r.disagreements) for r in S.pair_disagreement(cells, ["g"], "a", "b", "cell").collect()} == want
    rng = np.random.default_rng(1)
    x, y, n = rng.integers(0, 9, 60), rng.integers(0, 9, 60), rng.integers(1, 4, 60)
    assert S.inversions(x, y, n) == sum(n[i] * n[j] for i in range(60) for j in range(60) if x[i] < x[j] and y[i] > y[j])


def test_ranks_and_order_statistics_over_ranges(spark):
    rows = points()
    df = spark.createDataFrame(rows, "g int, a double, b double").repartition(5)
    sums = {(r.g, r.a): r.s for r in S.prefix_sums(df.groupBy("g", "a").agg(F.count("*").alias("n")), ["g"], "a", "n", "s").collect()}
    assert sums == {(g, a): sum(h == g and u < a for h, u, _ in rows) for g, a, _ in rows}
    got = {r.g: (r.low, r.high, r.mid) for r in S.order_statistics(df, ["g"], "b", {"low": ("floor", 0.25), "high": ("round", 0.9), "mid": ("middle", 0.5)}).collect()}
    for g in {r[0] for r in rows}:
        b = sorted(r[2] for r in rows if r[0] == g)
        assert got[g] == (b[min(int(0.25 * len(b)), len(b) - 1)], b[round(0.9 * (len(b) - 1))], b[len(b) // 2])


def test_query_without_hits_counts_as_zero_and_ideal_covers_all_judged(spark):
    ranking = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3)], "qid string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "b", 2), ("q", "c", 1), ("r", "a", 1)], "qid string, doc_id string, rel int")
    queries = spark.createDataFrame([("q",), ("r",), ("none",)], "qid string")
    got = {r.qid: r for r in per_query_metrics(ranking, qrels, queries, 10).collect()}
    assert got["q"].ndcg == pytest.approx((2 / 2) / (2 + 1 / np.log2(3)), abs=1e-8) and got["q"].recall == 0.5 and got["q"].mrr == pytest.approx(1 / 3, abs=1e-8)
    assert got["r"].ndcg == got["none"].recall == got["none"].p1 == 0.0


def test_fusion_first_list_wins_equal_contributions(spark):
    hits = spark.createDataFrame(
        [("q", "d1", 0, 1, "u", 0), ("q", "d2", 1, 1, "u", 0), ("q", "d2", 1, 2, "v", 0)], "qid string, dataset string, list_pos int, rank int, uri string, ordinal int"
    )
    rows = fuse_datasets(hits, 5).orderBy("rank").collect()
    assert [(r.uri, r.dataset) for r in rows] == [("u", "d1"), ("v", "d2")] and rows[0].rrf_score == pytest.approx(2 / 61)


def test_claims_filter_reduce_and_refuse(spark):
    rows = spark.createDataFrame([("a", "a+r", 2.0, ["x", "y"]), ("b", "c", 3.0, ["z"]), (None, "d", 5.0, ["x"])], "k string, n string, v double, levels array<string>")
    sets = {"ab": ["a", "b"]}
    assert select(rows, {"k": "@ab"}, sets).count() == 2 and select(rows, {"levels": "x"}).count() == 2
    assert select(rows, {"n": {"field": "k", "suffix": "+r"}}).count() == 1
    claims = [Claim("n", "count", {"levels": "x"}, published="two"), Claim("s", "mean", {"k": "@ab"}, "v", published="2.4"), Claim("r", "ratio", {"k": "b"}, "v", {"k": "a"}, published="1.5")]
    got = {r.id: (r.derived, r.ok) for r in derive(rows, claims, sets).collect()}
    assert got["r"] == (1.5, True) and got["s"] == (2.5, False)
    for bad in ({"typo": 1}, {"k": "@missing"}, {"k": {"prefix": "x"}}):
        with pytest.raises(ConfigError):
            select(rows, bad)
    with pytest.raises(Exception, match="exactly one row"):
        derive(rows, [Claim("v", "value", {}, "v")]).collect()
    with pytest.raises(Exception, match="no rows"):
        derive(rows, [Claim("v", "max", {"k": "zz"}, "v")]).collect()
    doc = spark.createDataFrame([('{"rows": [{"v": 1}, {"v": 2}], "one": {"v": 7}}',)], "d string")
    assert [len(doc.select(rowset(F.col("d"), p, "array<struct<v:int>>").alias("r")).first().r) for p in ("rows", "one")] == [2, 1]


def test_claim_files_refuse_what_they_do_not_know(spark, tmp_path):
    (tmp_path / "raw.json").write_text('{"rows": [{"k": "a", "v": 2}, {"k": "b", "v": 3}], "facts": {"mean": 2.5}, "bare": [1, 2]}')
    good = {"rowsets": {"r": {"source": "raw.json", "path": "rows"}, "f": {"source": "raw.json", "path": "facts"}},
            "claim": [{"id": "x", "rows": "r", "reduce": "mean", "field": "v", "published": "2.5"},
                      {"id": "y", "rows": "f", "reduce": "difference", "field": "mean", "against_rows": "r", "against": {"k": "a"}, "against_field": "v", "published": "0.5"}]}
    assert {(r.rows, r.id, r.derived, r.ok) for r in check_file(spark, good, str(tmp_path)).collect()} == {("r", "x", 2.5, True), ("f", "y", 0.5, True)}
    claim = good["claim"][0]
    for bad in (
        good | {"more": 1}, good | {"claim": [claim | {"typo": 1}]}, good | {"claim": [claim | {"rows": "none"}]}, good | {"claim": [{"id": "x"}]}, good | {"claim": []},
        good | {"rowsets": {"r": {"path": "rows"}}}, good | {"rowsets": {"r": {"source": "raw.json", "path": "bare"}, "f": {"source": "raw.json"}}},
        good | {"claim": [claim | {"against_rows": "f"}]}, good | {"claim": [claim | {"reduce": "median"}]},
    ):
        with pytest.raises(ConfigError):
            check_file(spark, bad, str(tmp_path))


def test_printed_figures_keep_their_own_precision(spark):
    df = spark.createDataFrame([(82.34999999999999, "82.4"), (82.44, "82.3"), (12298.2, "12,298"), (9.0, "nine"), (0.01432, "+0.0143")], "d double, p string")
    assert [r[0] for r in df.select(within_tolerance(F.col("d"), F.col("p"))).collect()] == [True, False, True, True, True]


def test_gate_needs_a_mean_drop_and_more_losers(spark):
    def run(values):
        return spark.createDataFrame([("c", "ndcg", f"q{i}", v) for i, v in enumerate(values)], "combo string, metric string, qid string, value double")

    base = [0.5, 0.5, 0.5, 0.5]
    assert paired_verdicts(run(base), run([0.4, 0.4, 0.5, 0.5])).first().regressed
    assert not paired_verdicts(run(base), run([0.1, 0.51, 0.51, 0.5])).first().regressed  # one query carried the drop
    assert not paired_verdicts(run(base), run([0.499, 0.499, 0.5, 0.5])).first().regressed


def test_words_of_few_texts_are_counted_at_a_time(monkeypatch):
    rng, taken = random.Random(3), []
    left = [None if rng.random() < 0.1 else rng.choices([*"abcde", None], k=rng.randrange(30)) for _ in range(300)]
    right = [None if rng.random() < 0.1 else rng.choices("abcdef", k=rng.randrange(30)) for _ in range(300)]
    unique = np.unique
    monkeypatch.setattr(M, "COUNTED", 70)
    monkeypatch.setattr(M.np, "unique", lambda x, **options: taken.append(len(x)) or unique(x, **options))
    got = M.counted_overlap(*(pa.array(x, pa.list_(pa.string())) for x in (left, right)))
    assert got.tolist() == [(Counter(a or ()) & Counter(b or ())).total() for a, b in zip(left, right, strict=True)]
    assert len(taken) > 200 and max(a + b for a, b in zip(taken[::2], taken[1::2], strict=True)) <= 70


def test_recall_keeps_no_rows_waiting_and_sends_no_equal_sides(spark):
    rows = [(1, ["a", "b", "a"], ["a", "c"]), (2, ["a"], ["a"]), (3, [], ["x"]), (4, ["a"], None), (5, None, ["a"]), (6, ["a", "a"], ["a", "a", "a"])]
    found = M.word_recall(spark.createDataFrame(rows, "id int, a array<string>, b array<string>"), "id", "a", "b")
    assert {r.id: r.word_recall for r in found.collect()} == {1: pytest.approx(1 / 3), 2: 1.0, 3: 1.0, 4: 0.0, 5: 1.0, 6: 1.0}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan  # the former holds every row of a batch until its count is back
