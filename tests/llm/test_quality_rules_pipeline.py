import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import common, pii, quality
from corvane.llm.jaccard import near_components
from corvane.llm.queries import rated_model
from corvane.llm.rules import CORE, CUT, STATISTICS, consistency, judge

ROWS = brute.odd_rows()


def base(text):
    t = text or ""
    w = brute.words(t)
    lines = [x for x in t.split("\n") if brute.words(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def grouped_rows():
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    rows = [(d, t, None if k % 3 else "en", "src" if k % 2 else None) for k, (d, t) in enumerate(ROWS)]
    rows += [(1000 + k, prose(80 + k % 90), "en", "hot") for k in range(400)]
    rows += [(2000, " ".join(w + "***" for w in prose(90).split()), "en", "hot"), (2001, prose(90).upper(), "en", "hot"), (2002, "a b c " * 40, "de", "x")]
    return rows


def test_rules(spark):
    rows = grouped_rows()
    got = judge(brute.frame(spark, rows)).collect()
    want = [(r[0], *base(r[1])) for r in rows]
    assert brute.by_key(tuple(r)[:7] for r in got) == brute.by_key(want)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert not kept[2000] and not kept[2001] and not kept[2002] and all(kept[1000 + k] for k in range(400))
    for r in got:
        assert r["kept"] == (not r["base_failed"] and r["distance2"] <= CUT)


@pytest.mark.parametrize("rows", [[], [(1, "few words", "en", "a")], [(1, None, None, None)]])
def test_rules_on_few_rows(spark, rows):
    assert [(r["doc_id"], r["kept"]) for r in judge(brute.frame(spark, rows)).collect()] == [(r[0], False) for r in rows]


def test_scatter_of_a_core_is_made_consistent():
    d = len(STATISTICS)
    for n, core in ((d, CORE), (2, 0.5)):
        x = np.random.default_rng(1).normal(size=(400_000, n))
        far = (x**2).sum(axis=1)
        near = x[far <= np.quantile(far, core)]
        assert np.allclose(consistency(n, core) * near.var(axis=0), 1, atol=0.02)


def test_held_out_accuracy(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    model = quality.fit(docs, quality.grades(labels.where("doc_id % 4 <> 0")), 3)
    out = quality.score(docs, model).join(quality.grades(labels.where("doc_id % 4 = 0")), "doc_id").collect()
    poor = [r["expected_grade"] for r in out if r["grade"] == 0]
    good = [r["expected_grade"] for r in out if r["grade"] == 2]
    above = sum((g > p) + (g == p) / 2 for p in poor for g in good) / (len(poor) * len(good))
    assert above > 0.95
    assert sum(r["tail"][1] >= 0.5 for r in out if r["grade"] == 2) >= 0.95 * len(good)
    assert all(r["tail"][0] >= r["tail"][1] for r in out)


def test_grades_are_ordered_by_one_score():
    rng = np.random.default_rng(1)
    truth = rng.integers(0, 3, 1500)
    rows = []
    for y in truth:  # feature k occurs with grade k; feature 10 + k is noise
        x = {int(y)} if rng.random() < 0.9 else set()
        rows.append(np.array(sorted(x | set((10 + rng.integers(0, 30, 5)).tolist())), dtype=np.int32))
    m = quality.train(rows, truth, 3)
    assert m.weights[0] < m.weights[1] < m.weights[2] and m.thresholds[0] <= m.thresholds[1]
    again = quality.train(rows, truth, 3)
    assert (again.weights == m.weights).all() and np.abs(m.weights[10:40]).max() < 0.5


def test_scores_of_odd_rows(spark):
    df = brute.frame(spark, ROWS)
    model = quality.fit(df, spark.createDataFrame([(1, 2), (1, 0), (99, 1), (None, 1), (9, 7), (5, None)], "doc_id long, grade int"), 3)
    assert len(quality.score(df, model).collect()) == len(ROWS)
    assert quality.keep(df, model, 0.0).count() == len(ROWS) and quality.keep(df, model, 0.0).columns == df.columns
    none = quality.fit(brute.frame(spark, []), spark.createDataFrame([], "doc_id long, grade int"), 3)
    assert not none.weights.any() and quality.score(brute.frame(spark, []), none).collect() == []


def test_pipeline_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = rated_model(spark, sf)
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]

    kept = stage["quality"](spark, docs, sf)
    chance = lambda t: quality.sigmoid(model.weights[quality.features(t.encode())].sum() - model.thresholds[-1])
    rows = [(d, t) for d, t in rows if chance(t) >= corpus_pipeline.KEEP]
    assert brute.by_key((r["doc_id"], r["text"]) for r in kept.collect()) == brute.by_key(rows) and kept.columns == columns

    lines = stage["line_dedup"](spark, kept, sf)
    rows = [(d, t) for d, _, _, t in brute.dedup_lines(rows)]
    assert brute.by_key((r["doc_id"], r["text"]) for r in lines.collect()) == brute.by_key(rows) and lines.columns == columns

    alone = stage["near_copies"](spark, lines, sf)
    stay = {d for d, _, c in brute.near_components(rows) if d == c}
    rows = [(d, t) for d, t in rows if d in stay]
    assert brute.by_key((r["doc_id"], r["text"]) for r in alone.collect()) == brute.by_key(rows) and alone.columns == columns

    clean = stage["personal_data"](spark, alone, sf)
    spans = {r["doc_id"]: r["spans"] for r in pii.report(alone).collect()}
    done = []
    for d, t in rows:
        at = sorted((int(s), int(e), pii.KINDS.index(k)) for k, s, e in (x.split(":") for x in spans[d].split(",") if x))
        assert {x for x in brute.personal(t)[1].split(",") if x} <= set(spans[d].split(","))
        end, out = 0, ""
        for s, e, k in at:
            if s >= end:
                out += t[end:s] + f"[{pii.KINDS[k].upper()}]"
            end = max(end, e)
        done.append((d, out + t[end:]))
    assert brute.by_key((r["doc_id"], r["text"], r["n_chars"]) for r in clean.collect()) == brute.by_key((d, t, len(t)) for d, t in done)
    assert clean.columns == columns

    whole = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in whole} == {d for d, _ in done}
    used = defaultdict(int)
    for r in whole:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024


def test_pipeline_stages_take_odd_and_empty_rows(spark, sf):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for rows in (ROWS, []):
        docs = brute.frame(spark, rows).select(*columns)
        for _, stage in corpus_pipeline.STAGES[1:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == columns and out.count() <= len(rows)
        assert corpus_pipeline.STAGES[0][1](spark, docs, sf).columns == columns
        assert len({r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}) == len({r[0] for r in rows})
    assert len(near_components(brute.frame(spark, ROWS)).collect()) == len(ROWS)


def test_rows_without_an_id_are_one_linked_document(spark):
    words = [f"w{k}" for k in range(300)]
    rows = [(1, " ".join(words)), (None, " ".join([*words[:-1], "other"])), (3, "something else altogether " * 20)]
    docs = brute.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copy_stage(spark, docs, "").collect()) == [1, 3]
    alone = brute.frame(spark, [(1, "one text of its own"), (None, "another")]).select("doc_id", "text", "lang", "source", "n_chars")
    assert corpus_pipeline.near_copy_stage(spark, alone, "").count() == 2


def test_rated_rows_reach_the_driver_as_columns(spark, monkeypatch):
    rows = [(i % 40, i % 3, [i, i + 1, i + 2]) for i in range(60)]
    table = spark.createDataFrame(rows, "id long, grade int, x array<int>")
    expected = {}
    for r in table.orderBy(F.xxhash64("id"), "id", "x").limit(50).collect():
        expected.setdefault(r["id"], (r["grade"], r["x"]))
    monkeypatch.setattr(type(table), "collect", None)  # a Python object per feature
    x, grades = quality.drawn(table, 50)
    assert [(g, r.tolist()) for g, r in zip(grades.tolist(), x, strict=True)] == list(expected.values())
    assert quality.drawn(table.limit(0), 50)[0] == []


def test_rated_rows_stay_out_of_the_driver(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    ratings = quality.grades(spark.read.parquet(f"{sf}/../sf0.01/labels.parquet"))
    rated = ratings.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    table = quality.featured(docs.join(rated, "doc_id").selectExpr("doc_id AS id", "text", "grade"), "grade")
    want = quality.train(*quality.drawn(table, 300), 3)
    monkeypatch.setattr(quality, "drawn", None)
    got = quality.fit(docs, ratings, 3, sample=300)
    assert got.weights.any() and (got.weights == want.weights).all() and got.thresholds.tolist() == want.thresholds.tolist()
    none = quality.fit(docs, ratings.limit(0), 3)
    assert not none.weights.any() and none.thresholds.tolist() == quality.train([], np.empty(0, np.int64), 3).thresholds.tolist()


def test_near_copies_make_one_filter_as_large_as_its_ids_ask_for(spark, monkeypatch):
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join([*words[:-1], f"other{k}"])) for k in range(20)] + [(100, "something else altogether " * 20)]
    docs = brute.frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    made = []
    id_filter = common.id_filter
    counted = lambda ids, column, bits=1 << 26: made.append(bits) or id_filter(ids, column, bits)
    for module in (common, corpus_pipeline):
        monkeypatch.setattr(module, "id_filter", counted, raising=False)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copy_stage(spark, docs, "").collect()) == [0, 100]
    assert len(made) == 4 and max(made) == 1 << 18  # one for each join with texts, one for the stage
