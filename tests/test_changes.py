"""Caps that are gone: other corpora, long documents; bursts by time slices; the stored index."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators.ann import IvfIndex
from corvane.operators.fusion import first_distinct_documents
from corvane.operators.sampling import slice_corpus
from corvane.operators.splitters import spans_of
from corvane.operators.topk import exact_topk
from corvane.plans import evaluation as ev
from corvane.plans import search
from corvane.schema import ConfigError
from corvane.streaming.changes import burst_slices, burst_windows


@pytest.fixture(scope="module")
def other_tables(spark, tmp_path_factory):
    """A fifth language, one document without any, one of 400 chunks, and a passage of few words."""
    folder = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    words = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    passage = words(12)
    docs = [(k, f"{words(70)} {passage if k % 3 == 0 else ''} {words(20)}", "it" if k % 2 else "en") for k in range(12)]
    docs += [(50, " ".join([passage] * 2200), "en"), (60, f"before these few words {words(10)}", "pt"), (70, words(80), None)]
    spark.createDataFrame([(d, t, lang, "s", len(t)) for d, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "these few words")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_every_language_is_a_corpus(spark, other_tables):
    assert ev.corpora(spark, other_tables) == ["docs_en", "docs_it", "docs_pt"]
    rels = {(r.qid, r.doc_id): (r.corpus, r.rel) for r in ev.passage_qrels(spark, other_tables).collect()}
    assert rels == {(1, k): ("docs_it" if k % 2 else "docs_en", 2) for k in (0, 3, 6, 9)} | {(1, 50): ("docs_en", 2), (2, 60): ("docs_pt", 2)}


def test_a_document_of_very_many_chunks_takes_one_place(spark, other_tables):
    got = search.dedup_docs_topk(spark, other_tables).where("qid = 1").collect()
    assert len(got) == 10 == len({r.doc_id for r in got}) and sorted(r["rank"] for r in got) == list(range(1, 11))


def test_first_distinct_documents_keep_their_order(spark):
    rows = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 3), ("q", "c", 4)], "qid string, doc_id string, rank int")
    assert [(r.doc_id, r["rank"]) for r in first_distinct_documents(rows, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]


def test_slices_give_the_same_bursts(spark):
    rng = random.Random(4)
    start = datetime(2024, 5, 1)
    rows = [(k, start + timedelta(seconds=rng.expovariate(1 / 900) * 40 * rng.random())) for k in ("a", "b") for _ in range(300)]
    rows += [("a", start), ("a", start), ("c", start + timedelta(hours=5, minutes=59)), ("c", start + timedelta(hours=6, minutes=3)), ("c", start + timedelta(days=3))]
    events = spark.createDataFrame(rows, "k string, ts timestamp")
    whole = burst_windows(events, ["k"], gap="10 minutes").collect()
    sliced = burst_slices(events, ["k"], gap_seconds=600).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, sliced)) and len(whole) > 20


def test_stored_index_finds_what_it_files(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(400)]
    vectors = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    queries = vectors.where("vec_id < 20").withColumnRenamed("vec_id", "qid")
    index = IvfIndex(spark, f"{tmp_path}/ivf").build(vectors, 6)
    exact = {tuple(r) for r in exact_topk(vectors, queries, 5, dim=8, keys=["vec_id"]).select("qid", "vec_id", "rank").collect()}
    again = IvfIndex(spark, f"{tmp_path}/ivf")
    assert {tuple(r) for r in again.search(queries, 5, dim=8, keys=["vec_id"], nprobes=6).select("qid", "vec_id", "rank").collect()} == exact
    few = again.search(queries, 5, dim=8, keys=["vec_id"], nprobes=1).collect()
    assert {(r.qid, r.vec_id) for r in few if r["rank"] == 1} == {(k, k) for k in range(20)}
    with pytest.raises(ConfigError):
        again.search(queries, 5, dim=8, keys=["vec_id"], nprobes=7)


def test_a_slice_is_the_draws_first_documents(spark):
    docs, judged = spark.range(3000).select(F.col("id").alias("doc_id")), spark.range(0, 3000, 100).select(F.col("id").alias("doc_id"))
    got = slice_corpus(docs, judged, 500).collect()
    draw = docs.join(judged, "doc_id", "left_anti").select("doc_id", F.md5(F.concat_ws("|", F.lit("42"), F.col("doc_id").cast("string"))).alias("o"))
    want = [r.doc_id for r in draw.orderBy("o", "doc_id").limit(470).collect()]
    assert {r.doc_id for r in got if not r.judged} == set(want) and sum(r.judged for r in got) == 30
    assert slice_corpus(docs, judged, 10).count() == 30 and slice_corpus(docs, judged, 9000).count() == 3000


def test_markdown_keeps_its_own_cuts_under_overlap():
    text = "\n".join(f"# Part {k}\n" + "some words of prose here. " * 5 + "\nmore words. " * 3 for k in range(6))
    assert spans_of(text, "markdown", 40, 8) != spans_of(text, "fast", 40, 8)
