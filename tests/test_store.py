"""The vector table's contract, reconcile, and the watch stream."""

import tempfile
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import ann
from corvane.operators.ann import AnnParams
from corvane.operators.embed import hash_embedder
from corvane.operators.index import forget, index_sources, reconcile, reindex, remember
from corvane.operators.lifecycle import IndexPlan
from corvane.operators.store import FoldPolicy, VectorTable
from corvane.schema import Collection, ConfigError, Dataset, DimensionError, EngineError, StoreError, pick_dataset
from corvane.streaming.changes import watch


def plan():
    return IndexPlan(embedder=hash_embedder(16, "md5"), dim=16, max_tokens=4)


def docs(spark, pairs):
    rows = spark.createDataFrame(pairs, "uri string, text string")
    return rows.select("uri", F.lit("l").alias("label"), F.sha2("text", 256).alias("content_hash"), F.lit(0.0).alias("mtime"), "text")


@pytest.fixture
def store(spark):
    table = VectorTable(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), buckets=4)
    table.ensure(Collection("c", "m", 16))
    return table


def uris(store, name="c"):
    return {r.uri: r.n for r in store.rows(name).groupBy("uri").agg(F.count("*").alias("n")).collect()}


def test_write_replace_delete_and_read(spark, store):
    assert store.count("c") == 0 and store.count("unknown") == 0
    index_sources(store, "c", docs(spark, [("a", "one two three four five"), ("b", "six"), ("e", "  ")]), plan())
    assert uris(store) == {"a": 2, "b": 1}
    assert {r.uri for r in store.sources("c").collect()} == {"a", "b", "e"}  # a source without chunks is known
    index_sources(store, "c", docs(spark, [("a", "short")]), plan())
    assert uris(store) == {"a": 1, "b": 1}
    for _ in range(2):
        forget(store, "c", spark.createDataFrame([("a",), ("nowhere",)], "uri string"))
    assert uris(store) == {"b": 1}
    with pytest.raises(StoreError):
        store.rows("unknown")


def test_pinning_swap_and_search(spark, store):
    with pytest.raises(StoreError):
        store.ensure(Collection("c", "other", 16))
    index_sources(store, "c", docs(spark, [("old", "old words")]), plan())
    store.ensure(Collection("s", "m", 16))
    index_sources(store, "s", docs(spark, [("new", "sun moon"), ("twin", "sun moon")]), plan())
    store.swap("s", "c")
    assert uris(store) == {"new": 1, "twin": 1} and store.names() == ["c"]
    asked = spark.createDataFrame([(1, "moon sun")], "qid long, text string").withColumn("vector", hash_embedder(16, "md5")(F.col("text")))
    hits = store.search("c", asked, 5).orderBy("rank").collect()
    assert [(h.uri, h.chunk_text) for h in hits] == [("new", "sun moon"), ("twin", "sun moon")]
    with pytest.raises(DimensionError):
        store.search("c", asked.withColumn("vector", F.slice("vector", 1, 3)))


def test_reconcile_counts_and_is_idempotent(spark, store):
    index_sources(store, "c", docs(spark, [("same", "x y"), ("edit", "before"), ("gone", "z")]), plan())
    listing = docs(spark, [("same", "x y"), ("edit", "after"), ("fresh", "q"), ("empty", "")])
    first = reconcile(store, "c", listing, plan()).first()
    assert (first.indexed, first.pruned, first.unchanged) == (3, 1, 1)
    assert uris(store) == {"same": 1, "edit": 1, "fresh": 1}
    again = reconcile(store, "c", listing, plan()).first()
    assert (again.indexed, again.pruned, again.unchanged) == (0, 0, 4)
    nothing = reconcile(store, "c", listing.limit(0), plan()).first()
    assert nothing.pruned == 4 and uris(store) == {}


def test_what_cannot_be_read_keeps_its_rows(spark, store):
    index_sources(store, "c", docs(spark, [("kept", "x y"), ("edit", "before"), ("gone", "z")]), plan())
    bad = F.col("uri").isin("edit", "fresh")
    listing = docs(spark, [("kept", "x y"), ("edit", "after it"), ("fresh", "q")])
    listing = listing.withColumn("error", F.when(bad, "broken")).withColumn("text", F.when(~bad, F.col("text")))
    for _ in range(2):
        report = reconcile(store, "c", listing, plan()).first()
        assert (report.indexed, report.unchanged, report.errors) == (0, 1, 2)
        assert uris(store) == {"kept": 1, "edit": 1}
    assert {r.text for r in store.rows("c").where("uri = 'edit'").collect()} == {"before"}


def test_batches_count_per_stream_and_survive_a_swap(spark, store):
    assert store.replace("c", None, None, docs(spark, [("a", "x")]), batch=5, stream="old")
    assert index_sources(store, "c", docs(spark, [("a", "x")]), plan())
    assert store.last_batch("c", "old") == 5 and store.last_batch("c", "new") == -1
    store.ensure(Collection("s", "m", 16))
    assert index_sources(store, "s", docs(spark, [("b", "y")]), plan(), batch=9)
    store.swap("s", "c")
    assert store.last_batch("c") == -1 and store.last_batch("c", "old") == 5
    store.ensure(Collection("s", "m", 16))
    assert store.vacuum("c") == 1 and store.vacuum("s") == 0 and uris(store) == {"b": 1}
    forget(store, "c", spark.createDataFrame([("b",)], "uri string"))  # a later tombstone finds the swapped rows
    assert uris(store) == {}


def files_below(store):
    return {f: f.stat().st_mtime_ns for f in Path(store.root, "data").rglob("*.parquet")}


def test_a_commit_writes_its_own_rows_and_tombstones_only(spark, store):
    index_sources(store, "c", docs(spark, [(f"u{k}", f"word {k}") for k in range(40)]), plan())
    before, view = files_below(store), store.rows("c")
    index_sources(store, "c", docs(spark, [("u7", "other words"), ("new", "x")]), plan())
    forget(store, "c", spark.createDataFrame([("u8",)], "uri string"))
    after = files_below(store)
    assert {f: after[f] for f in before} == before and store.tail("c") == {"commits": 2, "records": 5}
    added = [spark.read.parquet(str(f)) for f in set(after) - set(before)]
    assert sum(t.count() for t in added) == 3 + 2 + 2  # tombstones, rows, sources
    assert len(uris(store)) == 40 and {r.text for r in store.rows("c").where("uri = 'u7'").collect()} == {"other words"}
    assert "u8" not in {r.uri for r in store.sources("c").collect()}
    assert {r.text for r in view.where("uri in ('u7', 'u8')").collect()} == {"word 7", "word 8"}  # an older view reads on
    forget(store, "c", spark.createDataFrame([("u8",), ("nowhere",)], "uri string"))  # nothing to remove, nothing written
    assert store.tail("c")["commits"] == 2 and files_below(store) == after


def test_a_fold_rewrites_the_touched_buckets_and_vacuum_removes_the_rest(spark, store):
    index_sources(store, "c", docs(spark, [(f"u{k}", f"word {k}") for k in range(40)]), plan())
    before = store._need("c")[1]["paths"]["chunks"]
    forget(store, "c", spark.createDataFrame([("u7",)], "uri string"))
    index_sources(store, "c", docs(spark, [("u7", "back again")]), plan())
    rows = sorted(map(tuple, store.rows("c").collect()), key=repr)
    store.compact("c")
    after = store._need("c")[1]["paths"]["chunks"]
    assert sum(before[b] != after[b] for b in before) == 1 and store.tail("c") == {"commits": 0, "records": 0}
    assert sorted(map(tuple, store.rows("c").collect()), key=repr) == rows and len(rows) == 40
    assert store.vacuum("c") == 2 and len(uris(store)) == 40


def test_the_policy_folds_inside_reconcile(spark):
    now = [0.0]
    table = VectorTable(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), 4, fold=FoldPolicy(8, 60.0, 0), clock=lambda: now[0])
    table.ensure(Collection("c", "m", 16))
    texts = {f"u{k}": f"word {k}" for k in range(10)}
    reconcile(table, "c", docs(spark, list(texts.items())), plan())
    for k, commits in ((1, 1), (2, 2), (3, 3), (4, 0)):  # two records each: a row and a tombstone
        texts[f"u{k}"] += " edited"
        reconcile(table, "c", docs(spark, list(texts.items())), plan())
        assert table.tail("c")["commits"] == commits
    now[0] = 61.0
    texts["u9"] += " late"
    reconcile(table, "c", docs(spark, list(texts.items())), plan())
    assert table.tail("c")["commits"] == 0 and {r.uri: r.text for r in table.rows("c").collect()} == texts


def test_the_index_is_built_by_a_fold_and_follows_later_ones(spark):
    rng = np.random.default_rng(5)
    near = [(f"u{k:04d}", (c + 0.3 * rng.normal(size=16)).tolist()) for k, c in enumerate(np.repeat(rng.normal(size=(12, 16)), 60, axis=0))]
    table = VectorTable(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), 4, ann_min_rows=500, ann_cells=12)
    table.ensure(Collection("c", "m", 16))

    def write(pairs):
        rows = spark.createDataFrame(pairs, "uri string, vector array<double>").select(
            "uri", F.lit("l").alias("label"), F.lit("h").alias("content_hash"), F.lit(0.0).alias("mtime"), F.lit(0).alias("ordinal"),
            F.lit(1).alias("token_count"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("summary"), "vector",
        )
        table.replace("c", rows, rows.select("uri", "label", "content_hash", "mtime"))

    asked = spark.createDataFrame([(k, near[k * 30][1]) for k in range(20)], "qid long, vector array<double>")

    def found(params=None):
        return {(r.qid, r["rank"]): (r.uri, r.score) for r in table.search("c", asked, 5, params).collect()}

    write(near[:400])
    table.compact("c")
    assert not table._need("c")[1].get("index")  # too few rows yet
    write(near[400:700])
    table.compact("c")
    assert found(AnnParams(nprobes=12, refine_factor=140)) == found()
    write(near[700:] + [("u0000", [-x for x in near[0][1]])])  # a tail, and a replaced row
    forget(table, "c", spark.createDataFrame([("u0001",)], "uri string"))
    for folded in (False, True):
        exact = found()
        assert not {"u0001"} & {u for u, _ in exact.values()} and exact[0, 1][0] != "u0000"
        assert found(AnnParams(nprobes=12, refine_factor=144)) == exact
        some = found(AnnParams(nprobes=3, refine_factor=5))
        truth = {(q, u) for (q, _), (u, _) in exact.items()}
        assert len(truth & {(q, u) for (q, _), (u, _) in some.items()}) >= 0.9 * len(truth)
        if not folded:
            table.compact("c")
    index = Path(table.root, table._need("c")[1]["index"]["path"], "codes")
    assert spark.read.parquet(str(index)).count() == table.count("c") == 719 and table.vacuum("c") > 0 and found() == exact


def test_remember_and_reindex_mind_their_guards(spark, store):
    notes = spark.createDataFrame([(1, 1, "first"), (1, 2, "second thought"), (2, 1, "other")], "id long, turn int, text string")
    remember(store, Dataset("n", "c", "m", writable=True), notes, plan(), "id", "text", "turn")
    assert {(r.uri, r.text) for r in store.rows("c").collect()} == {("corvane://n/1", "second thought"), ("corvane://n/2", "other")}
    with pytest.raises(EngineError):
        remember(store, Dataset("n", "c", "m"), notes, plan(), "id", "text", "turn")
    with pytest.raises(EngineError):
        reindex(store, Dataset("n", "c", "m", read_only=True), docs(spark, []), plan())


def test_a_replayed_batch_changes_nothing(spark, store):
    assert index_sources(store, "c", docs(spark, [("a", "x")]), plan(), batch=3)
    assert not index_sources(store, "c", docs(spark, [("a", "y"), ("b", "z")]), plan(), batch=3)
    assert uris(store) == {"a": 1} and store.last_batch("c") == 3


def test_two_writers_cannot_publish_one_version(store):
    store._publish("c", 9, {"model_id": "m", "dim": 16, "paths": {"chunks": {}, "sources": {}}, "buckets": 4})
    with pytest.raises(Exception, match="exist"):
        store._publish("c", 9, {"model_id": "m", "dim": 16, "paths": {"chunks": {}, "sources": {}}, "buckets": 4})


def test_guards():
    with pytest.raises(ConfigError):
        Collection("x", "m", 0)
    with pytest.raises(ConfigError):
        Dataset("d", "c", "k", roots=("/r",), writable=True)
    with pytest.raises(EngineError, match="known: d"):
        pick_dataset({"d": Dataset("d", "c", "k")}, "e")
    with pytest.raises(EngineError):
        Dataset("d", "c", "k", read_only=True).check_reindex()
    assert not Dataset("d", "c", "k", roots=("/r",), read_only=True).watched


def test_watch_follows_created_changed_and_deleted_files(spark, store):
    root = Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    (root / "a.md").write_text("alpha beta")
    (root / "b.TXT").write_text("gamma")
    (root / "skip.bin").write_text("no")
    reports = []
    query = watch(
        spark, Dataset("notes", "c", "k", roots=(str(root),)), store, plan(), checkpoint=tempfile.mkdtemp(prefix="run-", dir="/tmp"),
        on_report=lambda batch, report: reports.append(tuple(report.first())),
    )
    try:
        query.processAllAvailable()
        (root / "a.md").write_text("alpha changed")
        (root / "bad.md").write_bytes(b"\xff\xfe")
        query.processAllAvailable()
    finally:
        query.stop()
    assert reports[0] == (2, 0, 0, 0) and reports[-1][1:] == (0, 1, 1)
    assert {u.rsplit("/", 1)[1] for u in uris(store)} == {"a.md", "b.TXT"}


def test_an_index_is_fitted_without_a_row_on_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [(x.tolist(),) for x in np.repeat(rng.normal(size=(12, 16)), 60, axis=0) + 0.1 * rng.normal(size=(720, 16))]
    rows = spark.createDataFrame(vectors, "vector array<double>")
    index = ann.CodeIndex(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    with monkeypatch.context() as held:
        for name in ("collect", "toArrow", "toPandas", "toLocalIterator", "take"):
            held.setattr(type(rows), name, lambda *a, **b: pytest.fail("rows came to the driver"))
        index.train(rows, 16, 12)
    centroids, books = index._fitted()
    assert centroids.shape == (12, 16) and [b.shape for b in books] == [(256, 4)] * 4
    units = np.array([v for (v,) in vectors])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    near = ann._nearest(units, centroids).reshape(12, 60)
    assert sum(len(set(family)) == 1 for family in near.tolist()) >= 8  # most families have a cell of their own, whole


def test_distances_are_held_for_some_points_at_a_time():
    points, book = (np.random.default_rng(k).normal(size=(n, 8)) for k, n in ((1, 6000), (2, 2000)))
    tracemalloc.start()
    near = ann._nearest(points, book)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6  # all at once: 96 MB, twice
    some = slice(5900, 6000)
    assert (near[some] == ((points[some, None] - book) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_cells_are_as_many_as_points_differ():
    points = np.repeat(np.eye(3), 5, axis=0)
    assert sorted(map(tuple, ann.fitted_cells(points, 9))) == sorted(map(tuple, np.eye(3)))
    assert ann.fitted_cells(np.zeros((4, 3)), 2).tolist() == [[0.0] * 3]


def most_rows_on_the_driver(spark, monkeypatch, work):
    """The most rows that any collect of ``work`` brings to the driver."""
    found, kind = [0], type(spark.range(0))
    for name in ("collect", "toArrow", "toPandas"):
        own = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, *a, own=own, **b: found.append(len(got := own(self, *a, **b))) or got)
    work()
    monkeypatch.undo()
    return max(found)


def many(spark, n, word):
    return docs(spark, [(f"u{k}", f"{word} {k} of {k % 7} and {k % 11}") for k in range(n)])


def test_a_fold_brings_no_vectors_to_the_driver(spark, monkeypatch):
    table = VectorTable(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), 4, ann_min_rows=500)
    table.ensure(Collection("c", "m", 16))
    index_sources(table, "c", many(spark, 900, "word"), plan())
    index_sources(table, "c", many(spark, 100, "other"), plan())
    rows = table.count("c")
    assert rows == 1800 and most_rows_on_the_driver(spark, monkeypatch, lambda: table.compact("c")) <= 4 * 256  # books
    index = Path(table.root, table._need("c")[1]["index"]["path"], "codes")
    assert spark.read.parquet(str(index)).count() == table.count("c") == rows


def test_a_fold_inside_reconcile_brings_no_vectors_to_the_driver(spark, monkeypatch):
    table = VectorTable(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"), 4, fold=FoldPolicy(8), ann_min_rows=500)
    table.ensure(Collection("c", "m", 16))
    index_sources(table, "c", many(spark, 900, "word"), plan())
    listing = many(spark, 20, "other").union(many(spark, 900, "word").where("cast(substr(uri, 2) as int) >= 20"))
    assert most_rows_on_the_driver(spark, monkeypatch, lambda: reconcile(table, "c", listing, plan())) <= 4 * 256  # books
    assert table.tail("c") == {"commits": 0, "records": 0} and table._need("c")[1]["index"]
    assert {r.uri for r in table.rows("c").where("text like 'other%'").collect()} == {f"u{k}" for k in range(20)} and table.count("c") == 1800

