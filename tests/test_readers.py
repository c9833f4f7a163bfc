"""Corpus, judgement and question readers; small helpers of extraction and measurement."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corvane.operators.extract import Route, check_routes, join_pages, remote_extractor
from corvane.operators.measure import counter_delta
from corvane.plans import evaluation as ev
from corvane.schema import ConfigError, ExtractorBackend
from corvane.sources import corpora as R
from corvane.session import cut_lineage
from corvane.sources.connector import FileListing
from corvane.sources.files import discover, read_documents


def test_the_last_line_of_an_id_wins_across_files(spark, tmp_path):
    rows = [{"_id": "a", "title": "T", "text": f"line {k}"} for k in range(300)]
    (tmp_path / "1.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "2.jsonl").write_text("\n".join(json.dumps(r) for r in [{"_id": "a", "text": "last"}, {"_id": "b", "title": " only ", "text": None}]))
    got = {r.doc_id: r.text for r in R.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a": "last", "b": "only"}


def test_judgements_and_maps(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\nq1\td2\t0\n")
    assert [tuple(r) for r in R.read_tsv_qrels(spark, str(tmp_path / "q.tsv")).collect()] == [("q1", "d1", 1)]
    (tmp_path / "q.trec").write_text("q1 0 d1 2\nq1 0 d2 0\nbroken line\n")
    assert [tuple(r) for r in R.read_trec_qrels(spark, str(tmp_path / "q.trec")).collect()] == [("q1", "d1", 2)]
    (tmp_path / "queries.json").write_text('{"q1": "one", "q2": "two"}')
    assert {tuple(r) for r in R.read_query_map(spark, str(tmp_path / "queries.json")).collect()} == {("q1", "one"), ("q2", "two")}
    (tmp_path / "qrels.json").write_text('{"q1": {"d1": 2, "d2": 1}}')
    assert {tuple(r) for r in R.read_qrels_map(spark, str(tmp_path / "qrels.json")).collect()} == {("q1", "d1", 2), ("q1", "d2", 1)}


def test_files_that_cannot_be_read_are_listed(spark, tmp_path):
    (tmp_path / "a b.md").write_text("fine")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    rows = {r.uri.rsplit("/", 1)[1]: (r.text, r.error is None) for r in read_documents(spark, [str(tmp_path)]).collect()}
    assert rows == {"a%20b.md": ("fine", True), "bad.md": (None, False)}
    assert all(r.uri.startswith("file:///") for r in discover(spark, [str(tmp_path)]).collect())


def test_a_flat_folder_is_many_tasks_and_known_files_are_not_read(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"f{k}.md").write_text(f"file {k}")
    (tmp_path / "skip.bin").write_text("no")
    first = discover(spark, [str(tmp_path)])
    assert first.rdd.getNumPartitions() >= 8
    hashes = {r.uri: (r.content_hash, r.size) for r in first.collect()}
    assert len(hashes) == 300 and set(hashes.values()) == {(hashlib.sha256(f"file {k}".encode()).hexdigest(), len(f"file {k}")) for k in range(300)}
    # a known file of the same size and time keeps its hash without being opened, any other is read again
    known = first.withColumn("content_hash", F.lit("as before")).withColumn("size", F.when(F.endswith("uri", F.lit("f7.md")), 99).otherwise(F.col("size")).cast("long"))
    again = {r.uri: r.content_hash for r in discover(spark, [str(tmp_path)], known=cut_lineage(known)).collect()}
    assert {u for u, h in again.items() if h != "as before"} == {u for u in again if u.endswith("/f7.md")} and again[next(u for u in again if u.endswith("/f7.md"))] == hashlib.sha256(b"file 7").hexdigest()
    spark.dataSource.register(FileListing)
    listed = spark.read.format("corvane_files").option("paths", f"{tmp_path},{tmp_path}/f1.md").option("extensions", ".md").option("tasks", "12").load()
    assert listed.rdd.getNumPartitions() == 12 and {r.uri: (r.content_hash, r.size) for r in listed.collect()} == hashes


def test_pages_converters_routes_and_counters(spark):
    pages = spark.createDataFrame([("d", 2, "two"), ("d", 1, "one"), ("e", 1, "x")], "uri string, page int, text string")
    assert {r.uri: r.text for r in join_pages(pages, ["uri"]).collect()} == {"d": "one\n\ntwo", "e": "x"}

    def connect():
        def client(content, uri):
            if uri != "good":
                raise ValueError("no")
            return content.decode().upper()

        return client

    files = spark.createDataFrame([("good", bytearray(b"abc")), ("bad", bytearray(b"x"))], "uri string, content binary")
    got = {r.uri: (r.text, bool(r.error)) for r in remote_extractor(connect)(files).collect()}
    assert got["good"] == ("ABC", False) and got["bad"][1]
    with pytest.raises(ConfigError):
        check_routes([Route("a", None, ExtractorBackend.TEXT)])
    steps = spark.createDataFrame([(5, 9), (9, 2)], "a long, b long").select(counter_delta(F.col("a"), F.col("b"), 10).alias("d"))
    assert [r.d for r in steps.collect()] == [4, 3]


def test_changed_tables_under_one_path_are_other_tables(spark, tmp_path):
    def write(texts):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(1, "x")], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        return ev.once(spark, str(tmp_path), "probe", lambda: spark.read.parquet(f"{tmp_path}/documents.parquet")).count()

    assert (write(["a"]), write(["a", "b"])) == (1, 2)
