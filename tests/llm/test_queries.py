import brute
import pytest
from compare import compare, connect

from __spark_entry__ import oracle_sql, queries
from corvane.llm.queries import ORACLES, QUERIES

COLUMNS = {
    1: "doc_id n_shingles component_id", 2: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    3: "doc_id n_email n_ip n_card n_phone base_sha256 spans", 5: "doc_id piece start length ids_crc32 sequence_id offset",
    6: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 7: "doc_id n_lines n_dropped kept_sha256",
    8: "doc_id n_words n_removed kept_sha256", 9: "doc_id n_tokens ids_sha256 decoded_sha256",
    10: "doc_id size text_crc32 law shard slot grown_shard", 11: "word form root n n_near form_n",
    12: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", 13: "doc_id n_bytes n_removed n_spans kept_sha256",
}


def test_one_query_per_operator_and_the_pipeline():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_over_whole_documents(spark, sf, name):
    rows = QUERIES[name](spark, sf)
    got = rows.collect()
    if name.startswith("op11_"):
        assert got and len({r["word"] for r in got}) == len(got) and set(COLUMNS[11].split()) == set(rows.columns)
        return
    ids = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in got} == ids and (name.startswith("op5_") or len(got) == len(ids))
    number = int(name[2:].split("_")[0])
    assert set(COLUMNS.get(number, "doc_id").split()) <= set(rows.columns)
    if name in ORACLES:
        cursor = connect(sf).execute(ORACLES[name])
        assert compare([tuple(r) for r in got], rows.columns, cursor.fetchall(), [d[0] for d in cursor.description]) is None


def test_components_of_whole_documents(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op1_ngram_jaccard_join"](spark, sf).collect()]
    assert brute.by_key(got) == brute.by_key(brute.near_components(docs))
