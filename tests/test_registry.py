"""Registered plans against their SQL twins on the smallest tables."""

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

QUICK = (
    "search_topk search_topk_batch dedup_docs_topk search_across rrf_fuse_datasets bm25_search hybrid_search rerank store_search "
    "reconcile_diff reconcile move_detect store_delete_by_source store_swap remember compaction_cadence watch_debounce chunk_whitespace "
    "chunk_overlap chunk_split_oversized mark_headings sanitize_detect sanitize_strip route_extractor scan_squad scan_layout_json embed_placeholder "
    "agg_per_query agg_paired_effects orient agg_ladder agg_rung_ceiling agg_knob_summary agg_spearman agg_query_power agg_chunk_scan agg_axis_status "
    "agg_moved_boundaries agg_span_integrity agg_blind_spot cells_void cells_unscored gate_compare gate_merge claim sample_slice quantile_bins "
    "agg_energy agg_word_recall agg_latency_percentiles"
).split()


@pytest.fixture(scope="module")
def db(sf):
    return connect(sf)


@pytest.mark.parametrize("name", QUICK)
def test_equals_its_sql(spark, sf, db, name):
    df = queries()[name](spark, sf)
    cursor = db.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert compare([tuple(r) for r in df.collect()], df.columns, cursor.fetchall(), columns) is None


def test_entry_and_registry_shape(spark, sf):
    assert entry(spark).columns == ["qid", "doc_id", "score", "rank"]
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 170
