"""Store, incremental and streaming plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.text import doc_uri
from corvane.operators.ann import AnnParams, resolve_params
from corvane.operators.datasets import SearchTarget, search_across
from corvane.operators.embed import hash_embedder
from corvane.operators.index import forget, index_sources, reconcile, remember
from corvane.operators.lifecycle import IndexPlan, compaction_due, move_detect, moves_by_content, reconcile_diff, reconcile_report
from corvane.operators.store import VectorTable
from corvane.plans import search, sql
from corvane.plans import tables as t
from corvane.plans.hygiene import scratch
from corvane.plans.registry import query
from corvane.schema import Collection, Dataset
from corvane.streaming.changes import burst_slices, fold_points, last_known

L = "long"
PLAN = IndexPlan(embedder=None, dim=t.DIM, max_tokens=t.CAP)


def _plan(dim: int = t.DIM) -> IndexPlan:
    return IndexPlan(embedder=hash_embedder(dim, "md5"), dim=dim, max_tokens=t.CAP)


def earlier_listing(spark, sf):
    """The documents as an earlier run saw them.

    Documents judged good are as they are; those judged bad held other text; toxic ones lay under
    another URI; unjudged ones did not exist yet. The web pages were indexed then and are gone.
    """
    docs = t.documents(spark, sf).join(t.table(spark, sf, "labels"), "doc_id")
    text = F.when(F.col("quality") == 0, F.concat(F.lit("earlier "), "text")).otherwise(F.col("text"))
    old = docs.select(
        F.when(F.col("toxic") == 1, F.concat(F.lit("doc://old/"), F.col("doc_id").cast("string"))).otherwise(doc_uri(F.col("doc_id"))).alias("uri"),
        F.col("source").alias("label"), text.alias("text"),
    )
    pages = t.table(spark, sf, "pages").select(
        doc_uri(F.col("page_id"), "page").alias("uri"), F.lit("pages").alias("label"), F.col("url").alias("text")
    )
    return old.unionByName(pages).select("uri", "label", F.sha2("text", 256).alias("content_hash"), F.lit(0.0).alias("mtime"), "text")


DIFF_SQL = """cur AS (SELECT 'doc://' || doc_id AS uri, sha256(text) AS h FROM documents),
    old AS (SELECT CASE WHEN toxic = 1 THEN 'doc://old/' || doc_id ELSE 'doc://' || doc_id END AS uri,
                   sha256(CASE WHEN quality = 0 THEN 'earlier ' || text ELSE text END) AS h FROM documents JOIN labels USING (doc_id)
            UNION ALL SELECT 'page://' || page_id, sha256(url) FROM pages),
    diff AS (SELECT uri, coalesce(cur.h, old.h) AS content_hash, CASE WHEN cur.h IS NULL THEN 'vanished' WHEN old.h IS NULL THEN 'new'
                    WHEN cur.h = old.h THEN 'unchanged' ELSE 'changed' END AS status FROM cur FULL JOIN old USING (uri))"""


@query("reconcile_diff", f"WITH {DIFF_SQL} SELECT uri, content_hash, status FROM diff")
def reconcile_diff_plan(spark, sf):
    return reconcile_diff(t.listing(spark, sf), earlier_listing(spark, sf))


@query("move_detect", f"""WITH {DIFF_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY content_hash, status ORDER BY uri) AS nth FROM diff WHERE status IN ('vanished', 'new'))
    SELECT o.content_hash, o.uri AS old_uri, n.uri AS new_uri FROM r o JOIN r n USING (content_hash, nth) WHERE o.status = 'vanished' AND n.status = 'new'""")
def move_detect_plan(spark, sf):
    return move_detect(reconcile_diff(t.listing(spark, sf), earlier_listing(spark, sf)))


@query("moves_by_content", f"""WITH {DIFF_SQL}
    SELECT content_hash, min(uri) FILTER (status = 'vanished') AS old_uri, min(uri) FILTER (status = 'new') AS new_uri,
           count(*) FILTER (status = 'vanished')::BIGINT AS n_old, count(*) FILTER (status = 'new')::BIGINT AS n_new
    FROM diff WHERE status IN ('vanished', 'new') GROUP BY content_hash HAVING n_old > 0 AND n_new > 0""")
def moves_by_content_plan(spark, sf):
    return moves_by_content(reconcile_diff(t.listing(spark, sf), earlier_listing(spark, sf)))


def built(spark, sf, docs) -> VectorTable:
    store = VectorTable(spark, scratch(spark, "store"), buckets=8)
    store.ensure(Collection("docs", "hash-md5", t.DIM))
    index_sources(store, "docs", docs, _plan())
    return store


PER_SOURCE_SQL = f"""WITH {sql.chunk_cte()} SELECT source AS label, count(*)::BIGINT AS chunks, sum(len(toks))::BIGINT AS tokens FROM chunks"""


def _per_label(rows):
    return rows.groupBy("label").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


@query("index_sources", f"{PER_SOURCE_SQL} GROUP BY source")
def index_sources_plan(spark, sf):
    return _per_label(built(spark, sf, t.listing(spark, sf)).rows("docs"))


UNREADABLE = "src13"  # the source whose documents cannot be read at the second run


@query("reconcile", f"""WITH {DIFF_SQL}, bad AS (SELECT 'doc://' || doc_id AS uri FROM documents WHERE source = '{UNREADABLE}'),
    st AS (SELECT CASE WHEN status IN ('new', 'changed') AND uri IN (SELECT uri FROM bad) THEN 'failed' ELSE status END AS status FROM diff),
    final AS (SELECT doc_id, source, text FROM documents WHERE source <> '{UNREADABLE}'
              UNION ALL SELECT doc_id, source, CASE WHEN quality = 0 THEN 'earlier ' || text ELSE text END FROM documents JOIN labels USING (doc_id) WHERE source = '{UNREADABLE}' AND toxic = 0),
    {sql.chunk_cte(src='final', cols='doc_id, source')}
    SELECT (SELECT count(*) FROM st WHERE status IN ('new', 'changed'))::BIGINT AS indexed, (SELECT count(*) FROM st WHERE status = 'vanished')::BIGINT AS pruned,
           (SELECT count(*) FROM st WHERE status = 'unchanged')::BIGINT AS unchanged, (SELECT count(*) FROM st WHERE status = 'failed')::BIGINT AS errors,
           source AS label, count(*)::BIGINT AS chunks, sum(len(toks))::BIGINT AS tokens
    FROM chunks GROUP BY source""")
def reconcile_plan(spark, sf):
    """The earlier index brought up to date; what cannot be read keeps its earlier rows."""
    store = built(spark, sf, earlier_listing(spark, sf))
    bad = F.col("label") == UNREADABLE
    listing = t.listing(spark, sf).withColumn("error", F.when(bad, F.lit("not readable"))).withColumn("text", F.when(~bad, F.col("text")))
    report = reconcile(store, "docs", listing, _plan())
    rows = _per_label(store.rows("docs"))
    return rows.select(*[report.select(c).scalar().alias(c) for c in ("indexed", "pruned", "unchanged", "errors")], "label", "chunks", "tokens")


@query("reconcile_report", f"""WITH {DIFF_SQL} SELECT count(*) FILTER (status IN ('new', 'changed'))::BIGINT AS indexed,
    count(*) FILTER (status = 'vanished')::BIGINT AS pruned, count(*) FILTER (status = 'unchanged')::BIGINT AS unchanged, 0::BIGINT AS errors FROM diff""")
def reconcile_report_plan(spark, sf):
    return reconcile_report(reconcile_diff(t.listing(spark, sf), earlier_listing(spark, sf)))


@query("store_upsert", f"{PER_SOURCE_SQL} GROUP BY source UNION ALL SELECT 'pages', count(*)::BIGINT, sum(len({sql.toks('url')}))::BIGINT FROM pages")
def store_upsert(spark, sf):
    """Two appends: the documents, then the pages; the first commit's buckets keep their rows."""
    store = built(spark, sf, t.listing(spark, sf))
    pages = earlier_listing(spark, sf).where("label = 'pages'")
    index_sources(store, "docs", pages, _plan())
    return _per_label(store.rows("docs"))


TOXIC_SQL = "doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"


def _toxic(spark, sf):
    return t.table(spark, sf, "labels").where("toxic = 1").select(doc_uri(F.col("doc_id")).alias("uri"))


@query("store_delete_by_source", f"{PER_SOURCE_SQL} WHERE NOT {TOXIC_SQL} GROUP BY source")
def store_delete_by_source(spark, sf):
    store = built(spark, sf, t.listing(spark, sf))
    store.delete("docs", _toxic(spark, sf))
    return _per_label(store.rows("docs"))


@query("forget", f"{PER_SOURCE_SQL} WHERE NOT {TOXIC_SQL} GROUP BY source")
def forget_plan(spark, sf):
    """Forgetting twice is forgetting once: the second call finds nothing and writes nothing."""
    store = built(spark, sf, t.listing(spark, sf))
    forget(store, "docs", _toxic(spark, sf))
    forget(store, "docs", _toxic(spark, sf))
    return _per_label(store.rows("docs"))


@query("store_swap", f"{PER_SOURCE_SQL} GROUP BY source")
def store_swap(spark, sf):
    """Blue-green: the current listing is staged beside a live collection of the earlier one."""
    store = built(spark, sf, earlier_listing(spark, sf))
    store.ensure(Collection("staging", "hash-md5", t.DIM))
    index_sources(store, "staging", t.listing(spark, sf), _plan())
    store.swap("staging", "docs")
    return _per_label(store.rows("docs"))


@query("store_compact", f"{PER_SOURCE_SQL} GROUP BY source")
def store_compact(spark, sf):
    """The earlier listing brought up to date in two commits, and their deltas folded into the buckets they touch."""
    store = built(spark, sf, earlier_listing(spark, sf))
    listing = t.listing(spark, sf)
    index_sources(store, "docs", listing, _plan())
    store.delete("docs", store.sources("docs").join(listing, "uri", "left_anti").select("uri"))
    store.compact("docs")
    return _per_label(store.rows("docs"))


@query("store_source_hashes", "SELECT 'doc://' || doc_id AS uri, sha256(text) AS content_hash FROM documents")
def store_source_hashes(spark, sf):
    return built(spark, sf, t.listing(spark, sf)).source_hashes("docs")


@query("store_count", f"WITH {sql.chunk_cte()} SELECT 'docs' AS name, count(*)::BIGINT AS chunks, count(DISTINCT doc_id)::BIGINT AS sources FROM chunks")
def store_count(spark, sf):
    rows = built(spark, sf, t.listing(spark, sf)).rows("docs")
    return rows.agg(F.lit("docs").alias("name"), F.count("*").alias("chunks"), F.count_distinct("uri").alias("sources"))


@query("store_collections", f"""WITH {sql.chunk_cte(src='documents', cols='doc_id, lang')}
    SELECT 'docs_' || lang AS name, 'hash-md5' AS model_id, 64::INT AS dim, count(*)::BIGINT AS chunks FROM chunks WHERE lang IS NOT NULL GROUP BY lang""")
def store_collections(spark, sf):
    """One collection per language, listed from the catalogue with its row count."""
    store = VectorTable(spark, scratch(spark, "store"), buckets=4)
    docs = t.listing(spark, sf).join(
        t.documents(spark, sf).select(doc_uri(F.col("doc_id")).alias("uri"), "lang"), "uri"
    )
    for lang in [r["lang"] for r in docs.select("lang").where("lang IS NOT NULL").distinct().collect()]:
        store.ensure(Collection(f"docs_{lang}", "hash-md5", t.DIM))
        index_sources(store, f"docs_{lang}", docs.where(F.col("lang") == lang).drop("lang"), _plan())
    counts = None
    for name in store.names():
        one = store.rows(name).agg(F.lit(name).alias("name"), F.count("*").alias("chunks"))
        counts = one if counts is None else counts.unionByName(one)
    return store.collections().join(counts, "name")


@query("store_search", f"""WITH {sql.dense_scores_cte()},
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, 'doc://' || doc_id, ordinal) AS rank FROM scored)
    SELECT qid, rank::BIGINT AS rank, 'doc://' || r.doc_id AS uri, r.ordinal::BIGINT AS ordinal, score, c.source AS label, md5(array_to_string(c.toks, ' ')) AS chunk_md5, 'docs' AS collection
    FROM r JOIN chunks c ON c.doc_id = r.doc_id AND c.ordinal = r.ordinal WHERE rank <= 5""")
def store_search(spark, sf):
    """The stored collection searched with every passage; hits carry their payload."""
    hits = built(spark, sf, t.listing(spark, sf)).search("docs", t.passages(spark, sf), 5)
    return hits.select(
        "qid", F.col("rank").cast(L).alias("rank"), "uri", F.col("ordinal").cast(L).alias("ordinal"), "score", "label",
        F.md5("chunk_text").alias("chunk_md5"), "collection",
    )


@query("store_search_ann", f"""WITH {sql.dense_scores_cte()},
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id % 5 <> 0, 'doc://' || doc_id, ordinal) AS rank FROM scored)
    SELECT qid, rank::BIGINT AS rank, 'doc://' || r.doc_id AS uri, r.ordinal::BIGINT AS ordinal, score FROM r WHERE rank <= 5""")
def store_search_ann(spark, sf):
    """The index that a fold has built, every cell probed, with exact re-ranking: a fifth of the sources is folded, the
    others came later and are the tail, so both ways are asked and must give the exact ranking."""
    store = _with_index(spark, sf)
    hits = store.search("docs", t.passages(spark, sf), 5, AnnParams(nprobes=16, refine_factor=60))
    return hits.select("qid", F.col("rank").cast(L).alias("rank"), "uri", F.col("ordinal").cast(L).alias("ordinal"), "score")


def _with_index(spark, sf, tail: bool = True) -> VectorTable:
    store = VectorTable(spark, scratch(spark, "store"), buckets=8, ann_min_rows=100, ann_cells=16)
    store.ensure(Collection("docs", "hash-md5", t.DIM))
    first = F.regexp_extract("uri", r"(\d+)$", 1).cast("long") % 5 == 0
    listing = t.listing(spark, sf)
    index_sources(store, "docs", listing.where(first), _plan())
    if not tail:
        index_sources(store, "docs", listing.where(~first), _plan())
    store.compact("docs")
    if tail:
        index_sources(store, "docs", listing.where(~first), _plan())
    return store


@query("store_ann_recall")
def store_ann_recall(spark, sf):
    """How much of the exact top ten the stored index keeps under each preset's knobs, every row indexed: one cell alone for
    comparison, and all cells with the widest re-ranking."""
    store = _with_index(spark, sf, tail=False)
    asked = t.passages(spark, sf)
    exact = store.search("docs", asked, 10).select("qid", "uri", "ordinal")
    out = None
    presets = {level: resolve_params("lancedb", level) for level in ("fast", "balanced", "accurate")}
    for level, params in {"one cell": AnnParams(nprobes=1), **presets, "all cells": AnnParams(nprobes=16, refine_factor=60)}.items():
        found = store.search("docs", asked, 10, params).select("qid", "uri", "ordinal", F.lit(1).alias("hit"))
        one = exact.join(found, ["qid", "uri", "ordinal"], "left").agg(F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
        one = one.select(F.lit(level).alias("preset"), F.lit(params.nprobes).alias("nprobes"), F.lit(params.refine_factor or 1).alias("refine_factor"), "recall")
        out = one if out is None else out.unionByName(one)
    return out


_STRING_RANK = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, 'doc://' || doc_id, ordinal)"


@query("search_across_stored", f"""WITH {search.two_width_sql(None)},
    hh AS (SELECT qid, 'docs' AS dataset, 0 AS list_pos, doc_id, ordinal, score, {_STRING_RANK} AS rank FROM s64
           UNION ALL SELECT qid, 'romance', 1, doc_id, ordinal, score, {_STRING_RANK} FROM s16 JOIN documents USING (doc_id) WHERE lang IN ('fr', 'es')),
    f AS (SELECT qid, 'doc://' || doc_id AS uri, ordinal, round(sum(1.0 / (60 + rank)), 12) AS rrf, min_by(dataset, (rank, list_pos)) AS dataset,
                 min_by(score, (rank, list_pos)) AS score FROM hh WHERE rank <= 5 GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, uri, ordinal) AS rank FROM f)
    SELECT qid, rank::BIGINT AS rank, dataset, uri, ordinal::BIGINT AS ordinal, score, round(rrf, 9) AS rrf_score FROM o WHERE rank <= 5""")
def search_across_stored(spark, sf):
    """Two stored collections of different width: all documents at 64, the French and Spanish ones at 16 besides."""
    store = built(spark, sf, t.listing(spark, sf))
    store.ensure(Collection("romance", "hash-16", 16))
    some = t.documents(spark, sf).where("lang IN ('fr', 'es')").select(doc_uri(F.col("doc_id")).alias("uri"))
    index_sources(store, "romance", t.listing(spark, sf).join(some, "uri", "left_semi"), _plan(16))
    targets = [
        SearchTarget(name, f"hash-{dim}", hash_embedder(dim, "md5"), store, name) for name, dim in (("docs", t.DIM), ("romance", 16))
    ]
    asked = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return search_across(targets, asked, 5).select(
        "qid", F.col("rank").cast(L).alias("rank"), "dataset", "uri", F.col("ordinal").cast(L).alias("ordinal"), "score",
        F.round("rrf_score", 9).alias("rrf_score"),
    )


@query("remember", f"""WITH n AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
    SELECT 'corvane://notes/' || conv_id AS uri, 'notes' AS label, sha256(text) AS content_hash, len({sql.toks('text')})::BIGINT AS tokens FROM n WHERE k = 1""")
def remember_plan(spark, sf):
    """Every turn is a write under its conversation's id; the last one stands in the stored collection."""
    store = VectorTable(spark, scratch(spark, "store"), buckets=4)
    store.ensure(Collection("notes", "hash-md5", t.DIM))
    notes = Dataset("notes", "notes", "hash-md5", writable=True)
    remember(store, notes, t.table(spark, sf, "conversations"), _plan(), "conv_id", "text", "turn")
    chars = store.rows("notes").groupBy("uri").agg(F.sum("token_count").alias("tokens"))
    return store.sources("notes").join(chars, "uri").select("uri", "label", "content_hash", F.col("tokens").cast(L).alias("tokens"))


@query("compaction_due", """WITH s AS (SELECT user_id, count(*) AS records, epoch(max(ts)) - epoch(min(ts)) AS seconds FROM events GROUP BY user_id)
    SELECT user_id, records::BIGINT AS records, records > 0 AND (records >= 12 OR seconds >= 3000000) AS due FROM s""")
def compaction_due_plan(spark, sf):
    """Each user's events as one unfolded tail."""
    events = t.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    tails = events.groupBy("user_id").agg(
        F.count("*").alias("records"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("us")
    )
    return tails.select("user_id", "records", compaction_due(F.col("records"), F.col("us") / 1e6, 12, 3_000_000).alias("due"))


@query("compaction_cadence", """WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS records FROM events)
    SELECT user_id, event_id, records::BIGINT AS records FROM n WHERE records % 5 = 0""")
def compaction_cadence(spark, sf):
    """Where folds fall when each user's tail is folded after every fifth record."""
    return fold_points(t.table(spark, sf, "events"), "user_id", "ts", "event_id", 5).select("user_id", "event_id", F.col("records").cast(L).alias("records"))


@query("watch_debounce", """WITH e AS (SELECT event_type, ts, lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS p FROM events),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM e)
    SELECT event_type, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*)::BIGINT AS changes FROM g GROUP BY event_type, b""")
def watch_debounce(spark, sf):
    """Events as file changes: a burst ends after a quiet gap and costs one reconcile."""
    events = t.table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    bursts = burst_slices(events, ["event_type"], gap_seconds=600, unit="day")
    return bursts.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "changes")


PULSES = 6  # slices of the event table that arrive one after the other


@query("watch_state", f"""WITH e AS (SELECT *, event_id * {PULSES} // (SELECT max(event_id) + 1 FROM events) AS pulse FROM events),
    l AS (SELECT 'doc://' || user_id AS uri, pulse, max_by(event_type, event_id) AS kind FROM e GROUP BY user_id, pulse),
    p AS (SELECT *, lag(kind) OVER (PARTITION BY uri ORDER BY pulse) AS was FROM l),
    s AS (SELECT uri, CASE WHEN kind = 'error' THEN CASE WHEN was <> 'error' THEN 'vanished' END WHEN was IS NULL OR was = 'error' THEN 'new'
                           WHEN was = kind THEN 'unchanged' ELSE 'changed' END AS status FROM p)
    SELECT uri, status, count(*)::BIGINT AS changes FROM s WHERE status IS NOT NULL GROUP BY ALL""")
def watch_state(spark, sf):
    """The event table replayed as a stream of file changes, a micro-batch per slice of it, each change judged against
    what its URI's state remembers of the slices before."""
    events = t.table(spark, sf, "events").select("event_id", "user_id", "event_type")
    folder = scratch(spark, "watch")
    last = events.agg(F.max("event_id")).first()[0]
    for pulse in range(PULSES):  # one file after the other, so the stream takes them in this order
        slice_ = events.where(F.floor(F.col("event_id") * PULSES / (last + 1)) == pulse)
        slice_.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    changes = stream.select(
        F.concat(F.lit("doc://"), F.col("user_id").cast("string")).alias("uri"),
        F.when(F.col("event_type") == "error", "deleted").otherwise("modified").alias("kind"),
        F.sha2("event_type", 256).alias("content_hash"),
        F.col("event_id").alias("seq"),
    )
    running = (
        last_known(changes).writeStream.format("parquet").option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("uri", "status").agg(F.count("*").alias("changes"))
