"""Retrieval evaluation over a sweep: chunk caps, overlaps, embedding widths, retrieval methods.

The sweep's per-query scores feed two dozen reports. They are written to the shared folder once
per session and tables, so the reports do not rank the corpus again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.stats import DRAWS, POISSON_CDF
from corvane.operators import effects as E
from corvane.operators import metrics as M
from corvane.operators import passages
from corvane.operators import stats as S
from corvane.operators.embed import hash_buckets, hash_embedder, list_array, window_bags
from corvane.operators.fusion import fuse_documents
from corvane.operators.lexical import bm25_topk
from corvane.operators.topk import Expansion, folded, topk_by
from corvane.plans import search, sql
from corvane.plans import tables as t
from corvane.plans.registry import query
from corvane.session import cut_lineage

L = "long"
CAPS = (64, 128)
OVERLAPS = (0, 16, 32)
DIMS = (16, 64)
DEPTH = 20
K = 10
METRICS = ("ndcg", "recall", "mrr", "p1")
ANCHOR = 8

_MEMO: dict[tuple[str, str, int, str], DataFrame] = {}


def table_mark(spark, sf) -> int:
    """A mark of the tables' files: paths, sizes and times, so that changed tables under one path are other tables."""
    folder = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = folder.load([f"{sf}/{name}.parquet" for name in ("documents", "benchmark")])
    return files.agg(F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first()[0]


def once(spark, sf, name, build) -> DataFrame:
    """``build()`` written to the shared folder, once per application and state of the tables."""
    key = (spark.sparkContext.applicationId, sf, table_mark(spark, sf), name)
    if key not in _MEMO:
        _MEMO[key] = cut_lineage(build())
    return _MEMO[key]


# -- judgements ------------------------------------------------------------------------------------


def passage_qrels(spark, sf) -> DataFrame:
    """``qid, corpus, doc_id, rel``: documents holding a passage (2), or any eight words in a row of it (1).

    A passage under eight words counts as one run. Found in one scan, once per state of the tables.
    """

    def found() -> DataFrame:
        docs = t.documents(spark, sf).where("lang IS NOT NULL").select("lang", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
        named = docs.select(F.struct("lang", "doc_id").alias("doc"), "text")
        rels = passages.hits(named, t.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"), "doc")
        return rels.groupBy("qid", F.concat(F.lit("docs_"), "doc.lang").alias("corpus"), F.col("doc.doc_id").alias("doc_id")).agg(F.max("rel").alias("rel"))

    return once(spark, sf, "qrels", found)


def _runs_sql(words: str, k: str) -> str:
    return f"list_transform(range(1, len({words}) - {k} + 2), lambda i: array_to_string(list_slice({words}, i, i + {k} - 1), ' '))"


QRELS_SQL = f"""qpass AS (SELECT item_id AS qid, text, {sql.toks('text')} AS w FROM benchmark),
    qruns AS (SELECT DISTINCT qid, unnest({_runs_sql('w', f'least(len(w), {ANCHOR})')}) AS run FROM qpass WHERE len(w) > 0),
    dtoks AS (SELECT doc_id, {sql.toks('text')} AS w FROM documents WHERE lang IS NOT NULL),
    druns AS (SELECT DISTINCT doc_id, unnest({_runs_sql('w', str(ANCHOR))}) AS run FROM dtoks WHERE len(w) >= {ANCHOR}),
    short AS (SELECT qid, run FROM qruns SEMI JOIN (SELECT qid FROM qpass WHERE len(w) < {ANCHOR}) USING (qid)),
    qhit AS (SELECT qid, doc_id FROM qruns JOIN druns USING (run)
             UNION SELECT qid, doc_id FROM short JOIN dtoks ON contains(' ' || array_to_string(w, ' ') || ' ', ' ' || run || ' ')),
    qrels AS (SELECT qid, 'docs_' || lang AS corpus, doc_id, CASE WHEN contains(documents.text, qpass.text) THEN 2 ELSE 1 END AS rel
              FROM qhit JOIN qpass USING (qid) JOIN documents USING (doc_id))"""


@query("qrels_passages", f"WITH {QRELS_SQL} SELECT qid, corpus, doc_id, rel::BIGINT AS rel FROM qrels")
def qrels_passages(spark, sf):
    return passage_qrels(spark, sf).withColumn("rel", F.col("rel").cast(L))


@query("agg_qrels_density", f"WITH {QRELS_SQL}, n AS (SELECT corpus, qid, count(*) AS c FROM qrels GROUP BY ALL) SELECT corpus, round(avg(c), 2) AS judged_per_query, count(*)::BIGINT AS queries FROM n GROUP BY corpus")
def agg_qrels_density(spark, sf):
    counts = passage_qrels(spark, sf).where("rel > 0").groupBy("corpus", "qid").agg(F.count("*").alias("c"))
    return counts.groupBy("corpus").agg(F.round(F.avg("c"), 2).alias("judged_per_query"), F.count("*").alias("queries"))


# -- the sweep -------------------------------------------------------------------------------------


PROFILE_COLS = ["corpus", "max_tokens", "overlap_tokens"]


def profile_tag(cap=None, overlap=None):
    return F.concat(F.lit("whitespace-t"), F.col("max_tokens").cast("string"), F.lit("-o"), F.col("overlap_tokens").cast("string"), F.lit("-word"))


def grid_buckets(spark, sf) -> DataFrame:
    """Every document's tokens as buckets of the widest bag; the chunks of all profiles and the narrower bags are counted from them."""
    wide = hash_buckets(max(DIMS), "md5")
    docs = t.documents(spark, sf).where("lang IS NOT NULL")
    return once(spark, sf, "grid", lambda: docs.select("doc_id", F.concat(F.lit("docs_"), "lang").alias("corpus"), wide(F.col("text")).alias("buckets")))


GRID_SLICE = 500_000  # tokens whose chunks a task holds at a time, about


def grid_chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Every document under every (cap, overlap), its chunks embedded as bags."""
    sizes = pc.binary_length(batch.column("buckets")).fill_null(0).to_numpy() // 2
    for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(np.cumsum(sizes) // GRID_SLICE)) + 1):
        part = batch.take(pa.array(at))
        docs = [np.frombuffer(x or b"", dtype="<u2").astype(np.int64) for x in part.column("buckets").to_pylist()]
        profiles = [(cap, overlap) for cap in CAPS for overlap in OVERLAPS]
        for (cap, overlap), (doc, ordinal, bags) in zip(profiles, window_bags(docs, max(DIMS), profiles), strict=True):
            n = len(doc)
            columns = [
                part.column("corpus").take(pa.array(doc)), pa.array(np.full(n, cap, np.int32)), pa.array(np.full(n, overlap, np.int32)),
                part.column("doc_id").take(pa.array(doc)), pa.array(ordinal.astype(np.int32)), list_array(bags.astype(np.float64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*PROFILE_COLS, "doc_id", "ordinal", "vector"])


def grid_rankings(spark, sf, dim: int, words: int | None = None) -> DataFrame:
    asked = t.passages(spark, sf, dim)
    if words is not None:
        from corvane.functions.text import truncate_words

        asked = asked.select("qid", truncate_words(F.col("text"), words).alias("text")).withColumn("vector", hash_embedder(dim, "md5")(F.col("text")))
    buckets = grid_buckets(spark, sf)
    made = f"corpus string, max_tokens int, overlap_tokens int, doc_id {buckets.schema['doc_id'].dataType.simpleString()}, ordinal int, vector array<double>"
    chunks = Expansion(buckets.columns, T.StructType.fromDDL(made), grid_chunks)
    return topk_by(
        buckets, asked, DEPTH, folded(max(DIMS), dim), dim=dim, keys=["doc_id", "ordinal"], segments=PROFILE_COLS, unique=["doc_id"], expand=chunks
    )


def corpora(spark, sf) -> list[str]:
    """One corpus per language that the documents have; a document without a language is in none."""
    found = t.table(spark, sf, "documents").select("lang").where("lang IS NOT NULL").distinct().orderBy("lang")
    return [f"docs_{r['lang']}" for r in found.collect()]


def _asked(spark, sf, cells) -> DataFrame:
    """Every query of every cell of the grid (cells as literal structs, exploded per query row)."""
    return t.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.inline(F.array(*cells)))


def sweep_scores(spark, sf, words: int | None = None) -> DataFrame:
    """``cell, corpus, profile, axes..., embedding, dim, method, qid, ndcg, recall, mrr, p1``."""
    qrels = passage_qrels(spark, sf)
    names = corpora(spark, sf)
    parts = []
    lexical = None
    for dim in DIMS:
        ranked = grid_rankings(spark, sf, dim, words)
        if words is None:
            ranked = cut_lineage(ranked)
        asked = _asked(spark, sf, [
            F.struct(F.lit(c).alias("corpus"), F.lit(m).alias("max_tokens"), F.lit(o).alias("overlap_tokens"))
            for c in names for m in CAPS for o in OVERLAPS
        ])
        plain = M.per_query_metrics(ranked, qrels, asked, K, segments=PROFILE_COLS, decimals=6)
        parts.append(plain.withColumn("method", F.lit(None).cast("string")).withColumn("dim", F.lit(dim)))
        if words is not None:
            continue
        if lexical is None:
            lexical = cut_lineage(bm25_topk(
                t.documents(spark, sf).where("lang IS NOT NULL").select("doc_id", F.concat(F.lit("docs_"), "lang").alias("corpus"), "text"),
                t.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"), DEPTH,
                keys=["doc_id"], corpus=F.col("corpus"),
            ).select("qid", "corpus", "doc_id", "rank"))
        dense = ranked.where((F.col("max_tokens") == CAPS[0]) & (F.col("overlap_tokens") == 0)).select("qid", "corpus", "doc_id", "rank")
        fused = fuse_documents(dense.unionByName(lexical), K, segments=["corpus"]).select("qid", "corpus", "doc_id", "rank")
        methods = None
        for name, rows in (("dense", dense), ("bm25", lexical), ("hybrid", fused)):
            one = rows.withColumn("method", F.lit(name))
            methods = one if methods is None else methods.unionByName(one)
        asked = _asked(spark, sf, [
            F.struct(F.lit(c).alias("corpus"), F.lit(m).alias("method")) for c in names for m in ("dense", "bm25", "hybrid")
        ])
        declared = M.per_query_metrics(methods, qrels, asked, K, segments=["corpus", "method"], decimals=6)
        parts.append(declared.withColumn("max_tokens", F.lit(CAPS[0])).withColumn("overlap_tokens", F.lit(0)).withColumn("dim", F.lit(dim)))
    scores = parts[0]
    for part in parts[1:]:
        scores = scores.unionByName(part)
    embedding = F.concat(F.lit("hash-"), F.col("dim").cast("string"))
    cell = F.concat_ws("__", "corpus", profile_tag(), embedding, "method")
    return scores.select(
        cell.alias("cell"), "corpus", profile_tag().alias("profile"), "max_tokens", "overlap_tokens",
        embedding.alias("embedding"), "dim", "method", "qid", *METRICS,
    )


def scores(spark, sf) -> DataFrame:
    return once(spark, sf, "scores", lambda: sweep_scores(spark, sf))


def _grid_sql(words: int | None = None) -> str:
    text = "text" if words is None else f"array_to_string(list_slice({sql.toks('text')}, 1, {words}), ' ')"
    per_dim = ",\n".join(f"""{sql.bag_cte(f'cb{d}', 'chunks', 'doc_id, lang, cap, ov, ordinal', 'toks', d)},
    {sql.bag_cte(f'qb{d}', 'benchmark', 'item_id', sql.toks(text), d)},
    sc{d} AS (SELECT {d} AS dim, q.item_id AS qid, 'docs_' || c.lang AS corpus, c.cap, c.ov, c.doc_id, c.ordinal,
               round(sum(q.c * c.c) / (any_value(qn.n) * any_value(cn.n)), 6) AS score
        FROM qb{d} q JOIN cb{d} c USING (b) JOIN qb{d}_n qn ON qn.item_id = q.item_id
        JOIN cb{d}_n cn ON cn.doc_id = c.doc_id AND cn.cap = c.cap AND cn.ov = c.ov AND cn.ordinal = c.ordinal
        GROUP BY q.item_id, c.lang, c.cap, c.ov, c.doc_id, c.ordinal)""" for d in DIMS)
    union = " UNION ALL ".join(f"SELECT * FROM sc{d}" for d in DIMS)
    return f"""{QRELS_SQL},
    g AS (SELECT * FROM (VALUES (64), (128)) a(cap), (VALUES (0), (16), (32)) b(ov)),
    chunks AS (SELECT doc_id, lang, cap, ov, s // cap AS ordinal, list_slice(t, greatest(s - ov, 0) + 1, s + cap) AS toks
      FROM (SELECT doc_id, lang, cap, ov, t, unnest(range(0, len(t), cap)) AS s FROM (SELECT doc_id, lang, {sql.toks('text')} AS t FROM documents), g)),
    {per_dim},
    gbest AS (SELECT dim, qid, corpus, cap, ov, doc_id, max(score) AS score, min_by(ordinal, (-score, ordinal)) AS ordinal FROM ({union}) GROUP BY ALL),
    granked AS (SELECT *, row_number() OVER (PARTITION BY dim, qid, corpus, cap, ov ORDER BY score DESC, doc_id, ordinal) AS rank FROM gbest)"""


def _metrics_sql(name: str, ranking: str, keys: str, asked: str) -> str:
    """Per-query metrics CTE over ``ranking(keys, corpus, qid, doc_id, rank)`` for all of ``asked``."""
    return f"""{name}_h AS (SELECT {keys}, r.corpus, r.qid, sum(rel / log2(rank + 1)) AS dcg, count(*) AS found, min(rank) AS first
        FROM {ranking} r JOIN qrels q ON q.qid = r.qid AND q.doc_id = r.doc_id AND q.corpus = r.corpus WHERE rank <= 10 GROUP BY ALL),
    {name}_i AS (SELECT corpus, qid, sum(CASE WHEN nth <= 10 THEN rel / log2(nth + 1) ELSE 0 END) AS ideal, count(*) AS relevant
        FROM (SELECT *, row_number() OVER (PARTITION BY corpus, qid ORDER BY rel DESC, doc_id) AS nth FROM qrels) GROUP BY ALL),
    {name} AS (SELECT a.*, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(found / relevant, 0), 6) AS recall,
               round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr, coalesce((first = 1)::INT::DOUBLE, 0) AS p1
        FROM {asked} a LEFT JOIN {name}_h h USING ({keys}, corpus, qid) LEFT JOIN {name}_i i USING (corpus, qid))"""


_LANGS = "(SELECT DISTINCT 'docs_' || lang AS corpus FROM documents WHERE lang IS NOT NULL)"

PLAIN_SQL = f"""{_grid_sql()},
    asked AS (SELECT dim, cap, ov, corpus, item_id AS qid FROM (VALUES (16), (64)) d(dim), g, {_LANGS}, benchmark),
    {_metrics_sql('plain', 'granked', 'dim, cap, ov', 'asked')}"""

SCORES_SQL = f"""{PLAIN_SQL}, {search.BM25_SQL},
    lexcorp AS (SELECT s.qid, 'docs_' || lex.lang AS corpus, s.doc_id, row_number() OVER (PARTITION BY s.qid, lex.lang ORDER BY s.score DESC, s.doc_id) AS rank
                FROM lexscore s JOIN lex USING (doc_id) WHERE s.score > 0),
    systems AS (SELECT dim, qid, corpus, doc_id, rank, 'dense' AS method FROM granked WHERE cap = 64 AND ov = 0 AND rank <= 20
                UNION ALL SELECT dim, qid, corpus, doc_id, rank, 'bm25' FROM lexcorp, (VALUES (16), (64)) d(dim) WHERE rank <= 20),
    fusedr AS (SELECT dim, qid, corpus, doc_id, round(sum(1.0 / (60 + rank)), 12) AS rrf, min(rank) AS best FROM systems GROUP BY ALL),
    methods AS (SELECT * FROM systems UNION ALL
                SELECT dim, qid, corpus, doc_id, row_number() OVER (PARTITION BY dim, qid, corpus ORDER BY rrf DESC, best, doc_id) AS rank, 'hybrid' FROM fusedr),
    asked2 AS (SELECT dim, method, corpus, item_id AS qid FROM (VALUES (16), (64)) d(dim), (VALUES ('dense'), ('bm25'), ('hybrid')) m(method), {_LANGS}, benchmark),
    {_metrics_sql('declared', 'methods', 'dim, method', 'asked2')},
    scores AS (
      SELECT concat_ws('__', corpus, 'whitespace-t' || cap || '-o' || ov || '-word', 'hash-' || dim, method) AS cell, corpus,
             'whitespace-t' || cap || '-o' || ov || '-word' AS profile, cap AS max_tokens, ov AS overlap_tokens, 'hash-' || dim AS embedding, dim, method, qid, ndcg, recall, mrr, p1
      FROM (SELECT dim, cap, ov, NULL AS method, corpus, qid, ndcg, recall, mrr, p1 FROM plain
            UNION ALL SELECT dim, 64, 0, method, corpus, qid, ndcg, recall, mrr, p1 FROM declared))"""

SCORE_COLS = "cell, corpus, profile, embedding, method, qid, ndcg, recall, mrr, p1"


@query("agg_per_query", f"WITH {SCORES_SQL} SELECT {SCORE_COLS} FROM scores")
def agg_per_query(spark, sf):
    return scores(spark, sf).select(*SCORE_COLS.split(", "))


for _metric, _name in (("ndcg", "agg_ndcg"), ("recall", "agg_recall_k"), ("mrr", "agg_mrr"), ("p1", "agg_p1")):

    def _metric_plan(spark, sf, metric=_metric):
        return scores(spark, sf).groupBy("corpus", "profile", "embedding", E.method_label(F.col("method")).alias("method")).agg(
            F.round(F.avg(metric), 6).alias(metric), F.round(F.max(metric), 6).alias("best"), F.count_if(F.col(metric) > 0).alias("nonzero")
        )

    query(_name, f"""WITH {SCORES_SQL} SELECT corpus, profile, embedding, coalesce(method, 'plain') AS method, round(avg({_metric}), 6) AS {_metric},
        round(max({_metric}), 6) AS best, count(*) FILTER ({_metric} > 0)::BIGINT AS nonzero FROM scores GROUP BY ALL""")(_metric_plan)


def cells(spark, sf) -> DataFrame:
    """Mean metrics per cell with its axes."""
    return once(spark, sf, "cells", lambda: _cells(scores(spark, sf)))


def _cells(s: DataFrame) -> DataFrame:
    means = M.mean_metrics(s, ["cell", "corpus", "profile", "embedding", "dim", "method"])
    rounded = means.select("cell", "corpus", "profile", "embedding", "dim", "method", "n_queries", *[F.round(m, 4).alias(m) for m in METRICS])
    return rounded.withColumn("axes", E.parse_profile(F.col("profile"))).select(*rounded.columns, "axes.*")


CELLS_SQL = f"""{SCORES_SQL},
    cells AS (SELECT cell, corpus, profile, embedding, dim, method, any_value(max_tokens) AS max_tokens, any_value(overlap_tokens) AS overlap_tokens, count(*) AS n_queries,
                     round(avg(ndcg), 4) AS ndcg, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(p1), 4) AS p1 FROM scores GROUP BY ALL)"""


@query("agg_mean_metrics", f"WITH {CELLS_SQL} SELECT cell, corpus, profile, embedding, dim::BIGINT AS dim, n_queries::BIGINT AS n_queries, ndcg, recall, mrr, p1 FROM cells")
def agg_mean_metrics(spark, sf):
    return cells(spark, sf).select("cell", "corpus", "profile", "embedding", F.col("dim").cast(L).alias("dim"), "n_queries", *METRICS)


# -- intervals -------------------------------------------------------------------------------------

_CDF = "".join(f" WHEN u < {p!r} THEN {float(i)}" for i, p in enumerate(POISSON_CDF))


def weights_sql(unit: str = "item_id", table: str = "benchmark", name: str = "wts", key: str = "qid") -> str:
    """The weights of every unit in every resample, by the same MD5s."""
    return f"""{name} AS (SELECT {key}, b, CASE{_CDF} ELSE 9.0 END AS w
      FROM (SELECT {key}, block * {DRAWS} + k AS b, ('0x' || substr(h, 4 * k + 1, 4))::BIGINT / 65536.0 AS u
            FROM (SELECT {unit} AS {key}, block, md5({unit} || '|' || block) AS h FROM {table}, range(0, {S.RESAMPLES // DRAWS}) r(block)), range(0, {DRAWS}) s(k)))"""


WEIGHTS_SQL = weights_sql()


def _interval_sql(name: str, src: str, keys: str, value: str, unit: str = "qid", weights: str = "wts") -> str:
    return f"""{name} AS (SELECT {keys}, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi
      FROM (SELECT {keys}, b, round(sum(w * {value}) / sum(w), 12) AS m FROM {src} JOIN {weights} USING ({unit}) GROUP BY ALL HAVING sum(w) > 0) GROUP BY ALL)"""


@query("agg_bootstrap_ci", f"""WITH {SCORES_SQL}, {WEIGHTS_SQL}, {_interval_sql('ci', 'scores', 'cell', 'recall')},
    st AS (SELECT cell, avg(recall) AS mean, count(*)::BIGINT AS n FROM scores GROUP BY cell)
    SELECT cell, n, round(mean, 6) AS mean, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, round((ci_hi - ci_lo) / 2, 6) AS half_width FROM st JOIN ci USING (cell)""")
def agg_bootstrap_ci(spark, sf):
    """Recall per cell with its interval."""
    got = S.mean_interval(scores(spark, sf).select("cell", "qid", F.col("recall").alias("value")), ["cell"])
    return got.select("cell", "n", *[F.round(c, 6).alias(c) for c in ("mean", "ci_lo", "ci_hi", "half_width")])


@query("agg_bootstrap_additive", f"""WITH {SCORES_SQL}, {WEIGHTS_SQL}, {_interval_sql('ci', 'scores', 'cell', 'ndcg')},
    st AS (SELECT cell, round(avg(ndcg), 6) AS mean, round(coalesce(stddev_samp(ndcg), 0), 6) AS sd, count(*)::BIGINT AS n FROM scores GROUP BY cell)
    SELECT cell, mean, sd, n, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM st JOIN ci USING (cell)""")
def agg_bootstrap_additive(spark, sf):
    """The same interval by additive resampling, which never gathers a cell."""
    values = scores(spark, sf).select("cell", "qid", F.col("ndcg").alias("value"))
    got = S.mean_interval(values, ["cell"])
    return got.select("cell", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "ci_lo", "ci_hi")])


def deltas(spark, sf) -> DataFrame:
    """Per-query differences of every one-axis pair of cells."""

    def build():
        pairs = E.one_axis_pairs(cells(spark, sf))
        return S.paired_deltas(pairs, scores(spark, sf).select("cell", "qid", F.col("ndcg").alias("value")))

    return once(spark, sf, "deltas", build)


def effects(spark, sf) -> DataFrame:
    """Every one-axis comparison of the sweep, in the raw (unoriented) direction."""

    def build():
        return S.paired_summary(deltas(spark, sf), E.PAIR_COLUMNS, drop_same=True, places=4)

    return once(spark, sf, "effects", build)


def oriented(spark, sf) -> DataFrame:
    return E.orient(effects(spark, sf))


EFFECTS_SQL = f"""{CELLS_SQL}, {WEIGHTS_SQL},
    pairs AS (
      SELECT CASE WHEN l.method IS NOT NULL THEN 'method' WHEN l.embedding <> r.embedding THEN 'embedding' WHEN l.max_tokens <> r.max_tokens THEN 'max_tokens' ELSE 'overlap_tokens' END AS axis,
             l.corpus, l.embedding, l.dim, l.max_tokens AS held_cap, l.cell AS to_cell, r.cell AS from_cell, l.max_tokens AS lm, r.max_tokens AS rm, l.overlap_tokens AS lo, r.overlap_tokens AS ro,
             l.embedding AS le, r.embedding AS re, l.method AS lme, r.method AS rme
      FROM cells l JOIN cells r ON l.corpus = r.corpus AND l.cell < r.cell AND (l.method IS NULL) = (r.method IS NULL)
      WHERE (l.embedding <> r.embedding)::INT + (l.max_tokens <> r.max_tokens)::INT + (l.overlap_tokens <> r.overlap_tokens)::INT + coalesce(l.method <> r.method, FALSE)::INT = 1
        AND (l.method IS NULL OR l.method <> r.method)),
    named AS (SELECT axis, corpus, embedding, dim, held_cap, to_cell, from_cell,
        CASE axis WHEN 'method' THEN rme WHEN 'embedding' THEN re WHEN 'max_tokens' THEN rm::VARCHAR ELSE ro::VARCHAR END AS from_level,
        CASE axis WHEN 'method' THEN lme WHEN 'embedding' THEN le WHEN 'max_tokens' THEN lm::VARCHAR ELSE lo::VARCHAR END AS to_level,
        concat_ws(' ', 'whitespace', CASE WHEN axis <> 'max_tokens' THEN 'hint' || lm END, CASE WHEN axis <> 'overlap_tokens' THEN 'ov' || lo || 'tok' END) AS held FROM pairs),
    deltas AS (SELECT n.*, a.qid, round(a.ndcg - b.ndcg, 9) AS delta FROM named n JOIN scores a ON a.cell = n.to_cell JOIN scores b ON b.cell = n.from_cell AND b.qid = a.qid),
    psum AS (SELECT to_cell, from_cell, axis, corpus, embedding, dim, held, held_cap, from_level, to_level, round(avg(delta), 4) AS mean_delta,
                    count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta < 0) AS losses, count(*) AS n_shared
             FROM deltas GROUP BY ALL HAVING count(*) FILTER (delta = 0) < count(*)),
    {_interval_sql('pci', 'deltas', 'to_cell, from_cell', 'delta')},
    eff0 AS (SELECT psum.*, round(ci_lo, 4) AS ci_lo, round(ci_hi, 4) AS ci_hi FROM psum JOIN pci USING (to_cell, from_cell)),
    eff AS (SELECT *, ci_lo > 0 OR ci_hi < 0 AS resolved, (ci_lo > 0 OR ci_hi < 0) AND abs(mean_delta) >= 0.005 AS material FROM eff0),
    flips AS (SELECT *, CASE WHEN axis IN ('max_tokens', 'overlap_tokens') THEN from_level::INT > to_level::INT ELSE from_level > to_level END AS flip FROM eff),
    ori AS (SELECT axis, corpus, embedding, dim, held, held_cap, from_cell, to_cell, n_shared, ties, resolved, material,
        CASE WHEN flip THEN to_level ELSE from_level END AS from_level, CASE WHEN flip THEN from_level ELSE to_level END AS to_level,
        CASE WHEN flip THEN -mean_delta ELSE mean_delta END AS mean_delta, CASE WHEN flip THEN -ci_hi ELSE ci_lo END AS ci_lo, CASE WHEN flip THEN -ci_lo ELSE ci_hi END AS ci_hi,
        CASE WHEN flip THEN losses ELSE wins END AS wins, CASE WHEN flip THEN wins ELSE losses END AS losses FROM flips),
    orn AS (SELECT *, try_cast(from_level AS DOUBLE) AS from_num, try_cast(to_level AS DOUBLE) AS to_num, CASE WHEN mean_delta > 0 THEN to_level ELSE from_level END AS favoured,
        CASE WHEN mean_delta > 0 THEN from_level ELSE to_level END AS unfavoured FROM ori)"""

EFFECT_OUT = "axis, corpus, embedding, held, from_level, to_level, from_cell, to_cell, mean_delta, ci_lo, ci_hi, wins, ties, losses, n_shared, resolved, material"


@query("agg_paired_effects", f"WITH {EFFECTS_SQL} SELECT {EFFECT_OUT.replace('wins', 'wins::BIGINT AS wins')} FROM eff")
def agg_paired_effects(spark, sf):
    return effects(spark, sf).select(*EFFECT_OUT.split(", "))


@query("agg_paired_ci", f"""WITH {EFFECTS_SQL}, od AS (SELECT * FROM deltas WHERE axis = 'overlap_tokens'), {_interval_sql('oci', 'od', 'to_cell, from_cell', 'delta')},
    os AS (SELECT to_cell, from_cell, round(avg(delta), 6) AS mean_delta, count(*)::BIGINT AS n_shared FROM od GROUP BY ALL)
    SELECT to_cell, from_cell, mean_delta, n_shared, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, round(ci_lo, 6) > 0 OR round(ci_hi, 6) < 0 AS resolved FROM os JOIN oci USING (to_cell, from_cell)""")
def agg_paired_ci(spark, sf):
    """The comparisons along the overlap axis, those without any difference too."""
    got = S.paired_summary(deltas(spark, sf).where("axis = 'overlap_tokens'"), E.PAIR_COLUMNS)
    return got.select("to_cell", "from_cell", "mean_delta", "n_shared", "ci_lo", "ci_hi", "resolved")


@query("agg_material", f"WITH {EFFECTS_SQL} SELECT axis, resolved, material, count(*)::BIGINT AS comparisons, round(min(abs(mean_delta)), 4) AS smallest FROM eff GROUP BY ALL")
def agg_material(spark, sf):
    return effects(spark, sf).groupBy("axis", "resolved", "material").agg(
        F.count("*").alias("comparisons"), F.round(F.min(F.abs("mean_delta")), 4).alias("smallest")
    )


@query("agg_same_measurement", f"""WITH {EFFECTS_SQL} SELECT to_cell, from_cell, bool_and(delta = 0) AS same, count(*)::BIGINT AS n_shared FROM deltas GROUP BY ALL""")
def agg_same_measurement(spark, sf):
    return deltas(spark, sf).groupBy("to_cell", "from_cell").agg(F.bool_and(F.col("delta") == 0).alias("same"), F.count("*").alias("n_shared"))


@query("orient", f"WITH {EFFECTS_SQL} SELECT {EFFECT_OUT}, favoured, unfavoured FROM orn")
def orient_plan(spark, sf):
    return oriented(spark, sf).select(*EFFECT_OUT.split(", "), "favoured", "unfavoured")


LADDER_SQL = """span AS (SELECT corpus, held, embedding, min(from_num) AS lo, max(to_num) AS hi FROM orn WHERE axis = 'overlap_tokens' GROUP BY ALL),
    lad AS (SELECT s.corpus, s.held, s.embedding, s.lo, s.hi, CASE WHEN e.material IS NULL THEN 'unspanned' WHEN NOT e.material THEN 'undecided' WHEN e.mean_delta > 0 THEN 'more' ELSE 'less' END AS verdict
            FROM span s LEFT JOIN orn e ON e.axis = 'overlap_tokens' AND e.corpus = s.corpus AND e.held = s.held AND e.embedding = s.embedding AND e.from_num = s.lo AND e.to_num = s.hi)"""


@query("agg_ladder", f"WITH {EFFECTS_SQL}, {LADDER_SQL} SELECT * FROM lad")
def agg_ladder(spark, sf):
    return E.ladder_verdicts(oriented(spark, sf), "overlap_tokens")


def _steps_sql(by: str) -> str:
    return f"""lev AS (SELECT DISTINCT {by}, level FROM (SELECT {by}, from_num AS level FROM orn WHERE axis = 'overlap_tokens' UNION ALL SELECT {by}, to_num FROM orn WHERE axis = 'overlap_tokens')),
    nxt AS (SELECT *, lead(level) OVER (PARTITION BY {by} ORDER BY level) AS nx, count(*) OVER (PARTITION BY {by}) AS n FROM lev),
    stp AS (SELECT o.* FROM orn o JOIN nxt USING ({by}) WHERE o.axis = 'overlap_tokens' AND nxt.n >= 3 AND o.from_num = nxt.level AND o.to_num = nxt.nx)"""


@query("agg_rung_steps", f"""WITH {EFFECTS_SQL}, {_steps_sql('corpus, held, held_cap')}
    SELECT corpus, held, held_cap::BIGINT AS held_cap, from_num, to_num, count(*) FILTER (resolved)::BIGINT AS resolved, count(*)::BIGINT AS compared, round(avg(mean_delta), 6) AS mean_delta,
           min(mean_delta) AS min_delta, max(mean_delta) AS max_delta FROM stp GROUP BY ALL""")
def agg_rung_steps(spark, sf):
    return E.rung_steps(oriented(spark, sf)).withColumn("held_cap", F.col("held_cap").cast(L))


@query("agg_rung_ceiling", f"""WITH {EFFECTS_SQL}, {_steps_sql('corpus, held, held_cap, embedding')}
    SELECT corpus, held, held_cap::BIGINT AS held_cap, embedding, count(*)::BIGINT AS steps, count(*) FILTER (resolved)::BIGINT AS resolved, count(*) FILTER (material)::BIGINT AS material,
           max(to_num) FILTER (material) AS highest_material, max_by(from_num, to_num) AS last_from, max(to_num) AS last_to, max_by(mean_delta, to_num) AS last_delta,
           CASE WHEN max_by(stp.material, to_num) THEN 'material' WHEN max_by(stp.resolved, to_num) THEN 'small' ELSE 'unresolved' END AS last_state
    FROM stp GROUP BY corpus, held, held_cap, embedding""")
def agg_rung_ceiling(spark, sf):
    return E.rung_ceiling(oriented(spark, sf)).withColumn("held_cap", F.col("held_cap").cast(L))


@query("agg_knob_summary", f"""WITH {EFFECTS_SQL}, w AS (SELECT axis, favoured, count(*) AS c FROM orn WHERE material GROUP BY ALL),
    tl AS (SELECT axis, string_agg(c || ' favour ' || favoured, ', ' ORDER BY c DESC, favoured) AS direction FROM w GROUP BY axis)
    SELECT axis, count(*)::BIGINT AS n, count(*) FILTER (resolved)::BIGINT AS resolved, count(*) FILTER (material)::BIGINT AS material, ceil(count(*) * 0.05)::BIGINT AS by_chance,
           coalesce(any_value(direction), 'none') AS direction FROM orn LEFT JOIN tl USING (axis) GROUP BY axis""")
def agg_knob_summary(spark, sf):
    return E.knob_summary(oriented(spark, sf))


# -- rankings of cells -----------------------------------------------------------------------------


@query("agg_ranking_top", f"""WITH {CELLS_SQL}, r AS (SELECT corpus, cell, ndcg, recall, row_number() OVER (PARTITION BY corpus ORDER BY coalesce(ndcg, 0) DESC, cell) AS place FROM cells)
    SELECT corpus, cell, ndcg, recall, place::BIGINT AS place FROM r WHERE place <= 12""")
def agg_ranking_top(spark, sf):
    return E.ranking_top(cells(spark, sf), ["corpus"]).select("corpus", "cell", "ndcg", "recall", F.col("place").cast(L).alias("place"))


@query("agg_best_per_model", f"""WITH {CELLS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY corpus, embedding ORDER BY coalesce(ndcg, 0) DESC, cell) AS n FROM cells)
    SELECT corpus, embedding, cell, profile, dim::INT AS dim, ndcg, recall FROM r WHERE n = 1""")
def agg_best_per_model(spark, sf):
    return E.best_per_model(cells(spark, sf))


@query("agg_winners", f"""WITH {CELLS_SQL}, p AS (SELECT corpus, embedding, max(ndcg) FILTER (method = 'dense') AS dense, max(ndcg) FILTER (method = 'bm25') AS bm25, max(ndcg) FILTER (method = 'hybrid') AS hybrid FROM cells GROUP BY ALL)
    SELECT *, CASE greatest(dense, bm25, hybrid) WHEN dense THEN 'dense' WHEN bm25 THEN 'bm25' ELSE 'hybrid' END AS best FROM p WHERE dense IS NOT NULL AND bm25 IS NOT NULL AND hybrid IS NOT NULL""")
def agg_winners(spark, sf):
    return E.method_winners(cells(spark, sf).where("method IS NOT NULL"))


@query("agg_precision_table", f"""WITH {SCORES_SQL}, {WEIGHTS_SQL}, {_interval_sql('ci', 'scores', 'corpus, cell', 'ndcg')}
    SELECT corpus, (SELECT count(*) FROM benchmark)::BIGINT AS queries, round(avg((ci_hi - ci_lo) / 2), 6) AS half_width, round(2 * avg((ci_hi - ci_lo) / 2), 6) AS separable FROM ci GROUP BY corpus""")
def agg_precision_table(spark, sf):
    values = scores(spark, sf).select("corpus", "cell", "qid", F.col("ndcg").alias("value"))
    got = S.mean_interval(values, ["corpus", "cell"])
    return got.groupBy("corpus").agg(
        F.max("n").alias("queries"), F.round(F.avg("half_width"), 6).alias("half_width"), F.round(2 * F.avg("half_width"), 6).alias("separable")
    )


# -- agreement of metrics --------------------------------------------------------------------------

_PAIRS = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1 :]]
_RANKED = ", ".join(f"rank() OVER (PARTITION BY corpus ORDER BY {m}) + (count(*) OVER (PARTITION BY corpus, {m}) - 1) / 2.0 AS r_{m}" for m in METRICS)
_RHO = " UNION ALL ".join(
    f"""SELECT corpus, count(*)::BIGINT AS n, '{a}' AS "left", '{b}' AS "right", round(CASE WHEN min(r_{a}) = max(r_{a}) OR min(r_{b}) = max(r_{b}) THEN 0 ELSE corr(r_{a}, r_{b}) END, 4)::DOUBLE AS rho FROM rk GROUP BY corpus"""
    for a, b in _PAIRS)


def _rhos(spark, sf) -> DataFrame:
    return S.spearman(cells(spark, sf), ["corpus"], METRICS)


@query("agg_spearman", f"WITH {CELLS_SQL}, rk AS (SELECT corpus, {_RANKED} FROM cells) {_RHO}")
def agg_spearman(spark, sf):
    return _rhos(spark, sf).withColumn("rho", F.round("rho", 4))


@query("agg_pair_disagreement", f"""WITH {CELLS_SQL} SELECT a.corpus, count(*)::BIGINT AS pairs, count(*) FILTER ((a.ndcg > b.ndcg) <> (a.recall > b.recall))::BIGINT AS disagreements
    FROM cells a JOIN cells b ON a.corpus = b.corpus AND a.cell < b.cell WHERE a.ndcg <> b.ndcg AND a.recall <> b.recall GROUP BY a.corpus""")
def agg_pair_disagreement(spark, sf):
    return S.pair_disagreement(cells(spark, sf), ["corpus"], "ndcg", "recall", "cell")


_RAW_RHO = " UNION ALL ".join(
    f"SELECT corpus, CASE WHEN min(r_{a}) = max(r_{a}) OR min(r_{b}) = max(r_{b}) THEN 0 ELSE corr(r_{a}, r_{b}) END AS rho FROM rk GROUP BY corpus" for a, b in _PAIRS)


# ranks of complete cells have a matrix without negative eigenvalues, whose squares add up to those of its entries
@query("agg_effective_views", f"""WITH {CELLS_SQL}, rk AS (SELECT corpus, {_RANKED} FROM cells), rho AS ({_RAW_RHO})
    SELECT corpus, round({len(METRICS) ** 2} / ({len(METRICS)} + 2 * sum(rho * rho)), 6) AS views FROM rho GROUP BY corpus""")
def agg_effective_views(spark, sf):
    return S.effective_views(_rhos(spark, sf), ["corpus"], METRICS).withColumn("views", F.round("views", 6))


@query("agg_metric_redundancy", f"""WITH {CELLS_SQL}, rk AS (SELECT corpus, {_RANKED} FROM cells), rho AS ({_RHO}),
    nd AS (SELECT corpus, count(*) FILTER (abs(rho) >= 0.95)::BIGINT AS near_duplicate_pairs FROM rho GROUP BY corpus)
    SELECT corpus, count(*)::BIGINT AS cells, count(*) < 20 AS thin, round(avg(recall), 4) AS recall_mean, round(max(recall) - min(recall), 4) AS recall_span, any_value(near_duplicate_pairs) AS near_duplicate_pairs
    FROM cells JOIN nd USING (corpus) GROUP BY corpus""")
def agg_metric_redundancy(spark, sf):
    near = _rhos(spark, sf).groupBy("corpus").agg(F.count_if(F.abs(F.round("rho", 4)) >= S.NEAR_DUPLICATE_RHO).alias("near_duplicate_pairs"))
    base = cells(spark, sf).groupBy("corpus").agg(
        F.count("*").alias("cells"), (F.count("*") < 20).alias("thin"), F.round(F.avg("recall"), 4).alias("recall_mean"),
        F.round(F.max("recall") - F.min("recall"), 4).alias("recall_span"),
    )
    return base.join(near, "corpus")


# -- query power -----------------------------------------------------------------------------------

POWER_LADDER = (100, 400, 1600)
_NEED_SQL = "CASE WHEN abs(mean_delta) < 1e-4 OR ci_hi - ci_lo <= 0 THEN 'inf'::DOUBLE ELSE n_shared * pow((ci_hi - ci_lo) / 2 / mean_delta, 2) END"


@query("agg_queries_to_resolve", f"WITH {EFFECTS_SQL}, n AS (SELECT to_cell, from_cell, {_NEED_SQL} AS need FROM orn) SELECT to_cell, from_cell, CASE WHEN isinf(need) THEN NULL ELSE round(need, 3) END AS required, isinf(need) AS never FROM n")
def agg_queries_to_resolve(spark, sf):
    need = S.queries_to_resolve((F.col("ci_hi") - F.col("ci_lo")) / 2, F.col("mean_delta"), F.col("n_shared"))
    never = F.col("need") == float("inf")
    return oriented(spark, sf).select("to_cell", "from_cell", need.alias("need")).select(
        "to_cell", "from_cell", F.when(~never, F.round("need", 3)).alias("required"), never.alias("never")
    )


@query("agg_query_power", f"""WITH {EFFECTS_SQL}, n AS (SELECT *, (ci_hi - ci_lo) / 2 AS half, CASE WHEN NOT resolved THEN {_NEED_SQL} END AS need FROM orn)
    SELECT corpus, max(n_shared)::BIGINT AS queries, count(*)::BIGINT AS comparisons, count(*) FILTER (NOT resolved)::BIGINT AS unresolved, round(count(*) FILTER (NOT resolved) / count(*), 4) AS unresolved_share,
           round(quantile_cont(abs(mean_delta), 0.5), 4) AS median_effect, round(quantile_cont(half, 0.5), 4) AS median_half_width,
           round(quantile_cont(CASE WHEN NOT isinf(need) THEN need END, 0.5), 0) AS median_required_queries, count(*) FILTER (isinf(need))::BIGINT AS never_resolvable,
           {", ".join(f"count(*) FILTER (need <= {x})::BIGINT AS resolved_at_{x}" for x in POWER_LADDER)} FROM n GROUP BY corpus""")
def agg_query_power(spark, sf):
    return S.query_power(oriented(spark, sf), ["corpus"], POWER_LADDER)


HALVES = (1, 2, 3)  # seeds of the subsamples


@query("agg_power_validation", f"""WITH {EFFECTS_SQL}, hd AS (SELECT d.*, seed FROM deltas d, (VALUES (1), (2), (3)) s(seed) WHERE ('0x' || substr(md5('half|' || seed || '|' || qid), 1, 8))::BIGINT / 4294967296.0 < 0.5),
    hs AS (SELECT seed, axis, to_cell, from_cell, round(avg(delta), 6) AS mean_delta, count(*) AS n_shared FROM hd GROUP BY ALL HAVING count(*) FILTER (delta = 0) < count(*)),
    {_interval_sql('hci', 'hd', 'seed, to_cell, from_cell', 'delta')},
    hr AS (SELECT hs.*, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi FROM hs JOIN hci USING (seed, to_cell, from_cell)),
    told AS (SELECT *, {_NEED_SQL} <= (SELECT count(*) FROM benchmark) AS predicted FROM hr WHERE NOT (ci_lo > 0 OR ci_hi < 0)),
    c AS (SELECT t.axis, count(*) AS unresolved_on_half, count(*) FILTER (predicted) AS predicted, count(*) FILTER (e.resolved) AS resolved, count(*) FILTER (predicted AND e.resolved) AS agreed
          FROM told t JOIN eff e USING (to_cell, from_cell) GROUP BY t.axis)
    SELECT axis, unresolved_on_half::BIGINT AS unresolved_on_half, predicted::BIGINT AS predicted, resolved::BIGINT AS resolved, agreed::BIGINT AS agreed,
           CASE WHEN predicted > 0 THEN round(agreed / predicted, 6) END AS "precision", CASE WHEN resolved > 0 THEN round(agreed / resolved, 6) END AS recall FROM c""")
def agg_power_validation(spark, sf):
    """Do effects unresolved on half the queries resolve on all of them when predicted to?

    Over repeated halves, drawn by hash, so they are the same whichever task looks at a query.
    """
    from corvane.functions.stats import uniform

    seeds = deltas(spark, sf).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in HALVES])))
    half = seeds.where(uniform(F.lit("half"), F.col("seed"), F.col("qid")) < 0.5)
    small = S.paired_summary(half, ["seed", *E.PAIR_COLUMNS], drop_same=True)
    need = S.queries_to_resolve((F.col("ci_hi") - F.col("ci_lo")) / 2, F.col("mean_delta"), F.col("n_shared"))
    total = t.table(spark, sf, "benchmark").agg(F.count("*").alias("n")).scalar()
    told = small.where("NOT resolved").select("axis", "to_cell", "from_cell", (need <= total).alias("predicted"))
    seen = effects(spark, sf).select("to_cell", "from_cell", "resolved")
    counts = told.join(seen, ["to_cell", "from_cell"]).groupBy("axis").agg(
        F.count("*").alias("unresolved_on_half"), F.count_if("predicted").alias("predicted"), F.count_if("resolved").alias("resolved"),
        F.count_if(F.col("predicted") & F.col("resolved")).alias("agreed"),
    )
    share = lambda of: F.when(F.col(of) > 0, F.round(F.col("agreed") / F.col(of), 6))
    return counts.withColumn("precision", share("predicted")).withColumn("recall", share("resolved"))
