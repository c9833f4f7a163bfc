"""Search plans: exact top-k, document ranking, fusion, lexical and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import doc_uri
from corvane.operators.ann import PRESETS, AnnParams, ivf_topk, resolve_params, search_mode
from corvane.operators.fusion import fuse_datasets, fuse_documents, rerank
from corvane.operators.lexical import ENDINGS, MARKERS, STOPS, PostingsIndex, analyzer_of, bm25_topk
from corvane.operators.metrics import recall_vs_exact, word_overlap
from corvane.operators.topk import exact_topk
from corvane.plans import sql
from corvane.plans import tables as t
from corvane.plans.hygiene import scratch
from corvane.plans.registry import query
from corvane.session import cut_lineage


def chunk_ranking(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    return exact_topk(
        t.embedded(spark, sf), t.passages(spark, sf), k, dim=t.DIM, keys=["doc_id", "ordinal"]
    )


def class_ranking(spark: SparkSession, sf: str, k: int = 10) -> DataFrame:
    """Every label's mean vector against the whole vector table."""
    return exact_topk(t.vectors(spark, sf), t.class_queries(spark, sf), k, dim=64, keys=["vec_id"])


@query(
    "search_topk_batch",
    f"""WITH {sql.dense_scores_cte()},
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, ordinal) AS rank FROM scored)
    SELECT qid, doc_id, ordinal::BIGINT AS ordinal, score, rank::BIGINT AS rank FROM r WHERE rank <= 10""",
)
def search_topk_batch(spark, sf):
    return chunk_ranking(spark, sf).select(
        "qid", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "score", F.col("rank").cast("long").alias("rank")
    )


@query(
    "search_topk",
    f"""WITH {sql.VECTORS_CTE}, {sql.CLASS_QUERIES_CTE},
    s AS (SELECT qid, vec_id, round({sql.cosine('q', 'v')}, 6) AS score FROM qs, vecs),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT qid::BIGINT AS qid, vec_id, score, rank::BIGINT AS rank FROM r WHERE rank <= 5""",
)
def search_topk(spark, sf):
    return class_ranking(spark, sf, 5).select(
        F.col("qid").cast("long").alias("qid"), "vec_id", "score", F.col("rank").cast("long").alias("rank")
    )


def document_ranking(spark, sf, k: int, *, dim: int = t.DIM, cap: int = t.CAP) -> DataFrame:
    """The ``k`` best documents per passage, each with the chunk that earned its place."""
    return exact_topk(
        t.embedded(spark, sf, cap, dim=dim), t.passages(spark, sf, dim), k, dim=dim,
        keys=["doc_id", "ordinal"], unique=["doc_id"],
    )


DOC_RANK_SQL = """best AS (
      SELECT qid, doc_id, min_by(ordinal, (-score, ordinal)) AS ordinal, max(score) AS score FROM scored GROUP BY ALL),
    docs AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, ordinal) AS rank FROM best)"""


@query(
    "dedup_docs_topk",
    f"""WITH {sql.dense_scores_cte()},
    b AS (SELECT qid, doc_id, max(score) AS score, min_by(ordinal, (-score, ordinal)) AS ordinal FROM scored GROUP BY ALL),
    d AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, ordinal) AS rank FROM b)
    SELECT qid, doc_id, score, rank::BIGINT AS rank FROM d WHERE rank <= 10""",
)
def dedup_docs_topk(spark, sf):
    """The first k distinct documents of the whole chunk ranking: repeats leave it before it is cut."""
    return document_ranking(spark, sf, 10).select("qid", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "doc_representative_chunk",
    f"""WITH {sql.dense_scores_cte()}, {DOC_RANK_SQL}
    SELECT qid, doc_id, ordinal::BIGINT AS ordinal, score, rank::BIGINT AS rank FROM docs WHERE rank <= 10""",
)
def doc_representative_chunk(spark, sf):
    return document_ranking(spark, sf, 10).select(
        "qid", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "score", F.col("rank").cast("long").alias("rank")
    )


def dataset_hits(spark, sf, k: int) -> DataFrame:
    """Top-k chunks per passage inside each dataset; a dataset is one language of documents."""
    ranked = exact_topk(
        t.embedded(spark, sf), t.passages(spark, sf), k, dim=t.DIM, keys=["doc_id", "ordinal"], segments=["lang"]
    )
    return ranked.select(
        "qid", F.col("lang").alias("dataset"), F.col("lang").alias("list_pos"), "rank",
        doc_uri(F.col("doc_id")).alias("uri"), "ordinal", "score",
    )


DATASET_HITS_SQL = """hits AS (
      SELECT qid, lang AS dataset, 'doc://' || doc_id AS uri, ordinal, score,
             row_number() OVER (PARTITION BY qid, lang ORDER BY score DESC, doc_id, ordinal) AS rank FROM scored)"""


@query(
    "search_across",
    f"""WITH {sql.dense_scores_cte()}, {DATASET_HITS_SQL},
    f AS (SELECT qid, uri, ordinal, round(sum(1.0 / (60 + rank)), 12) AS rrf_score,
                 min_by(dataset, (rank, dataset)) AS dataset, min_by(score, (rank, dataset)) AS score
          FROM hits WHERE rank <= 5 GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, uri, ordinal) AS rank FROM f)
    SELECT qid, rank::BIGINT AS rank, dataset, uri, ordinal::BIGINT AS ordinal, score, round(rrf_score, 9) AS rrf_score
    FROM o WHERE rank <= 5""",
)
def search_across(spark, sf):
    return fuse_datasets(dataset_hits(spark, sf, 5), 5).select(
        "qid", F.col("rank").cast("long").alias("rank"), "dataset", "uri",
        F.col("ordinal").cast("long").alias("ordinal"), "score", F.round("rrf_score", 9).alias("rrf_score"),
    )


def overlapping_hits(spark, sf, k: int) -> DataFrame:
    """Two datasets that share chunks: the same documents under two embedding widths."""
    parts = []
    for pos, dim in enumerate((64, 16)):
        ranked = exact_topk(
            t.embedded(spark, sf, dim=dim), t.passages(spark, sf, dim), k, dim=dim, keys=["doc_id", "ordinal"]
        )
        parts.append(ranked.select(
            "qid", F.lit(f"hash-{dim}").alias("dataset"), F.lit(pos).alias("list_pos"), "rank",
            doc_uri(F.col("doc_id")).alias("uri"), "ordinal",
        ))
    return parts[0].unionByName(parts[1])


def overlapping_documents(spark, sf, k: int) -> DataFrame:
    """The documents of both datasets, ``k`` distinct ones per passage and dataset."""
    parts = [
        document_ranking(spark, sf, k, dim=dim).select("qid", F.lit(f"hash-{dim}").alias("dataset"), F.lit(pos).alias("list_pos"), "doc_id", "rank")
        for pos, dim in enumerate((64, 16))
    ]
    return parts[0].unionByName(parts[1])


def two_width_sql(k: int | None) -> str:
    """Chunk rankings under two widths, as CTEs ``hits(qid, dataset, pos, uri, doc_id, ordinal, rank)``; all chunks without ``k``."""
    parts = []
    for dim in (64, 16):
        parts.append(f"""{sql.bag_cte(f'cb{dim}', 'chunks', 'doc_id, ordinal', 'toks', dim)},
    {sql.bag_cte(f'qb{dim}', 'benchmark', 'item_id', sql.toks('text'), dim)},
    s{dim} AS (SELECT q.item_id AS qid, c.doc_id, c.ordinal,
              round(sum(q.c * c.c) / (any_value(qn.n) * any_value(cn.n)), 6) AS score
       FROM qb{dim} q JOIN cb{dim} c USING (b) JOIN qb{dim}_n qn ON qn.item_id = q.item_id
       JOIN cb{dim}_n cn ON cn.doc_id = c.doc_id AND cn.ordinal = c.ordinal GROUP BY ALL)""")
    rank = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, ordinal)"
    cut = "true" if k is None else f"rank <= {k}"
    parts.append(f"""hits AS (
       SELECT * FROM (SELECT *, 'hash-64' AS dataset, 0 AS pos, {rank} AS rank FROM s64) WHERE {cut}
       UNION ALL SELECT * FROM (SELECT *, 'hash-16' AS dataset, 1 AS pos, {rank} AS rank FROM s16) WHERE {cut})""")
    return f"{sql.chunk_cte()},\n" + ",\n".join(parts)


@query(
    "rrf_fuse_datasets",
    f"""WITH {two_width_sql(20)},
    f AS (SELECT qid, 'doc://' || doc_id AS uri, ordinal, round(sum(1.0 / (60 + rank)), 12) AS rrf,
                 min_by(dataset, (rank, pos)) AS dataset, count(*) AS lists FROM hits GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, uri, ordinal) AS rank FROM f)
    SELECT qid, rank::BIGINT AS rank, dataset, uri, ordinal::BIGINT AS ordinal, round(rrf, 9) AS rrf_score
    FROM o WHERE rank <= 10""",
)
def rrf_fuse_datasets(spark, sf):
    return fuse_datasets(overlapping_hits(spark, sf, 20), 10).select(
        "qid", F.col("rank").cast("long").alias("rank"), "dataset", "uri",
        F.col("ordinal").cast("long").alias("ordinal"), F.round("rrf_score", 9).alias("rrf_score"),
    )


@query(
    "rrf_fuse_documents",
    f"""WITH {two_width_sql(None)},
    d AS (SELECT qid, dataset, doc_id, min(rank) AS chunk_rank FROM hits GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid, dataset ORDER BY chunk_rank) AS rank FROM d),
    f AS (SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 12) AS rrf, min(rank) AS best_rank FROM r WHERE rank <= 10 GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, best_rank, doc_id) AS rank FROM f)
    SELECT qid, doc_id, round(rrf, 9) AS rrf_score, best_rank::BIGINT AS best_rank, rank::BIGINT AS rank FROM o WHERE rank <= 10""",
)
def rrf_fuse_documents(spark, sf):
    return fuse_documents(overlapping_documents(spark, sf, 10), 10).select(
        "qid", "doc_id", F.round("rrf_score", 9).alias("rrf_score"),
        F.col("best_rank").cast("long").alias("best_rank"), F.col("rank").cast("long").alias("rank"),
    )


def _stem_sql(word: str, language: str) -> str:
    for ending, instead in ENDINGS[language]:
        word = f"regexp_replace({word}, '{ending}', '\\1{instead}')"
    return word


def _terms_sql(expr: str, language: str) -> str:
    stops = ", ".join(f"'{w}'" for w in STOPS[language])
    found = rf"list_filter(regexp_extract_all(lower({expr}), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains([{stops}], w))"
    return f"list_transform({found}, lambda w: {_stem_sql('w', language)})"


def _by_language_sql(expr: str, lang: str) -> str:
    cases = " ".join(f"WHEN {lang} = '{m}' THEN {_terms_sql(expr, x)}" for m, x in MARKERS.items() if x != "english")
    return f"CASE {cases} ELSE {_terms_sql(expr, 'english')} END"


BM25_SQL = f"""lex AS (SELECT doc_id, lang, {_by_language_sql('text', 'lang')} AS ts FROM documents WHERE lang IS NOT NULL),
    tot AS (SELECT lang, count(*) AS n, avg(len(ts)) AS avgdl FROM lex GROUP BY lang),
    tf AS (SELECT doc_id, lang, term, count(*) AS tf FROM (SELECT doc_id, lang, unnest(ts) AS term FROM lex) GROUP BY ALL),
    df AS (SELECT lang, term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY ALL),
    qt AS (SELECT item_id AS qid, lang, term, count(*) AS qtf FROM (SELECT item_id, lang, unnest({_by_language_sql('text', 'lang')}) AS term FROM benchmark, (SELECT lang FROM tot)) GROUP BY ALL),
    lexscore AS (
      SELECT qt.qid, tf.doc_id,
             round(sum(qtf * ln(1 + (tot.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.5
                       / (tf.tf + 1.5 * (0.25 + 0.75 * len(lex.ts) / tot.avgdl))), 6) AS score
      FROM qt JOIN tf USING (lang, term) JOIN df USING (lang, term) JOIN lex ON lex.doc_id = tf.doc_id JOIN tot ON tot.lang = lex.lang
      GROUP BY qt.qid, tf.doc_id),
    lexrank AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM lexscore WHERE score > 0)"""


def lexical_corpus():
    """A corpus per language; a document without a language is in none."""
    return F.concat(F.lit("docs_"), "lang")


def lexical_ranking(spark, sf, k: int) -> DataFrame:
    return bm25_topk(
        t.documents(spark, sf).select("doc_id", "text", "lang"),
        t.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text"), k, keys=["doc_id"],
        corpus=lexical_corpus(), per_corpus=False,
    )


@query(
    "bm25_search",
    f"WITH {BM25_SQL} SELECT qid, doc_id, score, rank::BIGINT AS rank FROM lexrank WHERE rank <= 10",
)
def bm25_search(spark, sf):
    return lexical_ranking(spark, sf, 10).select(
        "qid", "doc_id", "score", F.col("rank").cast("long").alias("rank")
    )


@query(
    "bm25_index",
    f"""WITH {BM25_SQL}
    SELECT 'docs_' || lang AS corpus, term, df::BIGINT AS df, cf::BIGINT AS cf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df JOIN tot USING (lang)""",
)
def bm25_index(spark, sf):
    """The index statistics: document and collection frequency and idf of every stem in its corpus."""
    index = PostingsIndex(spark, f"{scratch(spark, 'postings')}/index")
    index.build(t.documents(spark, sf).select("doc_id", "text", "lang"), ["doc_id"], corpus=lexical_corpus(), language=analyzer_of(lexical_corpus()))
    return index.statistics().withColumn("idf", F.round("idf", 6))


DEPTH = 20

HYBRID_SQL = f"""{sql.dense_scores_cte()}, {DOC_RANK_SQL}, {BM25_SQL},
    systems AS (SELECT qid, doc_id, rank FROM docs WHERE rank <= {DEPTH}
                UNION ALL SELECT qid, doc_id, rank FROM lexrank WHERE rank <= {DEPTH}),
    f AS (SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 12) AS rrf, min(rank) AS best_rank FROM systems GROUP BY ALL),
    hyb AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, best_rank, doc_id) AS rank FROM f)"""


def hybrid_ranking(spark, sf, k: int, depth: int = DEPTH) -> DataFrame:
    dense = document_ranking(spark, sf, depth).select("qid", "doc_id", "rank", F.lit("dense").alias("system"))
    lexical = lexical_ranking(spark, sf, depth).select("qid", "doc_id", "rank", F.lit("bm25").alias("system"))
    return fuse_documents(dense.unionByName(lexical), k)


@query(
    "hybrid_search",
    f"""WITH {HYBRID_SQL}
    SELECT qid, doc_id, round(rrf, 9) AS rrf_score, best_rank::BIGINT AS best_rank, rank::BIGINT AS rank FROM hyb WHERE rank <= 10""",
)
def hybrid_search(spark, sf):
    return hybrid_ranking(spark, sf, 10).select(
        "qid", "doc_id", F.round("rrf_score", 9).alias("rrf_score"),
        F.col("best_rank").cast("long").alias("best_rank"), F.col("rank").cast("long").alias("rank"),
    )


def reranked(spark, sf, depth: int = DEPTH) -> DataFrame:
    """The dense shortlist re-ordered by the share of distinct query words its best chunk holds."""
    shortlist = document_ranking(spark, sf, depth)
    wanted = cut_lineage(shortlist.select("qid", "doc_id", "ordinal", "rank"))
    texts = t.chunks_of(spark, sf, wanted.select("doc_id").distinct()).select("doc_id", "ordinal", F.col("text").alias("chunk_text"))
    asked = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query_text"))
    pairs = wanted.join(texts, ["doc_id", "ordinal"]).join(asked, "qid")
    return rerank(pairs, word_overlap(F.col("query_text"), F.col("chunk_text")))


@query(
    "rerank",
    f"""WITH {sql.dense_scores_cte()}, {DOC_RANK_SQL},
    s AS (SELECT d.qid, d.doc_id, d.ordinal, d.rank, list_distinct({sql.toks('lower(b.text)')}) AS qw,
                 list_distinct(list_transform(c.toks, lambda x: lower(x))) AS cw
          FROM docs d JOIN chunks c USING (doc_id, ordinal) JOIN benchmark b ON b.item_id = d.qid WHERE d.rank <= {DEPTH}),
    p AS (SELECT *, round(len(list_intersect(qw, cw))::DOUBLE / len(qw), 6) AS pair_score FROM s)
    SELECT qid, doc_id, ordinal::BIGINT AS ordinal, pair_score, rank::BIGINT AS old_rank,
           row_number() OVER (PARTITION BY qid ORDER BY pair_score DESC, rank)::BIGINT AS new_rank FROM p""",
)
def rerank_shortlist(spark, sf):
    return reranked(spark, sf).select(
        "qid", "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "pair_score",
        F.col("rank").cast("long").alias("old_rank"), F.col("new_rank").cast("long").alias("new_rank"),
    )


@query(
    "recall_vs_exact",
    f"""WITH {two_width_sql(None)},
    d AS (SELECT qid, pos, doc_id, row_number() OVER (PARTITION BY qid, pos ORDER BY min(rank)) AS rank FROM hits GROUP BY qid, pos, doc_id),
    e AS (SELECT qid, doc_id FROM d WHERE pos = 0 AND rank <= 10), c AS (SELECT qid, doc_id FROM d WHERE pos = 1 AND rank <= 10),
    p AS (SELECT e.qid, count(*) AS target, count(c.doc_id) AS found FROM e LEFT JOIN c USING (qid, doc_id) GROUP BY e.qid)
    SELECT count(*)::BIGINT AS queries, round(avg(found::DOUBLE / target), 4) AS recall FROM p""",
)
def recall_of_candidate(spark, sf):
    """How much of the 64-wide top-10 documents the 16-wide ranking keeps."""
    docs = overlapping_documents(spark, sf, 10)
    exact, candidate = (docs.where(F.col("list_pos") == p).select("qid", "doc_id") for p in (0, 1))
    return recall_vs_exact(exact, candidate, "doc_id").select(
        "queries", F.round("recall", 4).alias("recall")
    )


@query(
    "filter_by_collection",
    f"""WITH {sql.dense_scores_cte()},
    r AS (SELECT qid, lang, doc_id, ordinal, score, row_number() OVER (PARTITION BY qid, lang ORDER BY score DESC, doc_id, ordinal) AS rank
          FROM scored WHERE lang IN ('de', 'fr'))
    SELECT qid, lang AS dataset, doc_id, ordinal::BIGINT AS ordinal, score, rank::BIGINT AS rank FROM r WHERE rank <= 5""",
)
def filter_by_collection(spark, sf):
    """A search over the chosen datasets only: the filter reaches the scan."""
    chosen = t.embedded(spark, sf).where(F.col("lang").isin("de", "fr"))
    return exact_topk(
        chosen, t.passages(spark, sf), 5, dim=t.DIM, keys=["doc_id", "ordinal"], segments=["lang"]
    ).select("qid", F.col("lang").alias("dataset"), "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "score",
             F.col("rank").cast("long").alias("rank"))


@query(
    "search_ann_ivf",
    f"""WITH {sql.VECTORS_CTE}, {sql.CLASS_QUERIES_CTE},
    s AS (SELECT qid, vec_id, round({sql.cosine('q', 'v')}, 6) AS score FROM qs, vecs),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT qid::BIGINT AS qid, vec_id, score, rank::BIGINT AS rank FROM r WHERE rank <= 10""",
)
def search_ann_ivf(spark, sf):
    """The stored index with every cell probed: what it files must be found again, so it equals the exact ranking."""
    got = ivf_topk(t.vectors(spark, sf), t.class_queries(spark, sf), 10, key="vec_id", cells=16, nprobes=16)
    return got.select(F.col("qid").cast("long").alias("qid"), "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query("search_ann_ivf_probed")
def search_ann_ivf_probed(spark, sf):
    """A quarter of the cells probed, with the exact recall beside the answers."""
    return _with_recall(
        ivf_topk(t.vectors(spark, sf), t.class_queries(spark, sf), 10, key="vec_id", cells=16, nprobes=4), spark, sf
    )


def _with_recall(answers: DataFrame, spark, sf) -> DataFrame:
    exact = class_ranking(spark, sf, 10).select("qid", "vec_id")
    recall = recall_vs_exact(exact, answers.select("qid", "vec_id"), "vec_id").select("recall")
    return answers.select("qid", "vec_id", "score", "rank").withColumn("recall_vs_exact", recall.scalar())


@query(
    "ann_preset_resolve",
    """WITH c AS (SELECT lang AS collection, count(*) AS docs, sum(ceil(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) / 64.0))::BIGINT AS n
                  FROM documents GROUP BY lang),
    p(store, recall, nprobes, refine_factor, ef_search) AS (VALUES
      ('lancedb','fast',10,NULL,NULL),('lancedb','balanced',10,5,NULL),('lancedb','accurate',40,10,NULL),
      ('pgvector','fast',NULL,NULL,20),('pgvector','balanced',NULL,NULL,NULL),('pgvector','accurate',NULL,NULL,200),
      ('mariadb','fast',NULL,NULL,20),('mariadb','balanced',NULL,NULL,NULL),('mariadb','accurate',NULL,NULL,200))
    SELECT collection, n AS chunks, CASE WHEN n >= 1000 THEN 'approximate' ELSE 'exact' END AS mode, store, recall,
           CASE WHEN store = 'lancedb' THEN 25 ELSE nprobes END::INT AS nprobes, refine_factor::INT AS refine_factor, ef_search::INT AS ef_search
    FROM c, p""",
)
def ann_preset_resolve(spark, sf):
    """Each language collection's search mode and the knobs every store would get for it."""
    sizes = t.chunks(spark, sf).groupBy(F.col("lang").alias("collection")).agg(F.count("*").alias("chunks"))
    knobs = []
    for store, recall in PRESETS:
        got = resolve_params(store, recall, AnnParams(nprobes=25 if store == "lancedb" else None))
        knobs.append(F.struct(
            F.lit(store).alias("store"), F.lit(recall).alias("recall"),
            *[F.lit(getattr(got, f)).cast("int").alias(f) for f in ("nprobes", "refine_factor", "ef_search")],
        ))
    return sizes.withColumn("mode", search_mode(F.col("chunks"), 1000)).select(
        "collection", "chunks", "mode", F.inline(F.array(*knobs))
    )
