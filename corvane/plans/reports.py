"""Report plans: product depth, query length, twins, gates, claims, samples, joins and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import token_count, word_tokens
from corvane.operators import effects as E
from corvane.operators import measure, sampling
from corvane.operators import metrics as M
from corvane.operators import stats as S
from corvane.operators.ann import ivf_topk
from corvane.operators.chunking import chunk_whitespace, mark_headings
from corvane.operators.claims import Claim, check_file, derive, select
from corvane.operators.embed import hash_embedder
from corvane.operators.extract import extract_html
from corvane.operators.gate import compare_runs, merge_newest, paired_verdicts
from corvane.operators.sanitize import sanitize
from corvane.operators.topk import exact_topk
from corvane.plans import evaluation as ev
from corvane.plans import hygiene, search, sql
from corvane.plans import tables as t
from corvane.plans.registry import query
from corvane.session import cut_lineage

L = "long"

# -- product depth ---------------------------------------------------------------------------------

BUDGETS = (1280, 2560)
PRODUCT_K = 5
RUNGS = (5, 20, 40)  # the product's k, and each budget over the 64-token cap


@query("agg_rungs", """WITH c AS (SELECT DISTINCT CASE lang WHEN 'en' THEN 64 WHEN 'de' THEN 128 WHEN 'fr' THEN 100 ELSE 512 END AS cap FROM documents),
    r AS (SELECT cap, 5 AS k, NULL::INT AS budget FROM c UNION ALL SELECT cap, b // cap, b FROM c, (VALUES (1280), (2560)) x(b) WHERE cap IN (64, 128, 256, 512) AND b // cap >= 1)
    SELECT cap::BIGINT AS cap, k::BIGINT AS k, coalesce(string_agg(budget::VARCHAR, ',' ORDER BY budget), '') AS budgets, k = 5 AS product FROM r GROUP BY cap, k""")
def agg_rungs(spark, sf):
    caps = t.documents(spark, sf).select(
        F.when(F.col("lang") == "en", 64).when(F.col("lang") == "de", 128).when(F.col("lang") == "fr", 100).otherwise(512).alias("cap")
    ).distinct()
    got = M.rungs_for_cap(caps, PRODUCT_K, BUDGETS, (64, 128, 256, 512))
    return got.select(F.col("cap").cast(L).alias("cap"), F.col("k").cast(L).alias("k"), "budgets", "product")


def product_views(spark, sf) -> DataFrame:
    deep = max(RUNGS)
    qrels = ev.passage_qrels(spark, sf).select("qid", "doc_id", "rel")
    queries = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))
    return M.delivered_views(search.chunk_ranking(spark, sf, deep), search.document_ranking(spark, sf, deep), qrels, queries, RUNGS)


VIEWS_SQL = f"""{ev.QRELS_SQL}, {sql.dense_scores_cte()},
    ranked AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, ordinal) AS rank FROM scored),
    fst AS (SELECT qid, doc_id, min(rank) AS rank FROM ranked GROUP BY ALL),
    dr AS (SELECT f.*, row_number() OVER (PARTITION BY f.qid ORDER BY f.rank) AS doc_rank, coalesce(q.rel, 0) AS rel FROM fst f LEFT JOIN qrels q USING (qid, doc_id)),
    ks AS (SELECT * FROM (VALUES (5), (20), (40)) x(k)),
    byk AS (SELECT qid, k, sum(CASE WHEN rank <= k THEN rel / log2(rank + 1) ELSE 0 END) AS dd, sum(rel / log2(doc_rank + 1)) AS dc, count(*) FILTER (rank <= k) AS distinct_docs FROM dr, ks WHERE doc_rank <= k GROUP BY ALL),
    idl AS (SELECT qid, k, sum(rel / log2(nth + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS nth FROM qrels), ks WHERE nth <= k GROUP BY ALL),
    views AS (SELECT b.item_id AS qid, ks.k, round(coalesce(dd / ideal, 0), 9) AS delivered, round(coalesce(dc / ideal, 0), 9) AS documents, coalesce(distinct_docs, 0)::DOUBLE AS distinct_docs
              FROM benchmark b CROSS JOIN ks LEFT JOIN byk ON byk.qid = b.item_id AND byk.k = ks.k LEFT JOIN idl ON idl.qid = b.item_id AND idl.k = ks.k)"""

for _view, _name in (("delivered", "agg_ndcg_delivered"), ("documents", "agg_ndcg_documents"), ("distinct_docs", "agg_distinct_docs")):

    def _view_plan(spark, sf, view=_view):
        return product_views(spark, sf).select("qid", F.col("k").cast(L).alias("k"), F.round(view, 6).alias(view))

    query(_name, f"WITH {VIEWS_SQL} SELECT qid, k::BIGINT AS k, round({_view}, 6) AS {_view} FROM views")(_view_plan)


@query("agg_product_k", f"""WITH {VIEWS_SQL} SELECT k::BIGINT AS k, k = 5 AS product, count(*)::BIGINT AS n, round(avg(delivered), 6) AS delivered, round(avg(documents), 6) AS documents, round(avg(distinct_docs), 6) AS distinct_docs,
    round(avg(documents - delivered), 6) AS gap, count(*) FILTER (documents - delivered > 1e-9)::BIGINT AS wins, count(*) FILTER (documents - delivered < -1e-9)::BIGINT AS losses FROM views GROUP BY k""")
def agg_product_k(spark, sf):
    gap = F.col("documents") - F.col("delivered")
    return product_views(spark, sf).groupBy(F.col("k").cast(L).alias("k")).agg(
        (F.first("k") == PRODUCT_K).alias("product"), F.count("*").alias("n"),
        *[F.round(F.avg(c), 6).alias(c) for c in ("delivered", "documents", "distinct_docs")],
        F.round(F.avg(gap), 6).alias("gap"), F.count_if(gap > 1e-9).alias("wins"), F.count_if(gap < -1e-9).alias("losses"),
    )


# -- query length ----------------------------------------------------------------------------------

WORDS_SQL = f"wc AS (SELECT item_id AS qid, len({sql.toks('text')}) AS words FROM benchmark)"


def query_words(spark, sf) -> DataFrame:
    return t.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), token_count(F.col("text")).alias("words"))


@query("agg_query_shape", f"""WITH {WORDS_SQL} SELECT count(*)::BIGINT AS n, quantile_cont(words, 0.25)::DOUBLE AS p25, quantile_cont(words, 0.5)::DOUBLE AS p50, quantile_cont(words, 0.75)::DOUBLE AS p75, quantile_cont(words, 0.9)::DOUBLE AS p90, max(words)::BIGINT AS longest FROM wc""")
def agg_query_shape(spark, sf):
    return query_words(spark, sf).agg(
        F.count("*").alias("n"), *[F.percentile("words", q).alias(f"p{round(q * 100)}") for q in (0.25, 0.5, 0.75, 0.9)], F.max("words").cast(L).alias("longest")
    )


BINS = 4
SHORT = 25
EDGES_SQL = f"""{WORDS_SQL}, ed AS (SELECT {", ".join(f"trunc(quantile_cont(words, {i / BINS}))::INT AS e{i}" for i in range(BINS + 1))} FROM wc),
    bn AS ({" UNION ALL ".join(f"SELECT qid, words, 'Q{i + 1}' AS bin, e{i} AS words_lo, e{i + 1} AS words_hi FROM wc, ed WHERE words >= e{i} AND words {'<=' if i == BINS - 1 else '<'} e{i + 1}" for i in range(BINS))}
      UNION ALL SELECT qid, words, 'all', e0, e{BINS} FROM wc, ed UNION ALL SELECT qid, words, '<= {SHORT} words', 0, {SHORT} FROM wc WHERE words <= {SHORT})"""


def binned_words(spark, sf) -> DataFrame:
    words = query_words(spark, sf)
    return sampling.bins_of(words, "words", sampling.quantile_edges(words, "words", BINS), SHORT)


@query("quantile_bins", f"WITH {EDGES_SQL} SELECT qid, words::BIGINT AS words, bin, words_lo::BIGINT AS words_lo, words_hi::BIGINT AS words_hi FROM bn")
def quantile_bins(spark, sf):
    return binned_words(spark, sf).select("qid", F.col("words").cast(L).alias("words"), "bin", F.col("words_lo").cast(L).alias("words_lo"), F.col("words_hi").cast(L).alias("words_hi"))


_DELTA_OUT = "round(avg(delta), 4) AS mean_delta, count(*) FILTER (delta > 0)::BIGINT AS wins, count(*) FILTER (delta = 0)::BIGINT AS ties, count(*) FILTER (delta < 0)::BIGINT AS losses, count(*)::BIGINT AS n_shared"


def _delta_out(rows: DataFrame, by: list) -> DataFrame:
    d = F.col("delta")
    return rows.groupBy(*by).agg(
        F.round(F.avg(d), 4).alias("mean_delta"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), F.count("*").alias("n_shared")
    )


def overlap_deltas(scores: DataFrame) -> DataFrame:
    """Per query, the widest overlap minus none, at the small cap; both sit in the query's rows."""
    rows = scores.where((F.col("max_tokens") == 64) & F.col("method").isNull() & F.col("overlap_tokens").isin(0, 32))
    high = F.max(F.when(F.col("overlap_tokens") == 32, F.col("ndcg")))
    low = F.max(F.when(F.col("overlap_tokens") == 0, F.col("ndcg")))
    return rows.groupBy("corpus", "embedding", "qid").agg(F.round(high - low, 9).alias("delta"))


OV_SQL = """ovd AS (SELECT corpus, 'hash-' || dim AS embedding, qid, round(max(ndcg) FILTER (ov = 32) - max(ndcg) FILTER (ov = 0), 9) AS delta FROM plain WHERE cap = 64 AND ov IN (0, 32) GROUP BY ALL)"""


@query("agg_by_query_length", f"WITH {ev.PLAIN_SQL}, {OV_SQL}, {EDGES_SQL} SELECT corpus, embedding, bin, words_lo::BIGINT AS words_lo, words_hi::BIGINT AS words_hi, {_DELTA_OUT} FROM ovd JOIN bn USING (qid) GROUP BY corpus, embedding, bin, words_lo, words_hi")
def agg_by_query_length(spark, sf):
    bins = binned_words(spark, sf).drop("words")
    rows = overlap_deltas(ev.scores(spark, sf)).join(bins, "qid")
    return _delta_out(rows, ["corpus", "embedding", "bin", F.col("words_lo").cast(L).alias("words_lo"), F.col("words_hi").cast(L).alias("words_hi")])


CUT_WORDS = 8
CUT_SQL = f"""{ev._grid_sql(CUT_WORDS)},
    asked AS (SELECT dim, cap, ov, corpus, item_id AS qid FROM (VALUES (16), (64)) d(dim), g, {ev._LANGS}, benchmark),
    {ev._metrics_sql('plain', 'granked', 'dim, cap, ov', 'asked')}, {OV_SQL}"""


@query("agg_truncation_effect", f"SELECT 'full' AS queries, corpus, embedding, {_DELTA_OUT} FROM (WITH {ev.PLAIN_SQL}, {OV_SQL} SELECT * FROM ovd) GROUP BY corpus, embedding UNION ALL SELECT 'truncated', corpus, embedding, {_DELTA_OUT} FROM (WITH {CUT_SQL} SELECT * FROM ovd) GROUP BY corpus, embedding")
def agg_truncation_effect(spark, sf):
    """What overlap buys with whole queries, and with the same queries cut to eight words."""
    parts = []
    for name, rows in (("full", ev.scores(spark, sf)), ("truncated", ev.sweep_scores(spark, sf, CUT_WORDS))):
        parts.append(_delta_out(overlap_deltas(rows), [F.lit(name).alias("queries"), "corpus", "embedding"]))
    return parts[0].unionByName(parts[1])


def twin_scores(spark, sf, marked: bool) -> DataFrame:
    docs = t.documents(spark, sf).select("doc_id", F.concat(F.lit("docs_"), "lang").alias("corpus"), (mark_headings(F.col("text")) if marked else F.col("text")).alias("text"))
    chunks = chunk_whitespace(docs, t.CAP).withColumn("vector", hash_embedder(t.DIM, "md5")(F.col("text")))
    ranked = exact_topk(chunks, t.passages(spark, sf), ev.K, dim=t.DIM, keys=["doc_id", "ordinal"], segments=["corpus"], unique=["doc_id"])
    asked = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array(*[F.lit(c) for c in ev.corpora(spark, sf)])).alias("corpus"))
    return M.per_query_metrics(ranked, ev.passage_qrels(spark, sf), asked, ev.K, segments=["corpus"], decimals=6)


def _twin_sql(name: str, src: str) -> str:
    return f"""{sql.chunk_cte(f'{name}_c', src=src, cols='doc_id, lang')},
    {sql.bag_cte(f'{name}_b', f'{name}_c', 'doc_id, lang, ordinal', 'toks', 64)},
    {name}_s AS (SELECT q.item_id AS qid, 'docs_' || c.lang AS corpus, c.doc_id, c.ordinal, round(sum(q.c * c.c) / (any_value(qn.n) * any_value(cn.n)), 6) AS score
      FROM qbag q JOIN {name}_b c USING (b) JOIN qbag_n qn ON qn.item_id = q.item_id JOIN {name}_b_n cn ON cn.doc_id = c.doc_id AND cn.ordinal = c.ordinal GROUP BY q.item_id, c.lang, c.doc_id, c.ordinal),
    {name}_r AS (SELECT 0 AS one, *, row_number() OVER (PARTITION BY qid, corpus ORDER BY score DESC, doc_id, ordinal) AS rank FROM (SELECT qid, corpus, doc_id, max(score) AS score, min_by(ordinal, (-score, ordinal)) AS ordinal FROM {name}_s GROUP BY ALL)),
    {name}_a AS (SELECT 0 AS one, corpus, item_id AS qid FROM {ev._LANGS}, benchmark),
    {ev._metrics_sql(name, f'{name}_r', 'one', f'{name}_a')}"""


@query("agg_twin_pair", f"""WITH {ev.QRELS_SQL}, {hygiene.HEADING_SQL}, {sql.query_bag_cte(64)}, {_twin_sql('tw_plain', 'documents')}, {_twin_sql('tw_mark', 'marked')},
    tw AS (SELECT corpus, qid, round(m.ndcg - p.ndcg, 9) AS delta FROM tw_mark m JOIN tw_plain p USING (corpus, qid)) SELECT corpus, {_DELTA_OUT} FROM tw GROUP BY corpus""")
def agg_twin_pair(spark, sf):
    """Marked minus unmarked headings; the twins must have scored the very same queries."""
    plain = twin_scores(spark, sf, False).select("corpus", "qid", F.col("ndcg").alias("_p"))
    marked = twin_scores(spark, sf, True).select("corpus", "qid", F.col("ndcg").alias("_m"))
    both = plain.join(marked, ["corpus", "qid"], "full_outer")
    odd = F.col("_p").isNull() | F.col("_m").isNull()
    delta = F.when(odd, F.raise_error(F.lit("the twins scored different queries")).cast("double")).otherwise(F.round(F.col("_m") - F.col("_p"), 9))
    return _delta_out(both.withColumn("delta", delta), ["corpus"])


# -- gates -----------------------------------------------------------------------------------------


def runs(spark, sf):
    """A baseline run (overlap 0 and 16) and a current one (overlap 16 and 32, narrower vectors)."""
    long = ev.scores(spark, sf).where("method IS NULL").select(
        F.concat_ws("__", "corpus", "profile").alias("combo"), "embedding", "overlap_tokens", "qid",
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ev.METRICS])),
    )
    base = long.where((F.col("embedding") == "hash-64") & F.col("overlap_tokens").isin(0, 16))
    current = long.where((F.col("embedding") == "hash-16") & F.col("overlap_tokens").isin(16, 32))
    return base.select("combo", "metric", "qid", "value"), current.select("combo", "metric", "qid", "value")


_MET = " UNION ALL ".join(f"SELECT corpus || '__whitespace-t' || cap || '-o' || ov || '-word' AS combo, dim, ov, qid, '{m}' AS metric, {m} AS value FROM plain" for m in ev.METRICS)
GATE_SQL = f"""{ev.PLAIN_SQL}, lng AS ({_MET}), gb AS (SELECT * FROM lng WHERE dim = 64 AND ov IN (0, 16)), gc AS (SELECT * FROM lng WHERE dim = 16 AND ov IN (16, 32)),
    gp AS (SELECT combo, metric, round(avg(round(c.value - b.value, 9)), 6) AS mean_delta, count(*) FILTER (round(c.value - b.value, 9) < 0) AS worse, count(*) FILTER (round(c.value - b.value, 9) > 0) AS better, count(*) AS n
           FROM gb b JOIN gc c USING (combo, metric, qid) GROUP BY ALL),
    gv AS (SELECT *, mean_delta < -0.005 AND worse > better AS regressed FROM gp)"""


@query("gate_paired", f"WITH {GATE_SQL} SELECT combo, metric, mean_delta, worse::BIGINT AS worse, better::BIGINT AS better, n::BIGINT AS n, regressed FROM gv")
def gate_paired(spark, sf):
    return paired_verdicts(*runs(spark, sf))


def _run_status(rows: DataFrame) -> DataFrame:
    found = F.max(F.when(F.col("metric") == "recall", F.col("value")))
    return rows.groupBy("combo").agg(F.when(found > 0, "ok").otherwise("empty").alias("status"))


@query("gate_compare", f"""WITH {GATE_SQL},
    sb AS (SELECT combo, CASE WHEN max(value) FILTER (metric = 'recall') > 0 THEN 'ok' ELSE 'empty' END AS s FROM gb GROUP BY combo), sc AS (SELECT combo, CASE WHEN max(value) FILTER (metric = 'recall') > 0 THEN 'ok' ELSE 'empty' END AS s FROM gc GROUP BY combo),
    dr AS (SELECT combo, count(*) FILTER (regressed) AS dropped FROM gv GROUP BY combo)
    SELECT coalesce(sb.combo, sc.combo) AS combo, CASE WHEN sb.combo IS NULL THEN 'new' WHEN sc.combo IS NULL THEN 'not_run' WHEN sb.s = 'ok' AND sc.s <> 'ok' THEN 'regressions' WHEN dropped > 0 THEN 'regressions' ELSE 'ok' END AS bucket,
           coalesce(dropped, 0)::BIGINT AS dropped FROM sb FULL JOIN sc ON sb.combo = sc.combo LEFT JOIN dr ON dr.combo = coalesce(sb.combo, sc.combo)""")
def gate_compare(spark, sf):
    base, current = runs(spark, sf)
    means = [r.groupBy("combo", "metric").agg(F.avg("value").alias("value")) for r in (base, current)]
    return compare_runs(_run_status(base), _run_status(current), *means, paired_verdicts(base, current))


@query("gate_merge", f"""WITH {GATE_SQL}, b AS (SELECT combo, round(avg(value), 4) AS ndcg FROM gb WHERE metric = 'ndcg' GROUP BY combo), c AS (SELECT combo, round(avg(value), 4) AS ndcg FROM gc WHERE metric = 'ndcg' GROUP BY combo)
    SELECT coalesce(b.combo, c.combo) AS combo, coalesce(c.ndcg, b.ndcg) AS ndcg, CASE WHEN c.combo IS NULL THEN 'earlier' ELSE 'today' END AS measured_utc, CASE WHEN b.combo IS NULL THEN 'new' WHEN c.combo IS NULL THEN 'kept' ELSE 'updated' END AS origin
    FROM b FULL JOIN c ON b.combo = c.combo""")
def gate_merge(spark, sf):
    base, current = (
        r.where("metric = 'ndcg'").groupBy("combo").agg(F.round(F.avg("value"), 4).alias("ndcg")).withColumn("measured_utc", F.lit(None).cast("string"))
        for r in runs(spark, sf)
    )
    return merge_newest(base, current, "combo", "measured_utc", F.lit("earlier"), F.lit("today"))


# -- claims ----------------------------------------------------------------------------------------

SETS = {"romance": ["fr", "es"]}


def claim_rows(spark, sf) -> DataFrame:
    """Documents as result rows: nested fields, a list field and a derived name."""
    docs = t.documents(spark, sf).join(t.table(spark, sf, "labels"), "doc_id", "left")
    return docs.select(
        "doc_id", "n_chars", "quality", F.struct("lang", "source").alias("held"), F.array("lang", "source").alias("levels"),
        F.when(F.col("quality") == 1, F.concat(F.lit("doc:"), F.col("doc_id").cast("string"), F.lit("+good"))).otherwise(F.lit("doc:?")).alias("name"),
    )


def _predicate(name: str, where: dict, condition_sql: str) -> None:
    def plan(spark, sf):
        return select(claim_rows(spark, sf), where, SETS).select("doc_id", "n_chars")

    query(name, f"SELECT doc_id, n_chars FROM documents LEFT JOIN labels USING (doc_id) WHERE {condition_sql}")(plan)


_predicate("pred_eq", {"quality": 1}, "quality = 1")
_predicate("pred_in", {"held.lang": "@romance"}, "lang IN ('fr', 'es')")
_predicate("pred_contains", {"levels": "src3"}, "source = 'src3'")
_predicate("pred_relative", {"name": {"field": "doc_id", "prefix": "doc:", "suffix": "+good"}}, "quality = 1")
_predicate("pred_and", {"held.lang": ["en", "de"], "quality": 0, "levels": "src3"}, "lang IN ('en', 'de') AND quality = 0 AND source = 'src3'")


@query("proj_dotted", "SELECT doc_id, lang AS held_lang, source AS held_source FROM documents")
def proj_dotted(spark, sf):
    return claim_rows(spark, sf).select("doc_id", F.col("held.lang").alias("held_lang"), F.col("held.source").alias("held_source"))


@query("proj_round", """WITH c AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS cents FROM orders)
    SELECT o_orderkey, ((cents // 1000 + (cents % 1000 > 500 OR (cents % 1000 = 500 AND (cents // 1000) % 2 = 1))::INT) / 100)::DOUBLE AS rounded FROM c""")
def proj_round(spark, sf):
    """Half-even rounding to fixed places, on decimals, where a half is a half."""
    exact = F.col("o_totalprice").cast("decimal(18,2)").cast("decimal(24,5)") / 1000
    return t.table(spark, sf, "orders").select("o_orderkey", F.bround(exact, 2).cast("double").alias("rounded"))


def claim_cells(spark, sf) -> DataFrame:
    """Per language and source: documents and characters (the rows the figures are about)."""
    return t.documents(spark, sf).groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars")).withColumn(
        "key", F.concat_ws("/", "lang", "source")
    )


CLAIMS = (
    Claim("count", "count", {"lang": "en"}, published="20"),
    Claim("sum", "sum", {"lang": "@romance"}, "docs", published="251"),
    Claim("mean", "mean", {"lang": "de"}, "chars", scale=0.001, published="17"),
    Claim("min", "min", {}, "chars", transform="negate", published="-0"),
    Claim("max", "max", {"lang": ["en", "de"]}, "docs", transform="abs", published="forty"),
    Claim("value", "value", {"key": "en/src3"}, "docs", published="thirty"),
    Claim("ratio", "ratio", {"key": "en/src1"}, "chars", {"key": "en/src2"}, published="1.0"),
    Claim("difference", "difference", {"key": "en/src1"}, "docs", {"key": "en/src2"}, published="0"),
    Claim("percent_change", "percent_change", {"key": "en/src1"}, "chars", {"key": "en/src2"}, "chars", published="+10.0"),
)

CLAIMS_SQL = """cc AS (SELECT lang, source, lang || '/' || source AS key, count(*) AS docs, sum(n_chars) AS chars FROM documents GROUP BY ALL),
    one AS (SELECT max(chars) FILTER (key = 'en/src1') AS c1, max(chars) FILTER (key = 'en/src2') AS c2, max(docs) FILTER (key = 'en/src1') AS d1, max(docs) FILTER (key = 'en/src2') AS d2 FROM cc),
    dv AS (SELECT 'count' AS id, count(*) FILTER (lang = 'en')::DOUBLE AS d, 20.0 AS p, 0.5 AS tol FROM cc UNION ALL SELECT 'sum', sum(docs) FILTER (lang IN ('fr', 'es')), 251, 0.5 FROM cc
      UNION ALL SELECT 'mean', avg(chars) FILTER (lang = 'de') * 0.001, 17, 0.5 FROM cc UNION ALL SELECT 'min', min(-chars), 0, 0.5 FROM cc
      UNION ALL SELECT 'max', max(abs(docs)) FILTER (lang IN ('en', 'de')), NULL, NULL FROM cc UNION ALL SELECT 'value', max(docs) FILTER (key = 'en/src3'), NULL, NULL FROM cc
      UNION ALL SELECT 'ratio', c1 / c2, 1.0, 0.05 FROM one UNION ALL SELECT 'difference', d1 - d2, 0, 0.5 FROM one UNION ALL SELECT 'percent_change', (c1 - c2) / c2 * 100, 10, 0.05 FROM one)"""


@query("claim", f"WITH {CLAIMS_SQL} SELECT id, round(d, 6) AS derived, CASE WHEN p IS NULL THEN NULL ELSE abs(d - p) <= tol * (1 + 1e-6) END AS ok FROM dv")
def claim_plan(spark, sf):
    """Every reducer once, over one scan of one rowset."""
    got = derive(claim_cells(spark, sf), CLAIMS, SETS)
    return got.select("id", F.round("derived", 6).alias("derived"), "ok")


CLAIM_FILE = {
    "sets": SETS,
    "rowsets": {
        "groups": {"source": "groups.json", "path": "rows"}, "facts": {"source": "groups.json", "path": "facts"}, "labels": {"source": "labels.json"},
        "steps": {"source": "steps.json", "path": "effects", "orient": True},
    },
    "claim": [
        {"id": "english", "rows": "groups", "reduce": "count", "where": {"lang": "en"}, "published": "20"},
        {"id": "romance", "rows": "groups", "reduce": "sum", "where": {"lang": "@romance"}, "field": "docs", "published": "251"},
        {"id": "total", "rows": "facts", "reduce": "value", "field": "docs", "published": "1,000"},
        {"id": "judged", "rows": "labels", "reduce": "sum", "field": "judged", "published": "399"},
        {"id": "share", "rows": "labels", "reduce": "ratio", "where": {"quality": 1}, "field": "judged", "against_rows": "facts", "against": {}, "against_field": "docs", "published": "0.3"},
        {"id": "gained", "rows": "steps", "reduce": "sum", "field": "mean_delta", "published": "0"},
        {"id": "forward", "rows": "steps", "reduce": "count", "where": {"from_level": "en"}, "published": "1"},
    ],
}


def _steps(spark, sf) -> DataFrame:
    """Mean lengths of neighbouring languages as comparisons that run high to low."""
    means = t.documents(spark, sf).where("lang IS NOT NULL").groupBy("lang").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.count("*").alias("n"))
    a, b = (means.select(F.col("lang").alias(f"l{x}"), F.col("mean").alias(f"m{x}"), F.col("n").alias(f"n{x}")) for x in "ab")  # a row per language
    return a.join(b, F.col("la") > F.col("lb")).select(
        F.lit("lang").alias("axis"), F.col("la").alias("from_level"), F.col("lb").alias("to_level"), (F.col("mb") - F.col("ma")).alias("mean_delta"),
        (F.col("mb") - F.col("ma") - 1).alias("ci_lo"), (F.col("mb") - F.col("ma") + 1).alias("ci_hi"), F.col("na").alias("wins"), F.col("nb").alias("losses"),
    )


@query("claim_file", f"""WITH {CLAIMS_SQL}, m AS (SELECT lang, round(avg(n_chars), 6) AS mean FROM documents WHERE lang IS NOT NULL GROUP BY lang),
    st AS (SELECT b.lang AS lo, a.mean - b.mean AS delta FROM m a JOIN m b ON a.lang > b.lang), j AS (SELECT quality, count(*) AS judged FROM labels GROUP BY quality),
    x AS (SELECT 'groups' AS rows, 'english' AS id, count(*) FILTER (lang = 'en')::DOUBLE AS d, 20.0 AS p, 0.5 AS tol FROM cc UNION ALL SELECT 'groups', 'romance', sum(docs) FILTER (lang IN ('fr', 'es')), 251, 0.5 FROM cc
      UNION ALL SELECT 'facts', 'total', count(*), 1000, 0.5 FROM documents UNION ALL SELECT 'labels', 'judged', sum(judged), 399, 0.5 FROM j
      UNION ALL SELECT 'labels', 'share', max(judged) FILTER (quality = 1) / (SELECT count(*) FROM documents), 0.3, 0.05 FROM j
      UNION ALL SELECT 'steps', 'gained', sum(delta), 0, 0.5 FROM st UNION ALL SELECT 'steps', 'forward', count(*) FILTER (lo = 'en'), 1, 0.5 FROM st)
    SELECT rows, id, round(d, 4) AS derived, abs(d - p) <= tol * (1 + 1e-6) AS ok FROM x""")
def claim_file(spark, sf):
    """A claim file over three raw JSON files: a list, a table of facts, a whole document, and comparisons turned low to high."""
    folder = hygiene.scratch(spark, "claims")
    facts = t.documents(spark, sf).agg(F.count("*").alias("docs"))
    rows = claim_cells(spark, sf).agg(F.sort_array(F.collect_list(F.struct("key", "lang", "source", "docs", "chars"))).alias("rows"))  # a row per language and source
    rows.select("rows", F.struct(facts.scalar().alias("docs")).alias("facts")).coalesce(1).write.json(f"{folder}/groups.json")
    judged = t.table(spark, sf, "labels").groupBy("quality").agg(F.count("*").alias("judged"))
    judged.agg(F.to_json(F.collect_list(F.struct("quality", "judged"))).alias("value")).write.text(f"{folder}/labels.json")
    _steps(spark, sf).agg(F.collect_list(F.struct("*")).alias("effects")).coalesce(1).write.json(f"{folder}/steps.json")
    return check_file(spark, CLAIM_FILE, folder).select("rows", "id", F.round("derived", 4).alias("derived"), "ok")


for _how in ("count", "sum", "mean", "min", "max", "value", "ratio", "difference", "percent_change"):

    def _reducer(spark, sf, how=_how):
        got = derive(claim_cells(spark, sf), [c for c in CLAIMS if c.id == how], SETS)
        return got.select("id", F.round("derived", 6).alias("derived"))

    query(f"agg_{_how}", f"WITH {CLAIMS_SQL} SELECT id, round(d, 6) AS derived FROM dv WHERE id = '{_how}'")(_reducer)


# -- joins and sets ---------------------------------------------------------------------------------


@query("join_inner_shared", "SELECT doc_id, quality::BIGINT AS quality, n_chars FROM documents JOIN labels USING (doc_id)")
def join_inner_shared(spark, sf):
    return t.documents(spark, sf).select("doc_id", "n_chars").join(t.table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("quality").cast(L).alias("quality"), "n_chars")


@query("join_left_qrels", f"WITH {ev.QRELS_SQL} SELECT item_id AS qid, count(doc_id)::BIGINT AS relevant FROM benchmark LEFT JOIN qrels ON qid = item_id GROUP BY item_id")
def join_left_qrels(spark, sf):
    """Judgements per query; a query without any keeps its row."""
    asked = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))
    return asked.join(ev.passage_qrels(spark, sf).select("qid", "doc_id"), "qid", "left").groupBy("qid").agg(F.count("doc_id").alias("relevant"))


@query("join_anti_vanished", "WITH h AS (SELECT sha256(text) AS content_hash, doc_id, source FROM documents) SELECT doc_id, source FROM h ANTI JOIN labels USING (doc_id)")
def join_anti_vanished(spark, sf):
    return t.documents(spark, sf).select("doc_id", "source").join(t.table(spark, sf, "labels"), "doc_id", "left_anti")


@query("join_semi_judged", "SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)")
def join_semi_judged(spark, sf):
    return t.documents(spark, sf).select("doc_id", "source").join(t.table(spark, sf, "labels"), "doc_id", "left_semi")


@query("join_merge_newest", "SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, coalesce(l.quality, d.n_chars)::BIGINT AS value, CASE WHEN l.doc_id IS NULL THEN 'old' ELSE 'new' END AS origin FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id")
def join_merge_newest(spark, sf):
    old = t.documents(spark, sf).select("doc_id", F.col("n_chars").alias("_old"))
    new = t.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("_new"))
    return old.join(new, "doc_id", "full_outer").select(
        "doc_id", F.coalesce("_new", "_old").cast(L).alias("value"), F.when(F.col("_new").isNull(), "old").otherwise("new").alias("origin")
    )


@query("join_theta_axes", f"WITH {ev.EFFECTS_SQL} SELECT axis, corpus, from_cell, to_cell FROM named")
def join_theta_axes(spark, sf):
    return E.one_axis_pairs(ev.cells(spark, sf)).select("axis", "corpus", "from_cell", "to_cell")


@query("set_union_lists", "SELECT lang AS list, doc_id FROM documents WHERE lang = 'de' UNION ALL SELECT source, doc_id FROM documents WHERE source = 'src1'")
def set_union_lists(spark, sf):
    docs = t.documents(spark, sf)
    return docs.where("lang = 'de'").select(F.col("lang").alias("list"), "doc_id").unionByName(docs.where("source = 'src1'").select(F.col("source").alias("list"), "doc_id"))


@query("set_distinct", "SELECT DISTINCT sha256(text) AS content_hash FROM documents")
def set_distinct(spark, sf):
    return t.documents(spark, sf).select(F.sha2("text", 256).alias("content_hash")).distinct()


@query("set_intersect", "SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def set_intersect(spark, sf):
    return t.documents(spark, sf).where("lang = 'en'").select("doc_id").intersect(t.table(spark, sf, "labels").where("quality = 1").select("doc_id"))


@query("set_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark, sf):
    return t.documents(spark, sf).select("doc_id").exceptAll(t.table(spark, sf, "labels").select("doc_id"))


# -- samples ---------------------------------------------------------------------------------------

BUDGET = 150


@query("sample_slice", f"""WITH k AS (SELECT doc_id FROM labels WHERE toxic = 1), o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k))
    SELECT doc_id, TRUE AS judged FROM documents SEMI JOIN k USING (doc_id) UNION ALL SELECT doc_id, FALSE FROM o WHERE n <= greatest(0, {BUDGET} - (SELECT count(*) FROM documents SEMI JOIN k USING (doc_id)))""")
def sample_slice(spark, sf):
    """A slice of exactly the budget: every judged (toxic) document, and others drawn by hash."""
    judged = t.table(spark, sf, "labels").where("toxic = 1")
    return sampling.slice_corpus(t.documents(spark, sf).select("doc_id"), judged, BUDGET)


@query("sample_stratified", """WITH r AS (SELECT doc_id, source, md5('42|' || doc_id) AS o, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS n FROM documents),
    c AS (SELECT *, row_number() OVER (ORDER BY n, o, doc_id) AS m FROM r WHERE n <= 4) SELECT doc_id, source FROM c WHERE m <= 50""")
def sample_stratified(spark, sf):
    return sampling.stratified(t.documents(spark, sf).select("doc_id", "source"), ["source"], "doc_id", 4, 50)


@query("subsample_queries", f"""WITH {ev.QRELS_SQL}, q AS (SELECT DISTINCT qid FROM qrels ORDER BY qid LIMIT 10), k AS (SELECT DISTINCT doc_id FROM qrels SEMI JOIN q USING (qid)),
    o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS n FROM documents ANTI JOIN k USING (doc_id))
    SELECT doc_id, TRUE AS judged FROM k UNION ALL SELECT doc_id, FALSE FROM o WHERE n <= 100 - (SELECT count(*) FROM k)""")
def subsample_queries(spark, sf):
    """The first ten judged queries, all their documents, and a hash-drawn fill up to the cap."""
    qrels = ev.passage_qrels(spark, sf)
    first = qrels.select("qid").distinct().orderBy("qid").limit(10)
    return sampling.slice_corpus(t.documents(spark, sf).select("doc_id"), qrels.join(first, "qid", "left_semi").select("doc_id"), 100, seed=7)


# -- stores ----------------------------------------------------------------------------------------


@query("store_quality")
def store_quality(spark, sf):
    """Each store stand-in against the exact ranking of the class queries; exact must match itself."""
    vectors, queries = t.vectors(spark, sf), t.class_queries(spark, sf)
    qrels = vectors.select(F.col("label").alias("qid"), "vec_id", F.lit(1).alias("rel"))
    exact = exact_topk(vectors, queries, 10, dim=64, keys=["vec_id"]).select("qid", "vec_id", "rank")
    narrow = exact_topk(
        vectors.withColumn("vector", F.slice("vector", 1, 16)), queries.withColumn("vector", F.slice("vector", 1, 16)), 10, dim=16, keys=["vec_id"]
    ).select("qid", "vec_id", "rank")
    probed = ivf_topk(vectors, queries, 10, key="vec_id", cells=16, nprobes=4).select("qid", "vec_id", "rank")
    out = None
    for name, rows in (("exact", exact), ("truncated-16", narrow), ("ivf-16-4", probed)):
        recall = M.recall_vs_exact(exact.drop("rank"), rows.drop("rank"), "vec_id").select("recall").scalar()
        scored = M.per_query_metrics(rows, qrels, queries.select("qid"), 10, doc="vec_id")
        one = scored.agg(F.lit(name).alias("store"), F.round(F.avg("ndcg"), 4).alias("ndcg")).withColumn("doc_recall", F.round(recall, 4))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("control_ok", (F.col("store") != "exact") | (F.col("doc_recall") == 1.0))


@query("store_quality_exact", f"""WITH {sql.VECTORS_CTE}, {sql.CLASS_QUERIES_CTE},
    s AS (SELECT qid, vec_id, label, round({sql.cosine('q', 'v')}, 6) AS score FROM qs, vecs), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s),
    h AS (SELECT qid, sum(CASE WHEN label = qid THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (label = qid) AS found, min(rank) FILTER (label = qid) AS first FROM r WHERE rank <= 10 GROUP BY qid),
    n AS (SELECT label AS qid, count(*) AS relevant FROM vecs GROUP BY label), i AS (SELECT qid, relevant, (SELECT sum(1 / log2(k + 1)) FROM range(1, 11) x(k) WHERE k <= relevant) AS ideal FROM n)
    SELECT qid::BIGINT AS qid, round(dcg / ideal, 6) AS ndcg, round(found / relevant, 6) AS recall, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr FROM h JOIN i USING (qid)""")
def store_quality_exact(spark, sf):
    """The exact ranking of the class queries judged by label: the control of every store."""
    vectors, queries = t.vectors(spark, sf), t.class_queries(spark, sf)
    qrels = vectors.select(F.col("label").alias("qid"), "vec_id", F.lit(1).alias("rel"))
    exact = exact_topk(vectors, queries, 10, dim=64, keys=["vec_id"])
    got = M.per_query_metrics(exact, qrels, queries.select("qid"), 10, doc="vec_id")
    return got.select(F.col("qid").cast(L).alias("qid"), *[F.round(c, 6).alias(c) for c in ("ndcg", "recall", "mrr")])


@query("store_crossover")
def store_crossover(spark, sf):
    """Where the approximate search would pay: rows each search scores per query, and its recall."""
    vectors, queries = t.vectors(spark, sf), t.class_queries(spark, sf)
    exact = exact_topk(vectors, queries, 10, dim=64, keys=["vec_id"]).select("qid", "vec_id")
    rows = vectors.agg(F.count("*").alias("rows"))
    out = None
    for nprobes in (1, 4, 16):
        probed = ivf_topk(vectors, queries, 10, key="vec_id", cells=16, nprobes=nprobes).select("qid", "vec_id")
        recall = M.recall_vs_exact(exact, probed, "vec_id").select("recall").scalar()
        one = rows.select(F.lit(nprobes).alias("nprobes"), "rows", recall.alias("recall")).withColumn("exact_control", F.col("recall") >= 0.999)
        out = one if out is None else out.unionByName(one)
    return out


def _widths_sql(where: str = "TRUE", keys: str = "") -> str:
    """``hits(width, keys, qid, vec_id, label, rank)``: the ten best rows at the full width and at its first 16 components."""
    cut = lambda x, w: x if w == 64 else f"{x}[1:{w}]"
    parts = " UNION ALL ".join(
        f"SELECT {w} AS width, {keys} qid, vec_id, label, round({sql.cosine(cut('q', w), cut('v', w))}, 6) AS score FROM qs, pool WHERE {where}" for w in (64, 16)
    )
    return f"""hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY width, {keys} qid ORDER BY score DESC, vec_id) AS rank FROM ({parts})) WHERE rank <= 10)"""


@query("store_quality_paired", f"""WITH {sql.VECTORS_CTE}, {sql.CLASS_QUERIES_CTE}, pool AS (SELECT * FROM vecs), {_widths_sql()},
    m AS (SELECT label AS qid, count(*) AS relevant FROM vecs GROUP BY label), n AS (SELECT qid, (SELECT sum(1 / log2(k + 1)) FROM range(1, 11) x(k) WHERE k <= relevant) AS ideal FROM m),
    d AS (SELECT width, qid, coalesce(sum(CASE WHEN label = qid THEN 1 / log2(rank + 1) END), 0) / any_value(ideal) AS ndcg FROM hits JOIN n USING (qid) GROUP BY width, qid),
    p AS (SELECT w.qid, round(e.ndcg, 8) AS e, round(w.ndcg, 8) AS w FROM d e JOIN d w USING (qid) WHERE e.width = 64 AND w.width = 16),
    r AS (SELECT sum((b.vec_id IS NOT NULL)::INT) / count(*) AS recall FROM (SELECT * FROM hits WHERE width = 64) a LEFT JOIN (SELECT * FROM hits WHERE width = 16) b USING (qid, vec_id))
    SELECT 'truncated-16' AS store, count(*)::BIGINT AS queries, round(avg(e), 6) AS exact_ndcg, round(avg(w), 6) AS store_ndcg, round(avg(w - e), 6) AS mean_delta,
           count(*) FILTER (w > e)::BIGINT AS wins, count(*) FILTER (w = e)::BIGINT AS ties, count(*) FILTER (w < e)::BIGINT AS losses, round((SELECT recall FROM r), 6) AS doc_recall FROM p""")
def store_quality_paired(spark, sf):
    """A store of truncated vectors against the exact one, query by query: nDCG, its paired difference, and the recall of documents."""
    exact, narrow, queries = *_two_widths(t.vectors(spark, sf), t.class_queries(spark, sf)), t.class_queries(spark, sf)
    qrels = t.vectors(spark, sf).select(F.col("label").alias("qid"), "vec_id", F.lit(1).alias("rel"))
    scored = [
        M.per_query_metrics(rows, qrels, queries.select("qid"), 10, doc="vec_id").select("qid", F.round("ndcg", 8).alias(c)) for rows, c in ((exact, "e"), (narrow, "w"))
    ]
    recall = exact.select("qid", "vec_id").join(narrow.select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left").agg((F.count("hit") / F.count("*")).alias("recall"))
    return scored[0].join(scored[1], "qid").agg(
        F.lit("truncated-16").alias("store"), F.count("*").alias("queries"), F.round(F.avg("e"), 6).alias("exact_ndcg"), F.round(F.avg("w"), 6).alias("store_ndcg"),
        F.round(F.avg(F.col("w") - F.col("e")), 6).alias("mean_delta"), F.count_if(F.col("w") > F.col("e")).alias("wins"), F.count_if(F.col("w") == F.col("e")).alias("ties"),
        F.count_if(F.col("w") < F.col("e")).alias("losses"),
    ).withColumn("doc_recall", F.round(recall.scalar(), 6))


def _two_widths(vectors: DataFrame, queries: DataFrame, segments: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The ten best rows per query at the full width and at the first 16 components."""
    cut = lambda rows: rows.withColumn("vector", F.slice("vector", 1, 16))
    exact = exact_topk(vectors, queries, 10, dim=64, keys=["vec_id"], segments=segments)
    return exact, exact_topk(cut(vectors), cut(queries), 10, dim=16, keys=["vec_id"], segments=segments)


SHARES = (1, 2, 4)  # a subset has the rows whose hash is 0 modulo this


@query("store_crossover_exact", f"""WITH {sql.VECTORS_CTE}, {sql.CLASS_QUERIES_CTE},
    pool AS (SELECT one_in, vecs.* FROM vecs, (VALUES {", ".join(f"({n})" for n in SHARES)}) s(one_in) WHERE ('0x' || substr(md5(vec_id::VARCHAR), 1, 7))::BIGINT % one_in = 0),
    {_widths_sql(keys="one_in,")}, n AS (SELECT one_in, count(*) AS rows FROM pool GROUP BY one_in),
    r AS (SELECT a.one_in, sum((b.vec_id IS NOT NULL)::INT) / count(*) AS recall FROM (SELECT * FROM hits WHERE width = 64) a LEFT JOIN (SELECT * FROM hits WHERE width = 16) b USING (one_in, qid, vec_id) GROUP BY a.one_in)
    SELECT one_in::INT AS one_in, rows::BIGINT AS rows, (rows * (SELECT count(*) FROM qs) * 64)::BIGINT AS exact_values, (rows * (SELECT count(*) FROM qs) * 16)::BIGINT AS narrow_values, round(recall, 6) AS recall
    FROM n JOIN r USING (one_in)""")
def store_crossover_exact(spark, sf):
    """Where the narrow vectors would pay: per subset of the rows the values that either width reads for all queries, and the
    recall of the narrow one. Subsets are drawn by the hash of the id and nested in each other."""
    number = F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 7), 16, 10).cast("long")
    pool = t.vectors(spark, sf).select("vec_id", "vector", F.explode(F.array(*[F.lit(n) for n in SHARES])).alias("one_in")).where(number % F.col("one_in") == 0)
    exact, narrow = _two_widths(pool, t.class_queries(spark, sf), ("one_in",))
    asked = t.class_queries(spark, sf).agg(F.count("*").alias("n")).scalar()
    keys = ["one_in", "qid", "vec_id"]
    recall = exact.select(*keys).join(narrow.select(*keys, F.lit(1).alias("hit")), keys, "left").groupBy("one_in").agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))
    rows = pool.groupBy("one_in").agg(F.count("*").alias("rows"))
    return rows.join(recall, "one_in").select(
        "one_in", "rows", (F.col("rows") * asked * 64).alias("exact_values"), (F.col("rows") * asked * 16).alias("narrow_values"), "recall"
    )


# -- measurements ----------------------------------------------------------------------------------


@query("agg_latency_percentiles", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(value) FILTER (i = least(floor(0.5 * n), n - 1)) AS floor_p50, max(value) FILTER (i = least(floor(0.95 * n), n - 1)) AS floor_p95, max(value) FILTER (i = round_even(0.5 * (n - 1), 0)) AS round_p50,
           max(value) FILTER (i = round_even(0.95 * (n - 1), 0)) AS round_p95, max(value) FILTER (i = n // 2) AS middle FROM r GROUP BY event_type""")
def agg_latency_percentiles(spark, sf):
    """The three order-statistic conventions side by side, event values standing in for latencies."""
    rows = t.table(spark, sf, "events").select("event_type", "value")
    return S.order_statistics(rows, ["event_type"], "value", {
        "floor_p50": ("floor", 0.5), "floor_p95": ("floor", 0.95), "round_p50": ("round", 0.5), "round_p95": ("round", 0.95), "middle": ("middle", 0.5),
    })


_WORD = r"regexp_extract_all(lower({}), '[0-9a-z]+|[\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}]')"
KEPT_SQL = f"""{hygiene.LOOSE_SQL}, kept AS (SELECT w.doc_id, string_agg(w.w, '' ORDER BY w.i) AS kept FROM w WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = w.doc_id AND w.s >= s.start AND w.s < s."end") GROUP BY w.doc_id),
    rf AS (SELECT doc_id, lang, token, count(*) AS n FROM (SELECT doc_id, lang, unnest({_WORD.format('text')}) AS token FROM documents) GROUP BY ALL),
    xt AS (SELECT doc_id, token, count(*) AS m FROM (SELECT doc_id, unnest({_WORD.format('kept')}) AS token FROM kept) GROUP BY ALL),
    wr AS (SELECT d.doc_id, d.lang, coalesce(sum(least(n, coalesce(m, 0))) / sum(n), 1) AS r FROM documents d LEFT JOIN rf USING (doc_id) LEFT JOIN xt ON xt.doc_id = rf.doc_id AND xt.token = rf.token GROUP BY d.doc_id, d.lang)"""


def recalls(spark, sf) -> DataFrame:
    """How many of a document's words its sanitized text keeps."""
    clean = sanitize(t.documents(spark, sf).withColumn("original", F.col("text")), hygiene.LOOSE, mode="strip")
    pairs = clean.select("doc_id", word_tokens(F.col("original")).alias("a"), word_tokens(F.col("text")).alias("b"))
    return M.word_recall(pairs, "doc_id", "a", "b")


@query("agg_word_recall", f"WITH {KEPT_SQL} SELECT doc_id, round(r, 6) AS word_recall FROM wr")
def agg_word_recall(spark, sf):
    return recalls(spark, sf).select("doc_id", F.round("word_recall", 6).alias("word_recall"))


@query("agg_group_summary", f"""WITH {KEPT_SQL}, o AS (SELECT lang, r, row_number() OVER (PARTITION BY lang ORDER BY r) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM wr WHERE r > 0)
    SELECT lang, (SELECT count(*) FROM wr WHERE wr.lang = o.lang AND NOT r > 0)::BIGINT AS failures, count(*)::BIGINT AS ok, round(avg(r), 6) AS mean, round(max(r) FILTER (i = n // 2), 6) AS p50 FROM o GROUP BY lang""")
def agg_group_summary(spark, sf):
    # counted once, for the means and for the middle
    rows = cut_lineage(recalls(spark, sf)).join(t.documents(spark, sf).select("doc_id", "lang"), "doc_id")
    ok = F.col("word_recall") > 0
    base = rows.groupBy("lang").agg(
        F.count_if(~ok).alias("failures"), F.count_if(ok).alias("ok"), F.round(F.avg(F.when(ok, F.col("word_recall"))), 6).alias("mean")
    )
    middle = S.picked_percentile(rows.where(ok), ["lang"], "word_recall", (0.5,), "middle").select("lang", F.round("p50", 6).alias("p50"))
    return base.join(middle, "lang")


def _grams_sql(expr: str) -> str:
    flat = rf"lower(array_to_string({sql.toks(expr)}, ' '))"
    return f"list_transform(range(1, len('  ' || {flat} || '  ') - 1), lambda i: substr('  ' || {flat} || '  ', i, 3))"


@query("agg_edit_similarity", f"""WITH {sql.dense_scores_cte()}, {search.DOC_RANK_SQL},
    best1 AS (SELECT qid, doc_id, ordinal FROM docs WHERE rank <= 1),
    pair AS (SELECT qid, b.doc_id, benchmark.text AS a, array_to_string(toks, ' ') AS b FROM best1 b JOIN chunks c ON c.doc_id = b.doc_id AND c.ordinal = b.ordinal JOIN benchmark ON item_id = qid),
    ga AS (SELECT qid, g, count(*) AS n FROM (SELECT qid, unnest({_grams_sql('a')}) AS g FROM pair) GROUP BY ALL),
    gb AS (SELECT qid, g, count(*) AS n FROM (SELECT qid, unnest({_grams_sql('b')}) AS g FROM pair) GROUP BY ALL),
    sums AS (SELECT qid, sum(n) AS n FROM (SELECT * FROM ga UNION ALL SELECT * FROM gb) GROUP BY qid),
    met AS (SELECT qid, sum(least(ga.n, gb.n)) AS m FROM ga JOIN gb USING (qid, g) GROUP BY qid)
    SELECT qid, doc_id, round(2.0 * coalesce(m, 0) / n, 6) AS similarity FROM pair JOIN sums USING (qid) LEFT JOIN met USING (qid)""")
def agg_edit_similarity(spark, sf):
    """Each passage against its best chunk, as whole texts."""
    best = cut_lineage(search.document_ranking(spark, sf, 1).select("qid", "doc_id", "ordinal"))
    chunks = t.chunks_of(spark, sf, best.select("doc_id").distinct()).select("doc_id", "ordinal", F.col("text").alias("chunk_text"))
    asked = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return best.join(chunks, ["doc_id", "ordinal"]).join(asked, "qid").select(
        "qid", "doc_id", F.round(measure.edit_similarity(F.col("text"), F.col("chunk_text")), 6).alias("similarity")
    )


@query("agg_phrase_recall", r"""WITH p AS (SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS format, html, substr(regexp_extract(html, '<title>([^<&]+)', 1), 1, 12) AS phrase FROM pages),
    e AS (SELECT format, contains(html, phrase)::INT AS raw, contains(regexp_replace(html, '<[^>]*>', ' ', 'g'), phrase)::INT AS stripped, contains(regexp_replace(html, '(?s)<head.*</head>', '', 'g'), phrase)::INT AS body FROM p)
    SELECT format, round(avg(raw), 6) AS raw, round(avg(stripped), 6) AS stripped, round(avg(body), 6) AS body FROM e GROUP BY format""")
def agg_phrase_recall(spark, sf):
    """The start of each page's title, looked for in what three simple extractors keep."""
    html = F.col("html")
    pages = t.table(spark, sf, "pages").select(
        F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("format"), F.substring(F.regexp_extract(html, "<title>([^<&]+)", 1), 1, 12).alias("phrase"),
        F.inline(F.array(
            F.struct(F.lit("raw").alias("extractor"), html.alias("text")),
            F.struct(F.lit("stripped").alias("extractor"), F.regexp_replace(html, "<[^>]*>", " ").alias("text")),
            F.struct(F.lit("body").alias("extractor"), F.regexp_replace(html, "(?s)<head.*</head>", "").alias("text")),
        )),
    )
    found = F.contains("text", F.col("phrase")).cast("int")
    return pages.groupBy("format").pivot("extractor", ["raw", "stripped", "body"]).agg(F.round(F.avg(found), 6))


@query("extract_html_words", f"""SELECT page_id, len({sql.toks('html')})::INT AS html_words, len({sql.toks('text')})::INT AS words FROM (SELECT page_id, html, {hygiene.html_sql('html')} AS text FROM pages)""")
def extract_html_words(spark, sf):
    """Words per page, before and after HTML is read as text."""
    pages = t.spread(t.table(spark, sf, "pages")).withColumn("text", extract_html(F.col("html")))
    return pages.select("page_id", token_count(F.col("html")).alias("html_words"), token_count(F.col("text")).alias("words"))


@query("agg_energy", """WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value, lag(epoch_us(ts) / 1e6) OVER w AS pt, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    a AS (SELECT user_id, coalesce(sum((value + pv) / 2 * (t - pt)), 0) AS joules, max(t) - min(t) AS seconds, count(*) AS units FROM g GROUP BY user_id),
    m AS (SELECT *, CASE WHEN seconds <= 0 THEN 0 ELSE greatest(0, joules - 40.0 * seconds) END AS mj FROM a)
    SELECT user_id, round(joules, 3) AS joules, round(mj, 3) AS marginal_j, round(CASE WHEN units > 0 THEN mj / units ELSE 0 END, 3) AS marginal_j_per_unit, round(CASE WHEN seconds > 0 THEN mj / seconds ELSE 0 END / 5.0, 6) AS signal_to_noise,
           CASE WHEN seconds > 0 THEN mj / seconds ELSE 0 END / 5.0 >= 3 AS resolved, round(mj / units * 1e6 / 3.6e6 * 0.3, 3) AS cost_per_million FROM m""")
def agg_energy(spark, sf):
    """Event values as a power gauge per user: energy, the part above idle, and its price."""
    events = t.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    area = measure.trapezoid(events, ["user_id"], "ts", "value", "event_id")
    units = events.groupBy("user_id").agg(F.count("*").alias("units"))
    parts = measure.energy(F.col("joules"), F.col("seconds"), F.lit(40.0), F.lit(5.0), F.col("units"), 0.3)
    places = {"marginal_j": 3, "marginal_j_per_unit": 3, "signal_to_noise": 6, "cost_per_million": 3}
    return area.join(units, "user_id").select(
        "user_id", F.round("joules", 3).alias("joules"), *[F.round(parts[c], p).alias(c) for c, p in places.items()], parts["resolved"].alias("resolved")
    )


@query("agg_rows_per_gb", """WITH d AS (SELECT event_type AS backend, date_trunc('day', ts) AS day, count(*) AS n, sum(value) AS v FROM events GROUP BY ALL),
    s AS (SELECT backend, (sum(n) OVER w)::BIGINT AS rows, CASE backend WHEN 'error' THEN 50.0 WHEN 'view' THEN 900.0 - sum(n) OVER w * 0.1 ELSE round(sum(v) OVER w / 100, 3) END AS mb FROM d WINDOW w AS (PARTITION BY backend ORDER BY day)),
    l AS (SELECT *, lag(mb) OVER (PARTITION BY backend ORDER BY rows) AS p FROM s),
    e AS (SELECT backend, count(*) AS c, min(rows) AS r0, max(rows) AS r1, min_by(mb, rows) AS m0, max_by(mb, rows) AS m1, min(mb - p) AS fall FROM l GROUP BY backend),
    v AS (SELECT *, CASE WHEN fall < -greatest(5.0, m0 * 0.1) THEN 'not extrapolated' WHEN m1 - m0 < greatest(5.0, m0 * 0.1) THEN 'flat' ELSE 'linear' END AS verdict FROM e WHERE c >= 2)
    SELECT backend, verdict, CASE WHEN verdict = 'linear' THEN r1 + trunc((8192 - m1) * 1024 / ((m1 - m0) / (r1 - r0) * 1024))::BIGINT END AS capacity FROM v""")
def agg_rows_per_gb(spark, sf):
    """Events per type and day as a growing store: three regimes, only one of them a line."""
    days = t.table(spark, sf, "events").groupBy(F.col("event_type").alias("backend"), F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    w = Window.partitionBy("backend").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    rows = F.sum("n").over(w)
    size = F.when(F.col("backend") == "error", F.lit(50.0)).when(F.col("backend") == "view", F.lit(900.0) - rows * 0.1).otherwise(F.round(F.sum("v").over(w) / 100, 3))
    return measure.rows_per_gb(days.select("backend", rows.alias("rows"), size.alias("resident_mb")), "backend")


PRICES = (("alpha", "small", 0.02), ("alpha", "large", 0.13), ("beta", "base", None))


@query("agg_cloud_cost", f"""WITH m AS (SELECT avg(len({sql.toks('text')})) AS words, avg(length(text) / 4.0) AS chars FROM documents), lh AS (SELECT least(words, chars) AS lo, greatest(words, chars) AS hi FROM m)
    SELECT provider, model, round(price * lo, 4) AS cost_low, round(price * hi, 4) AS cost_high FROM (VALUES {", ".join(f"('{p}', '{m}', {'NULL' if c is None else c}::DOUBLE)" for p, m, c in PRICES)}) p(provider, model, price), lh""")
def agg_cloud_cost(spark, sf):
    """List prices times the tokens of the mean document, under two ways of counting tokens."""
    counts = t.documents(spark, sf).agg(F.avg(token_count(F.col("text"))).alias("words"), F.avg(F.length("text") / 4.0).alias("chars"))
    prices = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model"), F.lit(c).cast("double").alias("price")) for p, m, c in PRICES])
    rows = counts.select(F.least("words", "chars").alias("lo"), F.greatest("words", "chars").alias("hi"), F.inline(prices))
    return rows.select("provider", "model", F.round(F.col("price") * F.col("lo"), 4).alias("cost_low"), F.round(F.col("price") * F.col("hi"), 4).alias("cost_high"))
