"""Audit plans: chunk sets under a grid of profiles, span integrity, and cell bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.rows import fan_out
from corvane.functions.text import tokens
from corvane.operators import audit as A
from corvane.operators import effects as E
from corvane.operators import spans as P
from corvane.operators import stats as S
from corvane.operators.chunking import whitespace_windows
from corvane.operators.topk import exact_topk
from corvane.plans import evaluation as ev
from corvane.plans import hygiene, sql
from corvane.plans import tables as t
from corvane.plans.registry import query
from corvane.session import cut_lineage

L = "long"

# (cap, overlap, tokenizer, recipe): ``word`` counts blanks-separated words, ``char4`` four
# characters a token. The recipe changes nothing, which the audit has to notice.
PROFILES = (
    (64, 0, "word", ""), (64, 16, "word", ""), (64, 32, "word", ""),
    (128, 0, "word", ""), (128, 16, "word", ""), (128, 32, "word", ""),
    (64, 0, "char4", ""), (64, 0, "word", "markdown"),
)
APPENDED = ("whitespace",)  # these windows append their overlap


def _tag(cap, overlap, tokenizer, recipe) -> str:
    return f"whitespace-t{cap}-o{overlap}-{tokenizer}" + (f"-r{recipe}" if recipe else "")


def chunk_sets(spark, sf) -> DataFrame:
    """``corpus, profile, uri, ordinal, token_count, chars`` under every profile, built in the row."""
    docs = t.documents(spark, sf).select(
        F.concat(F.lit("docs_"), "lang").alias("corpus"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("uri"),
        tokens(F.col("text")).alias("_t"),
    )
    sets = F.array(*[
        F.struct(F.lit(_tag(*p)).alias("profile"), F.lit(p[2]).alias("unit"), whitespace_windows(F.col("_t"), p[0], p[1]).alias("w"))
        for p in PROFILES
    ])
    wide = docs.select("corpus", "uri", F.inline(sets)).select("corpus", "uri", "profile", "unit", F.posexplode("w").alias("ordinal", "win"))
    chars = F.length(F.array_join("win", " "))
    count = F.when(F.col("unit") == "char4", F.ceil(chars / 4).cast("int")).otherwise(F.size("win"))
    return wide.select("corpus", "profile", "uri", "ordinal", count.alias("token_count"), chars.alias("chars"))


_VALUES = ", ".join(f"({c}, {o}, '{tk}', '{r}', '{_tag(c, o, tk, r)}')" for c, o, tk, r in PROFILES)
SETS_SQL = f"""prof AS (SELECT * FROM (VALUES {_VALUES}) p(cap, ov, unit, recipe, profile)),
    rawc AS (SELECT 'docs_' || lang AS corpus, profile, 'doc://' || doc_id AS uri, s // cap AS ordinal, unit, list_slice(t, greatest(s - ov, 0) + 1, s + cap) AS toks
      FROM (SELECT doc_id, lang, t, cap, ov, unit, profile, unnest(range(0, len(t), cap)) AS s FROM (SELECT doc_id, lang, {sql.toks('text')} AS t FROM documents), prof)),
    cs AS (SELECT corpus, profile, uri, ordinal, CASE unit WHEN 'char4' THEN ceil(length(array_to_string(toks, ' ')) / 4)::BIGINT ELSE len(toks) END AS token_count,
                  length(array_to_string(toks, ' ')) AS chars FROM rawc),
    tot AS (SELECT corpus, profile, count(*) AS rows, count(DISTINCT uri) AS docs, sum(token_count) AS tokens_total, sum(chars) AS chars_total, max(token_count) AS token_max,
                   sum(('0x' || substr(sha256(uri || '|' || ordinal || '|' || token_count), 1, 12))::HUGEINT)::VARCHAR AS boundary,
                   quantile_disc(token_count, 0.5) AS token_p50, quantile_disc(token_count, 0.9) AS token_p90, quantile_disc(token_count, 0.95) AS token_p95
            FROM cs GROUP BY ALL),
    sets AS (SELECT tot.*, 'whitespace' AS strategy, cap AS max_tokens, ov AS overlap_tokens, unit AS tokenizer, recipe, cap + ov AS true_cap,
                    round(rows / docs, 3) AS chunks_per_doc, round(chars_total / tokens_total, 3) AS chars_per_token, token_max <= cap + ov AS cap_enforced,
                    (SELECT count(*) FROM cs WHERE cs.corpus = tot.corpus AND cs.profile = tot.profile AND cs.token_count > cap + ov) AS over_true_cap
             FROM tot JOIN prof USING (profile))"""


def sets(spark, sf) -> DataFrame:
    return ev.once(spark, sf, "chunk_sets", lambda: A.scan_chunk_sets(chunk_sets(spark, sf), APPENDED))


_SCAN = ["rows", "docs", "tokens_total", "chars_total", "token_max", "token_p50", "token_p90", "token_p95", "true_cap", "over_true_cap"]


@query("agg_chunk_scan", f"""WITH {SETS_SQL} SELECT corpus, profile, boundary, chunks_per_doc, chars_per_token, cap_enforced, {", ".join(f"{c}::BIGINT AS {c}" for c in _SCAN)} FROM sets""")
def agg_chunk_scan(spark, sf):
    return sets(spark, sf).select("corpus", "profile", "boundary", "chunks_per_doc", "chars_per_token", "cap_enforced", *[F.col(c).cast(L).alias(c) for c in _SCAN])


AXIS_SQL = """axe AS (
      SELECT 'overlap_tokens' AS axis, corpus, strategy, count(DISTINCT overlap_tokens) AS levels, count(DISTINCT boundary) AS nb, count(DISTINCT tokens_total) AS nt, (max(rows) - min(rows)) / max(rows) AS spread FROM sets GROUP BY corpus, strategy, max_tokens, tokenizer, recipe
      UNION ALL SELECT 'max_tokens', corpus, strategy, count(DISTINCT max_tokens), count(DISTINCT boundary), count(DISTINCT tokens_total), (max(rows) - min(rows)) / max(rows) FROM sets GROUP BY corpus, strategy, overlap_tokens, tokenizer, recipe
      UNION ALL SELECT 'tokenizer', corpus, strategy, count(DISTINCT tokenizer), count(DISTINCT boundary), count(DISTINCT tokens_total), (max(rows) - min(rows)) / max(rows) FROM sets GROUP BY corpus, strategy, overlap_tokens, max_tokens, recipe),
    axs AS (SELECT *, CASE WHEN nb = 1 THEN 'inert' WHEN nt = 1 AND spread < 0.05 THEN 'weak' WHEN spread < 0.001 THEN 'content-only' ELSE 'real' END AS status FROM axe WHERE levels > 1)"""


@query("agg_axis_effects", f"WITH {SETS_SQL}, {AXIS_SQL} SELECT axis, corpus, strategy, levels::BIGINT AS levels, round(spread * 100, 2) AS spread_pct, status FROM axs")
def agg_axis_effects(spark, sf):
    return A.axis_effects(sets(spark, sf)).drop("key")


@query("agg_axis_status", f"""WITH {SETS_SQL}, {AXIS_SQL}, c AS (SELECT axis, strategy, status, count(*) AS c FROM axs GROUP BY ALL)
    SELECT axis, strategy, sum(c)::BIGINT AS groups, string_agg(status || '=' || c, ',' ORDER BY status) AS status_counts, CASE WHEN count(*) = 1 THEN max(status) ELSE 'conditional' END AS verdict FROM c GROUP BY axis, strategy""")
def agg_axis_status(spark, sf):
    got = A.axis_status(A.axis_effects(sets(spark, sf)))
    pairs = F.transform(F.map_entries("status_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return got.withColumn("status_counts", F.array_join(F.array_sort(pairs), ","))


@query("agg_duplicates", f"""WITH {SETS_SQL} SELECT corpus, count(*)::BIGINT AS n, string_agg(profile, ',' ORDER BY profile) AS profiles FROM sets GROUP BY corpus, boundary HAVING count(*) > 1""")
def agg_duplicates(spark, sf):
    return A.duplicates(sets(spark, sf)).drop("boundary")


@query("agg_text_coverage", f"""WITH {SETS_SQL}, g AS (SELECT corpus, count(*) AS profiles, max(chars_total) - min(chars_total) AS cd, max(rows) * 4 AS bound, (max(tokens_total) - min(tokens_total)) / max(tokens_total) AS ts FROM sets WHERE overlap_tokens = 0 GROUP BY corpus)
    SELECT corpus, profiles::BIGINT AS profiles, cd::BIGINT AS char_delta, bound::BIGINT AS bound, round(ts * 100, 2) AS token_spread_pct,
           CASE WHEN cd > bound THEN 'text_differs' WHEN ts > 0.005 THEN 'counters_differ' ELSE 'consistent' END AS verdict FROM g WHERE profiles >= 2""")
def agg_text_coverage(spark, sf):
    return A.text_coverage(sets(spark, sf))


def recut_sets(spark, sf) -> DataFrame:
    """The sets, with the 128-token overlap-32 set re-cut: its windows advance by 96 tokens.

    That is what a size guard running after the overlap does, and what the audit has to catch.
    """
    docs = t.documents(spark, sf).select(F.concat(F.lit("docs_"), "lang").alias("corpus"), F.size(tokens(F.col("text"))).alias("n"))
    recut = docs.where("n > 0").groupBy("corpus").agg(F.sum(F.ceil(F.col("n") / 96)).alias("_rows"))
    joined = sets(spark, sf).join(recut, "corpus")
    return joined.withColumn("rows", F.when(F.col("profile") == "whitespace-t128-o32-word", F.col("_rows")).otherwise(F.col("rows"))).drop("_rows")


RECUT_SQL = f"""rc AS (SELECT 'docs_' || lang AS corpus, sum(ceil(len({sql.toks('text')}) / 96.0))::BIGINT AS n FROM documents GROUP BY lang),
    rsets AS (SELECT sets.* REPLACE (CASE WHEN profile = 'whitespace-t128-o32-word' THEN rc.n ELSE rows END AS rows) FROM sets JOIN rc USING (corpus)),
    moved AS (SELECT r.corpus, r.profile, r.rows, b.rows AS rows_at_overlap_0, round(abs(r.rows - b.rows) / b.rows * 100, 2) AS spread_pct
      FROM rsets r JOIN rsets b ON r.corpus = b.corpus AND r.max_tokens = b.max_tokens AND r.tokenizer = b.tokenizer AND r.recipe = b.recipe AND b.overlap_tokens = 0 AND r.overlap_tokens <> 0
      WHERE abs(r.rows - b.rows) / b.rows > 0.001)"""


@query("agg_moved_boundaries", f"WITH {SETS_SQL}, {RECUT_SQL} SELECT corpus, profile, rows::BIGINT AS rows, rows_at_overlap_0::BIGINT AS rows_at_overlap_0, spread_pct FROM moved")
def agg_moved_boundaries(spark, sf):
    return A.moved_boundaries(recut_sets(spark, sf), APPENDED).withColumn("rows", F.col("rows").cast(L))


@query("agg_corpus_fitness", f"WITH {SETS_SQL} SELECT corpus, docs::BIGINT AS docs, rows::BIGINT AS rows, chunks_per_doc, chunks_per_doc >= 3 AS fit FROM sets WHERE profile = 'whitespace-t128-o0-word'")
def agg_corpus_fitness(spark, sf):
    return E.corpus_fit(sets(spark, sf), "whitespace-t128-o0-word")


@query("corpus_fit", f"WITH {SETS_SQL} SELECT corpus, chunks_per_doc FROM sets WHERE profile = 'whitespace-t64-o0-word' AND chunks_per_doc >= 3 AND corpus NOT IN (SELECT 'docs_' || lang FROM documents GROUP BY lang HAVING count(*) < 120)")
def corpus_fit_plan(spark, sf):
    """Fit corpora minus the declared re-renderings (here: the corpora of fewer than 120 documents)."""
    renderings = t.documents(spark, sf).groupBy("lang").agg(F.count("*").alias("n")).where("n < 120").select(F.concat(F.lit("docs_"), "lang").alias("corpus"))
    return E.corpus_fit(sets(spark, sf), "whitespace-t64-o0-word", renderings).where("fit").select("corpus", "chunks_per_doc")


@query("unjudged_corpora", f"""WITH {ev.EFFECTS_SQL}, judged AS (SELECT 'docs_' || lang AS corpus FROM documents GROUP BY lang HAVING count(*) >= 120)
    SELECT DISTINCT corpus FROM eff WHERE axis IN ('max_tokens', 'overlap_tokens') AND corpus NOT IN (SELECT corpus FROM judged)""")
def unjudged_corpora(spark, sf):
    judged = t.documents(spark, sf).groupBy("lang").agg(F.count("*").alias("n")).where("n >= 120").select(F.concat(F.lit("docs_"), "lang").alias("corpus"))
    return E.unjudged_corpora(ev.effects(spark, sf), judged)


@query("parse_profile", """SELECT doc_id, tag AS profile, CASE WHEN good THEN 'fast' END AS strategy, CASE WHEN good THEN n_chars::INT END AS max_tokens, CASE WHEN good THEN doc_id::INT END AS overlap_tokens,
      CASE WHEN good THEN CASE WHEN lang = 'es' THEN 'a-rb' ELSE lang END END AS tokenizer, CASE WHEN good THEN CASE WHEN lang = 'de' THEN 'markdown' ELSE '' END END AS recipe,
      CASE WHEN good AND lang = 'en' THEN source END AS breakpoint_model, CASE WHEN good AND lang = 'es' THEN 'a-rb' END AS recipe_unparsed, good AS parsed
    FROM (SELECT *, lang <> 'fr' AS good, CASE lang WHEN 'fr' THEN 'Fast_t' || n_chars ELSE 'fast-t' || n_chars || '-o' || doc_id || '-' || CASE lang WHEN 'es' THEN 'a-rb' WHEN 'de' THEN 'de-rmarkdown' ELSE 'en-bp' || source END END AS tag FROM documents)""")
def parse_profile(spark, sf):
    """Tags spelled from the documents' own columns, parsed back into axes."""
    tail = F.when(F.col("lang") == "es", F.lit("a-rb")).when(F.col("lang") == "de", F.lit("de-rmarkdown")).otherwise(F.concat(F.lit("en-bp"), "source"))
    tag = F.when(F.col("lang") == "fr", F.concat(F.lit("Fast_t"), F.col("n_chars").cast("string"))).otherwise(
        F.concat(F.lit("fast-t"), F.col("n_chars").cast("string"), F.lit("-o"), F.col("doc_id").cast("string"), F.lit("-"), tail)
    )
    parsed = t.documents(spark, sf).select("doc_id", tag.alias("profile")).withColumn("a", E.parse_profile(F.col("profile")))
    return parsed.select("doc_id", "profile", "a.*").withColumn("parsed", F.col("parse_error").isNull()).drop("parse_error")


@query("true_cap", f"""WITH {SETS_SQL} SELECT corpus, profile, (max_tokens + overlap_tokens)::BIGINT AS appended_cap, max_tokens::BIGINT AS native_cap FROM sets""")
def true_cap(spark, sf):
    args = [F.col("strategy"), F.col("max_tokens"), F.col("overlap_tokens")]
    return sets(spark, sf).select("corpus", "profile", E.true_cap(*args, APPENDED).cast(L).alias("appended_cap"), E.true_cap(*args).cast(L).alias("native_cap"))


DECLARED = ("docs_de", "docs_en", "docs_fr")  # the corpora that the registered report may name

# -- spans -----------------------------------------------------------------------------------------

SPAN_GRID = ((16, 0), (16, 8), (32, 0), (32, 8), (64, 0), (64, 8))


def span_bits(spark, sf) -> DataFrame:
    """One row per (profile, question): is the answer (a document's middle eight words) whole?"""
    docs = t.documents(spark, sf).select(
        "doc_id", F.concat(F.lit("docs_"), "lang").alias("corpus"), "text", P.piece_marks(F.col("text")).alias("marks")
    )  # tokens are found once for the answer and the whole grid
    docs = docs.withColumn("answer", P.middle_words(F.col("text"), F.col("marks"))).withColumn("start", F.position(F.col("answer"), F.col("text")) - 1)
    end = F.col("start") + F.length("answer")
    every = F.array(*[
        F.struct(F.lit(c).alias("max_tokens"), F.lit(o).alias("overlap_tokens"), P.spans_of(F.col("marks"), c, o).alias("spans"))
        for c, o in SPAN_GRID
    ])
    # A document without an answer gets no cells; a filter on the answer would be computed twice.
    cells = F.when(F.length("answer") > 0, every)
    wide = fan_out(docs, ["doc_id", "corpus", "answer", "start", end.alias("end")], cells, "cell").select("*", "cell.*")
    return wide.select(
        "doc_id", "corpus", "max_tokens", "overlap_tokens", F.size("spans").alias("n_chunks"), F.length("answer").alias("answer_chars"),
        P.intact(F.col("spans"), F.col("start"), F.col("end")).alias("intact"),
    )


BITS_SQL = rf"""{hygiene.MIDDLE_SQL.replace("qa AS (", "qa AS MATERIALIZED (")},
    tk AS MATERIALIZED (SELECT doc_id, i, length(p) AS flen, length(trim(p, E' \n\t\r')) AS wlen, length(p) - length(ltrim(p, E' \n\t\r')) AS ld
           FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '^\s*[^\s]+\s*|[^\s]+\s*') AS ps FROM documents))),
    ps AS MATERIALIZED (SELECT doc_id, i, sum(flen) OVER (PARTITION BY doc_id ORDER BY i) - flen + ld AS a, sum(flen) OVER (PARTITION BY doc_id ORDER BY i) - flen + ld + wlen AS z FROM tk),
    pl AS MATERIALIZED (SELECT doc_id, list(a ORDER BY i) AS la, list(z ORDER BY i) AS lz, count(*) AS n FROM ps GROUP BY doc_id),
    sg AS (SELECT * FROM (VALUES {", ".join(f"({c}, {o})" for c, o in SPAN_GRID)}) g(cap, ov)),
    sx AS (SELECT doc_id, cap, ov, unnest(list_transform(range(0, n, cap), lambda s: {{'a': la[greatest(s - ov, 0) + 1], 'z': lz[least(s + cap, n)]}})) AS w FROM pl, sg),
    sp AS MATERIALIZED (SELECT doc_id, cap, ov, w.a AS start, w.z AS "end" FROM sx),
    bits AS (SELECT qa.doc_id, 'docs_' || any_value(lang) AS corpus, cap, ov, count(*) AS n_chunks, any_value(length(qa.a)) AS answer_chars, bool_or(sp.start <= p AND sp."end" >= p + length(qa.a)) AS intact
             FROM qa JOIN sp USING (doc_id) GROUP BY qa.doc_id, cap, ov)"""


@query("span_bits", f"WITH {BITS_SQL} SELECT doc_id, corpus, cap::BIGINT AS max_tokens, ov::BIGINT AS overlap_tokens, n_chunks::BIGINT AS n_chunks, intact FROM bits")
def span_bits_plan(spark, sf):
    return span_bits(spark, sf).select("doc_id", "corpus", *[F.col(c).cast(L).alias(c) for c in ("max_tokens", "overlap_tokens", "n_chunks")], "intact")


@query("agg_span_integrity", f"""WITH {BITS_SQL} SELECT corpus, cap::BIGINT AS max_tokens, ov::BIGINT AS overlap_tokens, count(*)::BIGINT AS n_questions, round(avg(n_chunks), 2) AS chunks_per_context, avg(n_chunks) >= 2 AS fit_for_claim,
    round(avg(intact::INT), 4) AS span_intact, count(*) FILTER (NOT intact)::BIGINT AS answers_split, round(avg(answer_chars), 1) AS mean_answer_chars FROM bits GROUP BY corpus, cap, ov""")
def agg_span_integrity(spark, sf):
    got = P.integrity(span_bits(spark, sf), ["corpus", "max_tokens", "overlap_tokens"])
    return got.withColumn("max_tokens", F.col("max_tokens").cast(L)).withColumn("overlap_tokens", F.col("overlap_tokens").cast(L))


def flag_deltas(bits: DataFrame) -> DataFrame:
    """Per question the difference of every one-axis step, low level to high, between cells that are fit.

    The grid is known, so each question's cells are pivoted into its row by aggregation and every
    pair is compared there. A cell whose contexts have too few chunks is compared with nothing.
    """
    fit = bits.groupBy("corpus", "max_tokens", "overlap_tokens").agg(F.avg("n_chunks").alias("n")).where(F.col("n") >= P.MIN_CHUNKS_PER_CONTEXT)
    bits = bits.join(fit.drop("n"), ["corpus", "max_tokens", "overlap_tokens"], "left_semi")

    def cell(c, o):
        return F.bool_or(F.when((F.col("max_tokens") == c) & (F.col("overlap_tokens") == o), F.col("intact")))

    rows = bits.groupBy("corpus", "doc_id").agg(*[cell(c, o).alias(f"_{c}_{o}") for c, o in SPAN_GRID])
    structs = []
    for c, o in SPAN_GRID:
        for c2, o2 in SPAN_GRID:
            axis = "max_tokens" if c < c2 and o == o2 else "overlap_tokens" if c == c2 and o < o2 else None
            if axis:
                held, low, high = (o, c, c2) if axis == "max_tokens" else (c, o, o2)
                structs.append(F.struct(
                    F.lit(axis).alias("axis"), F.lit(held).cast(L).alias("held"), F.lit(low).cast(L).alias("from_level"), F.lit(high).cast(L).alias("to_level"),
                    (F.col(f"_{c2}_{o2}").cast("int") - F.col(f"_{c}_{o}").cast("int")).cast("double").alias("delta"),
                ))
    return rows.select("corpus", "doc_id", F.inline(F.array(*structs))).where("delta IS NOT NULL")


@query("agg_span_axis_effects", f"""WITH {BITS_SQL}, fit AS (SELECT corpus, cap, ov FROM bits GROUP BY ALL HAVING avg(n_chunks) >= 2), fb AS (SELECT bits.* FROM bits JOIN fit USING (corpus, cap, ov)), pr AS (
      SELECT 'max_tokens' AS axis, l.corpus, l.ov AS held, l.cap AS from_level, h.cap AS to_level, l.doc_id, h.intact::INT - l.intact::INT AS d FROM fb l JOIN fb h ON l.doc_id = h.doc_id AND l.ov = h.ov AND l.cap < h.cap
      UNION ALL SELECT 'overlap_tokens', l.corpus, l.cap, l.ov, h.ov, l.doc_id, h.intact::INT - l.intact::INT FROM fb l JOIN fb h ON l.doc_id = h.doc_id AND l.cap = h.cap AND l.ov < h.ov),
    {ev.weights_sql("doc_id", "documents", "dw", "doc_id")}, {ev._interval_sql("pi", "pr", "axis, corpus, held, from_level, to_level", "d", "doc_id", "dw")},
    a AS (SELECT axis, corpus, held, from_level, to_level, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses, count(*) AS n, round(avg(d), 6) AS m FROM pr GROUP BY ALL)
    SELECT axis, corpus, held::BIGINT AS held, from_level::BIGINT AS from_level, to_level::BIGINT AS to_level, wins::BIGINT AS wins, ties::BIGINT AS ties, losses::BIGINT AS losses, n::BIGINT AS n_shared, m AS mean_delta,
           round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi, round(ci_lo, 6) > 0 OR round(ci_hi, 6) < 0 AS resolved, (round(ci_lo, 6) > 0 OR round(ci_hi, 6) < 0) AND abs(m) >= 0.005 AS material
    FROM a JOIN pi USING (axis, corpus, held, from_level, to_level)""")
def agg_span_axis_effects(spark, sf):
    """Paired over the same questions, with the bootstrap of every other comparison."""
    bits = cut_lineage(span_bits(spark, sf))  # read for the fit cells, and again for their deltas
    return S.paired_summary(cut_lineage(flag_deltas(bits)), ["axis", "corpus", "held", "from_level", "to_level"], unit="doc_id")


@query("span_profiles", """SELECT strategy, cap::BIGINT AS max_tokens, ov::BIGINT AS overlap_tokens, count(*)::BIGINT AS documents
    FROM documents, (VALUES ('recursive'), ('whitespace')) s(strategy), (VALUES (16), (64)) c(cap), (VALUES (0), (8), (32)) o(ov)
    WHERE ov = 0 OR (strategy = 'recursive' AND ov < cap) GROUP BY ALL""")
def span_profiles(spark, sf):
    """The grid of legal profiles, with the documents each would be measured on."""
    grid = F.array(*[
        F.struct(F.lit(s).alias("strategy"), F.lit(c).cast(L).alias("max_tokens"), F.lit(o).cast(L).alias("overlap_tokens"))
        for s, c, o in P.span_profiles(spark, ("recursive", "whitespace"), (16, 64), (0, 8, 32))
    ])
    return t.documents(spark, sf).agg(F.count("*").alias("documents")).select("documents", F.inline(grid))


def passage_questions(spark, sf, cap: int, overlap: int, k: int) -> DataFrame:
    """Passages found in documents as questions: was the document, and was the passage, retrieved?"""
    found = ev.passage_qrels(spark, sf).where("rel = 2").select("qid", "doc_id")
    asked = t.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("passage"))
    docs = t.documents(spark, sf).select("doc_id", "text")
    items = found.join(docs, "doc_id").join(asked, "qid").select(
        "qid", "doc_id", (F.position(F.col("passage"), F.col("text")) - 1).alias("start"),
        (F.position(F.col("passage"), F.col("text")) - 1 + F.length("passage")).alias("end"), P.window_spans(F.col("text"), cap, overlap).alias("spans"),
    )
    hits = exact_topk(
        t.embedded(spark, sf, cap, overlap), t.passages(spark, sf), k, dim=t.DIM, keys=["doc_id", "ordinal"]
    ).select("qid", "doc_id", "ordinal")
    joined = items.join(hits, ["qid", "doc_id"], "left")
    span = F.get("spans", F.col("ordinal"))
    whole = F.coalesce((span["start"] <= F.col("start")) & (span["end"] >= F.col("end")), F.lit(False))
    return joined.groupBy("qid", "doc_id").agg(
        F.bool_or(F.col("ordinal").isNotNull()).alias("doc_hit"), F.bool_or(whole).alias("span_hit"),
        F.bool_or(P.intact(F.col("spans"), F.col("start"), F.col("end"))).alias("somewhere"),
    ).select(F.lit(cap).cast(L).alias("max_tokens"), F.lit(overlap).cast(L).alias("overlap_tokens"), "*")


def _blind_sql(cap: int, ov: int) -> str:
    return rf"""WITH {ev.QRELS_SQL}, {sql.dense_scores_cte(cap=cap, overlap=ov)},
    hits AS (SELECT qid, doc_id, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, ordinal) AS rank FROM scored) WHERE rank <= 20),
    items AS (SELECT qr.qid, qr.doc_id, strpos(d.text, b.text) - 1 AS p, strpos(d.text, b.text) - 1 + length(b.text) AS e FROM qrels qr JOIN documents d USING (doc_id) JOIN benchmark b ON b.item_id = qr.qid WHERE rel = 2),
    tk AS MATERIALIZED (SELECT doc_id, i, length(p) AS flen, length(trim(p, E' \n\t\r')) AS wlen, length(p) - length(ltrim(p, E' \n\t\r')) AS ld
           FROM (SELECT doc_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '^\s*[^\s]+\s*|[^\s]+\s*') AS ps FROM documents WHERE doc_id IN (SELECT doc_id FROM items)))),
    ps AS MATERIALIZED (SELECT doc_id, i, sum(flen) OVER (PARTITION BY doc_id ORDER BY i) - flen + ld AS a, sum(flen) OVER (PARTITION BY doc_id ORDER BY i) - flen + ld + wlen AS z, count(*) OVER (PARTITION BY doc_id) AS n FROM tk),
    wn AS (SELECT doc_id, s // {cap} AS ordinal, greatest(s - {ov}, 0) + 1 AS i0, least(s + {cap}, n) AS i1 FROM (SELECT doc_id, n, unnest(range(0, n, {cap})) AS s FROM (SELECT DISTINCT doc_id, n FROM ps))),
    sp AS (SELECT wn.doc_id, ordinal, x.a AS start, y.z AS "end" FROM wn JOIN ps x ON x.doc_id = wn.doc_id AND x.i = i0 JOIN ps y ON y.doc_id = wn.doc_id AND y.i = i1),
    q AS (SELECT i.qid, i.doc_id, bool_or(h.ordinal IS NOT NULL) AS doc_hit, bool_or(h.ordinal IS NOT NULL AND sp.start <= p AND sp."end" >= e) AS span_hit, bool_or(sp.start <= p AND sp."end" >= e) AS somewhere
          FROM items i JOIN sp USING (doc_id) LEFT JOIN hits h ON h.qid = i.qid AND h.doc_id = i.doc_id AND h.ordinal = sp.ordinal GROUP BY i.qid, i.doc_id)
    SELECT {cap}::BIGINT AS max_tokens, {ov}::BIGINT AS overlap_tokens, count(*)::BIGINT AS n_questions, round(avg(doc_hit::INT), 4) AS doc_hit, round(avg(span_hit::INT), 4) AS span_hit,
           round(avg((doc_hit AND NOT span_hit)::INT), 4) AS blind_spot, round(count(*) FILTER (doc_hit AND NOT span_hit) / greatest(count(*) FILTER (doc_hit), 1), 4) AS blind_share_of_doc_hits,
           round(avg((doc_hit AND NOT span_hit AND NOT somewhere)::INT), 4) AS blind_from_split, round(avg((doc_hit AND NOT span_hit AND somewhere)::INT), 4) AS blind_from_ranking FROM q"""


@query("agg_blind_spot", f"({_blind_sql(64, 0)}) UNION ALL ({_blind_sql(64, 32)})")
def agg_blind_spot(spark, sf):
    plain, over = (passage_questions(spark, sf, 64, o, 20) for o in (0, 32))
    return P.blind_spot(plain.unionByName(over), ["max_tokens", "overlap_tokens"])


@query("chunk_locate_offsets", f"""WITH {sql.chunk_cte(cols='doc_id, lang')} SELECT lang, count(*)::BIGINT AS chunks, count(*)::BIGINT AS as_cut FROM chunks GROUP BY lang""")
def chunk_locate_offsets(spark, sf):
    """Chunks looked up in their documents at the offsets that the cut gives: is it the same text?"""
    docs = t.documents(spark, sf).select("lang", "text", P.window_spans(F.col("text"), 64, 16).alias("spans"))
    texts = F.transform(whitespace_windows(tokens(F.col("text")), 64, 16), lambda w: F.array_join(w, " "))
    same = F.zip_with("spans", texts, lambda s, c: P.text_at(F.col("text"), s) == c)
    return docs.select("lang", F.size("spans").alias("n"), F.size(F.filter(same, lambda x: x)).alias("hit")).groupBy("lang").agg(
        F.sum("n").alias("chunks"), F.sum("hit").alias("as_cut")
    )


# -- cells -----------------------------------------------------------------------------------------


@query("cells_dense_stand_in", f"""WITH {ev.CELLS_SQL}, kept AS (SELECT * FROM cells WHERE NOT (method IS NULL AND embedding = 'hash-16'))
    SELECT cell, method = 'dense' AND regexp_replace(cell, '__dense$', '') NOT IN (SELECT cell FROM kept WHERE method IS NULL) AS stand_in FROM kept WHERE method IS NOT NULL""")
def cells_dense_stand_in(spark, sf):
    """With the narrow embedding's plain cells gone, its dense cells stand in for them."""
    kept = ev.cells(spark, sf).where("NOT (method IS NULL AND embedding = 'hash-16')")
    return E.dense_stand_ins(kept).where("method IS NOT NULL").select("cell", "stand_in")


@query("cells_void", f"""WITH {ev.CELLS_SQL}, {SETS_SQL.replace('tot AS', 'ctot AS').replace('FROM tot', 'FROM ctot').replace('tot.*', 'ctot.*').replace('tot.corpus', 'ctot.corpus').replace('tot.profile', 'ctot.profile')}, {RECUT_SQL},
    clip AS (SELECT corpus, profile, 'hash-16' AS embedding, round(100.0 * (sum(token_count) - sum(least(token_count, 60))) / sum(token_count), 4)::DOUBLE AS lost FROM cs GROUP BY corpus, profile)
    SELECT cell, CASE WHEN m.rows IS NOT NULL THEN 'recut' WHEN clip.lost > 5 THEN 'clipped' ELSE 'kept' END AS verdict FROM cells c LEFT JOIN moved m USING (corpus, profile)
    LEFT JOIN clip ON clip.corpus = c.corpus AND clip.profile = c.profile AND clip.embedding = c.embedding""")
def cells_void(spark, sf):
    """Cells on a re-cut set, or on one whose tokens a 60-token embedder clips, are not published."""
    moved = A.moved_boundaries(recut_sets(spark, sf), APPENDED)
    n = F.col("token_count")
    clipped = chunk_sets(spark, sf).groupBy("corpus", "profile").agg(
        F.round(100.0 * (F.sum(n) - F.sum(F.least(n, F.lit(60)))) / F.sum(n), 4).alias("token_mass_lost_pct")
    ).withColumn("embedding", F.lit("hash-16"))
    judged = E.void_cells(ev.cells(spark, sf), moved, clipped)
    verdict = F.when(F.col("reason").isNull(), "kept").when(F.startswith("reason", F.lit("recut")), "recut").otherwise("clipped")
    return judged.select("cell", verdict.alias("verdict"))


@query("cells_unscored", f"""WITH {ev.CELLS_SQL}, emb AS (SELECT DISTINCT regexp_replace(cell, '__(dense|bm25|hybrid)$', '') AS cell FROM cells), done AS (SELECT DISTINCT regexp_replace(cell, '__dense$', '') AS cell FROM cells WHERE recall > 0),
    miss AS (SELECT cell FROM emb WHERE cell NOT IN (SELECT cell FROM done)), wh AS (SELECT cell, 'too wide a cap' AS reason FROM cells WHERE method IS NULL AND max_tokens = 128)
    SELECT coalesce(miss.cell, wh.cell) AS cell, CASE WHEN miss.cell IS NULL THEN 'stale' WHEN reason IS NULL THEN 'unscored' ELSE 'withheld' END AS status, reason FROM miss FULL JOIN wh ON miss.cell = wh.cell""")
def cells_unscored(spark, sf):
    """Embedded cells without a score that found anything; the wide caps are withheld on purpose."""
    rows = ev.cells(spark, sf)
    embedded = rows.select(F.regexp_replace("cell", "__(dense|bm25|hybrid)$", "").alias("cell")).distinct()
    withheld = rows.where("method IS NULL AND max_tokens = 128").select("cell", F.lit("too wide a cap").alias("reason"))
    return E.unscored_cells(embedded, rows.where("recall > 0"), withheld)


@query("cells_reject_foreign", f"""WITH {ev.CELLS_SQL} SELECT corpus, corpus NOT IN ({", ".join(f"'{c}'" for c in DECLARED)}) AS rejected, count(*)::BIGINT AS cells FROM cells GROUP BY ALL""")
def cells_reject_foreign(spark, sf, declared=DECLARED):
    """The cells of the declared corpora, and beside them those that a report may not name."""
    kept, foreign = E.reject_foreign(ev.cells(spark, sf), declared)
    both = kept.withColumn("rejected", F.lit(False)).unionByName(foreign.withColumn("rejected", F.lit(True)))
    return both.groupBy("corpus", "rejected").agg(F.count("*").alias("cells"))


@query("cells_provenance", """SELECT '{"box":"' || event_type || '","measured_utc":"' || strftime(date_trunc('month', ts), '%Y-%m') || '"}' AS run, count(*)::BIGINT AS cells FROM events WHERE event_type <> 'error' GROUP BY ALL""")
def cells_provenance(spark, sf):
    """Events as measurements: the month and type stamp a run; errors recorded no stamp."""
    stamp = F.struct(F.col("event_type").alias("box"), F.date_format("ts", "yyyy-MM").alias("measured_utc"))
    rows = t.table(spark, sf, "events").withColumn("measured_on", F.when(F.col("event_type") != "error", stamp))
    return E.provenance(rows).select("run", "cells")


@query("cell_catalog", f"WITH {ev.CELLS_SQL} SELECT cell, corpus, profile, embedding, dim::INT AS dim, n_queries::BIGINT AS n_queries FROM cells")
def cell_catalog(spark, sf):
    """Every cell's manifest, written as JSON files and scanned back into one catalogue."""
    path = hygiene.scratch(spark, "manifests")
    ev.cells(spark, sf).select("cell", "corpus", "profile", "embedding", "dim", "n_queries").write.json(path)
    schema = "cell string, corpus string, profile string, embedding string, dim int, n_queries long"
    return spark.read.schema(schema).json(path)


# -- markdown twins --------------------------------------------------------------------------------


@query("heading_marks_by_source", f"""WITH {hygiene.HEADING_SQL} SELECT lang, sum(headings)::BIGINT AS headings, count(*) FILTER (headings > 0)::BIGINT AS documents FROM marked GROUP BY lang""")
def heading_marks_by_source(spark, sf):
    from corvane.operators.chunking import heading_count

    rows = t.documents(spark, sf).select("lang", heading_count(F.col("text")).alias("h"))
    return rows.groupBy("lang").agg(F.sum("h").alias("headings"), F.count_if(F.col("h") > 0).alias("documents"))


