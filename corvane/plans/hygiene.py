"""Document plans: extraction, routing, sanitizing, chunking, and the scans that feed them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.functions.rows import fan_out
from corvane.functions.text import doc_id_of, doc_uri, file_uri, let, path_of, snippet, strip, tokens, truncate_words
from corvane.operators import chunking as C
from corvane.operators.embed import embed_once, hash_embedder, leading_sentences
from corvane.operators.extract import HTML_RULES, LINE_BLANKS, NAMED, Route, extract_html, extract_text, route_backend
from corvane.operators.lexical import language_of
from corvane.operators.sanitize import SanitizeOptions, sanitize
from corvane.operators.splitters import split_documents
from corvane.plans import sql
from corvane.plans import tables as t
from corvane.plans.registry import query
from corvane.schema import ExtractorBackend
from corvane.session import cut_lineage, shared_folder
from corvane.sources.corpora import layout_blocks, read_chunk_file, squad_items, trec_qrels

L = "long"


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/corvane/{name}-{uuid.uuid4().hex}"


# -- sources ---------------------------------------------------------------------------------------


@query("src_docid_uri", "SELECT doc_id, source, 'doc://' || source || '%2F' || lang || '%20' || doc_id AS uri, source || '/' || lang || ' ' || doc_id AS decoded FROM documents")
def src_docid_uri(spark, sf):
    """A reversible URI from an id that needs escaping, and the id read back from it."""
    ids = t.documents(spark, sf).withColumn("id", F.concat("source", F.lit("/"), "lang", F.lit(" "), F.col("doc_id").cast("string")))
    return ids.withColumn("uri", doc_uri(F.col("id"))).select("doc_id", "source", "uri", doc_id_of(F.col("uri")).alias("decoded"))


@query("src_uri", "SELECT doc_id, 'file:///srv/' || source || '/' || lang || '%20notes/' || doc_id || '.md' AS uri, '/srv/' || source || '/' || lang || ' notes/' || doc_id || '.md' AS path FROM documents")
def src_uri(spark, sf):
    """File URIs: dots resolved as text, blanks percent-encoded, and the path read back."""
    messy = F.concat(F.lit("/srv/./old/../"), "source", F.lit("//"), "lang", F.lit(" notes/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return t.documents(spark, sf).select("doc_id", file_uri(messy).alias("uri")).withColumn("path", path_of(F.col("uri")))


@query("scan_chunks_parquet", f"""WITH {sql.chunk_cte()}
    SELECT 'doc://' || doc_id AS source_uri, count(*)::BIGINT AS chunks, sum(len(toks))::BIGINT AS tokens FROM chunks GROUP BY ALL""")
def scan_chunks_parquet(spark, sf):
    """A chunk set is written as Parquet once; the scan then reads two of its four columns."""
    path = scratch(spark, "chunks")
    t.chunks(spark, sf).select(
        "text", doc_uri(F.col("doc_id")).alias("source_uri"), F.col("ordinal").cast("int").alias("ordinal"),
        F.col("token_count").cast("int").alias("token_count"),
    ).write.parquet(path)
    cached = read_chunk_file(spark, path)
    return cached.groupBy("source_uri").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))


@query("scan_cell_vectors", f"""WITH {sql.VECTORS_CTE}
    SELECT vec_id, label::BIGINT AS label, len(v)::BIGINT AS dim, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM vecs""")
def scan_cell_vectors(spark, sf):
    return t.vectors(spark, sf).select(
        "vec_id", F.col("label").cast(L).alias("label"), F.size("vector").cast(L).alias("dim"),
        F.round(V.norm(F.col("vector")), 6).alias("norm"),
    )


@query("scan_jsonl_corpus", """SELECT conv_id::VARCHAR AS doc_id, length(text)::BIGINT AS chars, text FROM (
    SELECT conv_id, trim(role || ' ' || text, E' \\n\\t\\r') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1""")
def scan_jsonl_corpus(spark, sf):
    """Conversation turns as corpus lines: a repeated id keeps its last line."""
    from corvane.sources.corpora import corpus_documents

    lines = t.table(spark, sf, "conversations").select(
        F.col("turn").alias("position"),
        F.to_json(F.struct(F.col("conv_id").cast("string").alias("_id"), F.col("role").alias("title"), "text")).alias("value"),
    )
    return corpus_documents(lines).select("doc_id", F.length("text").cast(L).alias("chars"), "text")


@query("scan_trec_qrels", "SELECT toxic::VARCHAR AS qid, 'doc://' || doc_id AS doc_id, quality::INT AS rel FROM labels WHERE quality > 0")
def scan_trec_qrels(spark, sf):
    lines = t.table(spark, sf, "labels").select(
        F.concat_ws("\t ", F.col("toxic").cast("string"), F.lit("0"), doc_uri(F.col("doc_id")), F.col("quality").cast("string")).alias("value")
    )
    return trec_qrels(lines)


def answer_rows(spark, sf):
    """Documents as question rows: the answer is a document's middle eight words.

    Each row offers the offset first one character late and then right; documents judged toxic
    offer only the late one, so that unverifiable answers occur.
    """
    words = t.documents(spark, sf).join(t.table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return words.withColumn("_a", middle_words(F.col("text"))).where(F.length("_a") > 0).select(
        "doc_id", "lang", F.col("text").alias("context"), F.concat(F.lit("what follows "), F.substring("_a", 1, 12)).alias("question"),
        F.struct(
            F.when(F.col("toxic") == 1, F.array("_a")).otherwise(F.array("_a", "_a")).alias("text"),
            F.when(F.col("toxic") == 1, F.array(F.position(F.col("_a"), F.col("text"))))
            .otherwise(F.array(F.position(F.col("_a"), F.col("text")), F.position(F.col("_a"), F.col("text")) - 1)).alias("answer_start"),
        ).alias("answers"),
    )


def middle_words(text):
    """The middle eight words of a text as they stand in it, with the blanks between them; empty without words."""
    def run(pieces):
        return strip(F.array_join(F.slice(pieces, F.greatest(F.floor(F.size(pieces) / 2).cast("int") - 3, F.lit(1)), 8), ""))

    return F.coalesce(let(C.token_pieces(text), run), F.lit(""))


MIDDLE_SQL = rf"""mid AS (
      SELECT doc_id, lang, text, trim(array_to_string(list_slice(t, greatest(len(t) // 2 - 3, 1), greatest(len(t) // 2 - 3, 1) + 7), ''), E' \t\n\r\x0b\x0c') AS a
      FROM (SELECT doc_id, lang, text, regexp_extract_all(text, '^\s*[^\s]+\s*|[^\s]+\s*') AS t FROM documents)),
    qa AS (SELECT m.*, coalesce(l.toxic, 0) AS toxic, strpos(text, a) - 1 AS p FROM mid m LEFT JOIN labels l USING (doc_id) WHERE length(a) > 0)"""


@query("scan_squad_report", f"""WITH {MIDDLE_SQL},
    v AS (SELECT documents.doc_id, a, CASE WHEN substr(qa.text, p + 2, length(a)) = a THEN p + 1 WHEN toxic = 0 THEN p END AS s FROM documents LEFT JOIN qa USING (doc_id))
    SELECT CASE WHEN a IS NULL THEN 'no words' WHEN s IS NULL THEN 'answer not at its offset' ELSE 'verified' END AS outcome, count(*)::BIGINT AS documents FROM v GROUP BY ALL""")
def scan_squad_report(spark, sf):
    """What became of every document as a question row; the counts add up to the table."""
    found = squad_items(answer_rows(spark, sf), "doc_id").select("doc_id", F.lit(True).alias("asked"), "answer")
    rows = t.documents(spark, sf).select("doc_id").join(found, "doc_id", "left")
    outcome = F.when(F.col("asked").isNull(), "no words").when(F.col("answer").isNull(), "answer not at its offset").otherwise("verified")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("documents"))


@query("scan_squad", f"""WITH {MIDDLE_SQL},
    c AS (SELECT text, min(doc_id) AS context_id FROM qa GROUP BY text),
    v AS (SELECT doc_id, context_id, a, CASE WHEN substr(text, p + 2, length(a)) = a THEN p + 1 WHEN toxic = 0 THEN p END AS s FROM qa JOIN c USING (text))
    SELECT doc_id, context_id, CASE WHEN s IS NOT NULL THEN a END AS answer, s::INT AS start, (s + length(a))::INT AS "end" FROM v""")
def scan_squad(spark, sf):
    return squad_items(answer_rows(spark, sf), "doc_id").drop("question")


@query("scan_layout_json", rf"""WITH l AS (
      SELECT doc_id, i, trim(string_split(text, chr(10))[i], E' \t\r\n') AS line, length(string_split(text, chr(10))[i]) AS n, len(string_split(text, chr(10))) AS total
      FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
    SELECT doc_id, count(*)::BIGINT AS blocks, string_agg(line, '|' ORDER BY i DESC) AS text FROM l
    WHERE n <= 400 AND length(line) >= 20 AND line NOT LIKE '%.' GROUP BY doc_id""")
def scan_layout_json(spark, sf):
    """Document lines as annotated page regions (bottom-up order; prose ending in a stop is ignored)."""
    lines = F.split("text", "\n", -1)
    layout = F.to_json(F.transform(lines, lambda x, i: F.struct(
        F.when(F.length(x) > 400, "figure").when(F.length(x) < 80, "title").otherwise("text_block").alias("category_type"),
        x.alias("text"), F.endswith(F.trim(x), F.lit(".")).alias("ignore"), (F.lit(0.0) - i).alias("order"),
    )))
    pages = t.documents(spark, sf).select("doc_id", layout_blocks(layout).alias("b")).where(F.size("b") > 0)
    return pages.select("doc_id", F.size("b").cast(L).alias("blocks"), F.array_join("b", "|").alias("text"))


def source_files(spark, sf) -> str:
    """The documents as files, one text file per source with a line per document, in order of their ids."""
    folder = scratch(spark, "files")
    lines = t.documents(spark, sf).select("source", "doc_id", F.regexp_replace("text", "[\\n\\r]", " ").alias("value"))
    ordered = lines.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "value")
    ordered.write.partitionBy("source").text(folder)
    return folder


FILES_SQL = """WITH d AS (SELECT source, string_agg(regexp_replace(text, '[\n\r]', ' ', 'g') || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY source)
    SELECT source, sha256(content) AS content_hash, octet_length(encode(content))::BIGINT AS size FROM d"""


def _source_of(uri):
    return F.regexp_extract(F.url_decode(uri), "source=([^/]*)/", 1)


@query("src_discover", FILES_SQL)
def src_discover(spark, sf):
    """Files listed by Spark and hashed block by block, the second time only those whose size or time is another: half of
    the files are known with their hashes, half of the known ones with a time that has changed since."""
    from corvane.sources.files import discover

    folder = source_files(spark, sf)
    first = cut_lineage(discover(spark, [folder]))
    half = first.where(F.xxhash64("uri") % 2 == 0).withColumn("mtime", F.when(F.xxhash64("uri") % 4 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")))
    again = discover(spark, [folder], known=half)
    return again.select(_source_of(F.col("uri")).alias("source"), "content_hash", "size")


@query("src_connector", FILES_SQL)
def src_connector(spark, sf):
    """The same files through the registered data source, which deals them to its tasks by size."""
    from corvane.sources.connector import FileListing

    spark.dataSource.register(FileListing)
    listed = spark.read.format("corvane_files").option("paths", source_files(spark, sf)).option("extensions", ".txt").load()
    return listed.select(_source_of(F.col("uri")).alias("source"), "content_hash", "size")


# -- extraction and routing ------------------------------------------------------------------------


@query("extract_text", "SELECT doc_id, NULL::VARCHAR AS error, length(text)::BIGINT AS chars FROM documents")
def extract_text_plan(spark, sf):
    files = t.documents(spark, sf).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return extract_text(files).select("doc_id", "error", F.length("text").cast(L).alias("chars"))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def html_sql(html: str) -> str:
    """The text of a page, for pages without numbered characters."""
    for pattern, instead in HTML_RULES:
        html = f"regexp_replace({html}, {_sql_text(pattern)}, {_sql_text(instead)}, 'g')"
    for name, letter in NAMED.items():
        html = f"replace({html}, '&{name};', {_sql_text(letter)})"
    lines = f"list_transform(string_split({html}, chr(10)), lambda x: trim(regexp_replace(x, '{LINE_BLANKS}', ' ', 'g'), ' '))"
    return f"array_to_string(list_filter({lines}, lambda x: x <> ''), chr(10))"


@query("extract_html", f"SELECT page_id, url, {html_sql('html')} AS text FROM pages")
def extract_html_plan(spark, sf):
    return t.spread(t.table(spark, sf, "pages")).select("page_id", "url", extract_html(F.col("html")).alias("text"))


ROUTES = (
    Route("en", ExtractorBackend.TEXT),
    Route("en/src1", ExtractorBackend.DOCLING),
    Route("de", None, ExtractorBackend.OLMOCR),
    Route("fr", None, ExtractorBackend.XBERG),
    Route("en/src1", ExtractorBackend.MINERU),
)


@query("route_extractor", """WITH f AS (SELECT doc_id, lang, source, text,
      CASE lang WHEN 'en' THEN '.md' WHEN 'fr' THEN '.pdf' WHEN 'de' THEN '.png' ELSE '.html' END AS suffix FROM documents)
    SELECT doc_id, suffix, CASE
      WHEN suffix = '.png' THEN 'olmocr'
      WHEN suffix = '.pdf' AND length(trim(text, E' \\n\\t\\r')) < 400 THEN 'xberg'
      WHEN lang = 'en' AND source = 'src1' THEN 'docling'
      WHEN lang = 'en' THEN 'text'
      ELSE 'markitdown' END AS backend FROM f""")
def route_extractor(spark, sf):
    suffix = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "fr", ".pdf").when(F.col("lang") == "de", ".png").otherwise(".html")
    files = t.documents(spark, sf).withColumn("suffix", suffix)
    uri = file_uri(F.concat(F.lit("/data/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), "suffix"))
    return files.select("doc_id", "suffix", route_backend(uri, F.col("text"), roots=["/data"], routes=ROUTES, scan_min_chars=400).alias("backend"))


# -- sanitizing ------------------------------------------------------------------------------------

# Looser than the defaults: the given documents are prose, and merging needs several junk windows.
LOOSE = SanitizeOptions(whitespace_ratio_min=0.14, symbol_ratio_max=0.06, word_length_max=6.2, min_detectors=2)


def _spans_sql(ws: float, sym: float, word: float, trips: int) -> str:
    return rf"""w AS (SELECT doc_id, source, s // 400 AS i, s, substr(text, s + 1, 400) AS w
      FROM (SELECT doc_id, source, text, unnest(range(0, length(text), 400)) AS s FROM documents)),
    m AS (SELECT *, length(w) AS n, len(regexp_extract_all(w, '\s')) AS b, len(regexp_extract_all(w, '[^\p{{L}}\p{{N}}\s]')) AS y,
            len(regexp_extract_all(w, '[^\s]+')) AS k FROM w),
    j AS (SELECT *, (b / n < {ws})::INT + (y / n > {sym})::INT + (CASE WHEN k > 0 THEN (n - b) / k ELSE n END > {word})::INT >= {trips} AS junk FROM m),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM j WHERE junk),
    spans AS (SELECT doc_id, source, min(s) AS start, max(s + n) AS "end" FROM g GROUP BY doc_id, source, grp HAVING max(s + n) - min(s) >= 400)"""


LOOSE_SQL = _spans_sql(0.14, 0.06, 6.2, 2)


@query("sanitize_detect", f"""WITH {LOOSE_SQL} SELECT doc_id, start::BIGINT AS start, "end"::BIGINT AS "end" FROM spans""")
def sanitize_detect(spark, sf):
    found = fan_out(sanitize(t.documents(spark, sf), LOOSE), ["doc_id"], F.col("spans"), "s")
    return found.select("doc_id", F.col("s.start").cast(L).alias("start"), F.col("s.end").cast(L).alias("end"))


@query("sanitize_strip", f"""WITH {LOOSE_SQL},
    kept AS (SELECT w.doc_id, string_agg(w.w, '' ORDER BY w.i) AS t FROM w
             WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = w.doc_id AND w.s >= s.start AND w.s < s."end") GROUP BY w.doc_id)
    SELECT d.doc_id, md5(coalesce(t, '')) AS kept_md5, length(coalesce(t, ''))::BIGINT AS kept_chars FROM documents d LEFT JOIN kept USING (doc_id)""")
def sanitize_strip(spark, sf):
    clean = sanitize(t.documents(spark, sf), LOOSE, mode="strip")
    return clean.select("doc_id", F.md5("text").alias("kept_md5"), F.length("text").cast(L).alias("kept_chars"))


@query("sanitize_report", f"""WITH {_spans_sql(0.08, 0.35, 15.0, 2)}, {LOOSE_SQL.replace('w AS', 'w2 AS').replace('FROM w)', 'FROM w2)').replace('m AS', 'm2 AS').replace('FROM m)', 'FROM m2)').replace('j AS', 'j2 AS').replace('FROM j WHERE', 'FROM j2 WHERE').replace('g AS', 'g2 AS').replace('FROM g GROUP', 'FROM g2 GROUP').replace('spans AS', 'spans2 AS')}
    SELECT source, 'default' AS options, 'dry_run' AS mode, count(*)::BIGINT AS spans, sum("end" - start)::BIGINT AS removed_chars FROM spans GROUP BY source
    UNION ALL SELECT source, 'loose', 'strip', count(*), sum("end" - start)::BIGINT FROM spans2 GROUP BY source""")
def sanitize_report(spark, sf):
    parts = []
    for name, options, mode in (("default", SanitizeOptions(), "dry_run"), ("loose", LOOSE, "strip")):
        found = sanitize(t.documents(spark, sf), options, mode=mode).where(F.size("spans") > 0)
        parts.append(found.groupBy("source").agg(
            F.lit(name).alias("options"), F.lit(mode).alias("mode"), F.sum(F.size("spans")).alias("spans"),
            F.sum("removed_chars").alias("removed_chars"),
        ))
    return parts[0].unionByName(parts[1])


# -- chunking --------------------------------------------------------------------------------------

CHUNK_OUT = "SELECT doc_id, ordinal::BIGINT AS ordinal, len(toks)::BIGINT AS token_count, md5(array_to_string(toks, ' ')) AS text_md5 FROM chunks"


def _chunk_out(df):
    return df.select("doc_id", F.col("ordinal").cast(L).alias("ordinal"), F.col("token_count").cast(L).alias("token_count"), F.md5("text").alias("text_md5"))


@query("chunk_whitespace", f"WITH {sql.chunk_cte()} {CHUNK_OUT}")
def chunk_whitespace_plan(spark, sf):
    return _chunk_out(t.chunks(spark, sf))


@query("chunk_overlap", f"WITH {sql.chunk_cte(overlap=16)} {CHUNK_OUT}")
def chunk_overlap_plan(spark, sf):
    """Context appended to chunks already fixed; the cuts stay where they were."""
    return _chunk_out(t.chunks(spark, sf, overlap=16))


# Oversized input: every line of a document as one chunk, recorded with one token more than it has.
LINES_SQL = rf"""lines AS (SELECT doc_id, i - 1 AS ordinal, string_split(text, chr(10))[i] AS text
      FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    sized AS (SELECT doc_id, ordinal, text, len({sql.toks('text')}) + 1 AS token_count,
                     regexp_extract_all(text, '^\s*[^\s]+\s*|[^\s]+\s*') AS ps FROM lines),
    win AS (SELECT *, len(ps) AS n, CASE WHEN len(ps) <= 20 THEN greatest(1, ceil(len(ps) / ceil(token_count / 20.0))) ELSE 20 END::INT AS wn FROM sized),
    whole AS (SELECT doc_id, ordinal, 0 AS piece, token_count, text, TRUE AS uncut FROM win WHERE token_count <= 20 OR n <= 1),
    cut AS (SELECT doc_id, ordinal, s // wn AS piece, len(list_slice(ps, s + 1, s + wn)) AS token_count, array_to_string(list_slice(ps, s + 1, s + wn), '') AS text, FALSE AS uncut
            FROM (SELECT *, unnest(range(0, n, wn)) AS s FROM win WHERE token_count > 20 AND n > 1)),
    pieces AS (SELECT * FROM whole UNION ALL SELECT * FROM cut)"""


def line_chunks(spark, sf):
    lines = fan_out(t.documents(spark, sf), ["doc_id"], F.split("text", "\n", -1), "text", "ordinal")
    return lines.withColumn("token_count", F.size(tokens(F.col("text"))) + 1)


@query("chunk_split_oversized", f"WITH {LINES_SQL} SELECT doc_id, ordinal::BIGINT AS ordinal, piece::BIGINT AS piece, token_count::BIGINT AS token_count, md5(text) AS text_md5 FROM pieces")
def chunk_split_oversized(spark, sf):
    return C.split_oversized(line_chunks(spark, sf), 20).select(
        "doc_id", F.col("ordinal").cast(L).alias("ordinal"), F.col("piece").cast(L).alias("piece"),
        F.col("token_count").cast(L).alias("token_count"), F.md5("text").alias("text_md5"),
    )


@query("chunk_plan_repair", f"""WITH {LINES_SQL}, p AS (SELECT *, count(*) OVER (PARTITION BY doc_id, ordinal) AS np FROM pieces)
    SELECT doc_id, ordinal::BIGINT AS ordinal, piece::BIGINT AS piece, CASE WHEN np = 1 THEN ordinal ELSE -1 END::BIGINT AS carry, token_count::BIGINT AS token_count FROM p""")
def chunk_plan_repair(spark, sf):
    return C.plan_repair(line_chunks(spark, sf), 20).select(
        "doc_id", *[F.col(c).cast(L).alias(c) for c in ("ordinal", "piece", "carry", "token_count")]
    )


@query("chunk_drop_empty_renumber", rf"""WITH l AS (SELECT doc_id, i, string_split(text, chr(10))[i] AS line
      FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS ordinal, md5(line) AS text_md5 FROM l WHERE regexp_matches(line, '[^\s]')""")
def chunk_drop_empty_renumber(spark, sf):
    pairs = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("text"), F.size(tokens(x)).alias("token_count")))
    kept = fan_out(t.documents(spark, sf), ["doc_id"], C.drop_empty_renumber(pairs), "p", "ordinal")
    return kept.select("doc_id", F.col("ordinal").cast(L).alias("ordinal"), F.md5("p.text").alias("text_md5"))


HEADING_SQL = rf"""l AS (SELECT doc_id, lang, i, string_split(text, chr(10))[i] AS line
      FROM (SELECT doc_id, lang, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
    nx AS (SELECT *, first_value(CASE WHEN regexp_matches(line, '[^\s]') THEN line END IGNORE NULLS)
                     OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nl FROM l),
    h AS (SELECT *, coalesce(nl IS NOT NULL AND regexp_matches(line, '[^\s]') AND length(line) <= 79 AND NOT starts_with(line, '## ')
                AND NOT regexp_matches(line, '^[-*•]') AND NOT regexp_matches(line, '[.,;:!?)]$') AND length(line) - length(replace(line, ' ', '')) <= 8
                AND NOT regexp_matches(line, '[=→+]') AND NOT regexp_matches(line, '[0-9][0-9][0-9]')
                AND length(nl) >= 120 AND regexp_matches(nl, '[.")]$'), FALSE) AS heading FROM nx),
    marked AS (SELECT doc_id, lang, string_agg(CASE WHEN heading THEN '## ' ELSE '' END || line, chr(10) ORDER BY i) AS text, count(*) FILTER (heading) AS headings FROM h GROUP BY ALL)"""


@query("mark_headings", f"WITH {HEADING_SQL} SELECT doc_id, headings::BIGINT AS headings, md5(text) AS text_md5 FROM marked")
def mark_headings_plan(spark, sf):
    return t.documents(spark, sf).select(
        "doc_id", C.heading_count(F.col("text")).cast(L).alias("headings"), F.md5(C.mark_headings(F.col("text"))).alias("text_md5")
    )


@query("strip_marks", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def strip_marks_plan(spark, sf):
    """Marking and then stripping gives every document back."""
    return t.documents(spark, sf).select("doc_id", F.md5(C.strip_marks(C.mark_headings(F.col("text")))).alias("text_md5"))


@query("heading_start_share", f"""WITH {HEADING_SQL}, {sql.chunk_cte(src='marked', cols='doc_id, lang')}
    SELECT lang, count(*)::BIGINT AS chunks, round(avg(starts_with(array_to_string(toks, ' '), '## ')::INT), 6) AS share FROM chunks GROUP BY lang""")
def heading_start_share(spark, sf):
    marked = t.documents(spark, sf).select("doc_id", "lang", C.mark_headings(F.col("text")).alias("text"))
    chunks = C.chunk_whitespace(marked, t.CAP)
    return chunks.groupBy("lang").agg(
        F.count("*").alias("chunks"), F.round(F.avg(F.startswith("text", F.lit(C.MARK)).cast("int")), 6).alias("share")
    )


@query("query_truncate", f"SELECT item_id AS qid, array_to_string(list_slice({sql.toks('text')}, 1, 8), ' ') AS text FROM benchmark")
def query_truncate(spark, sf):
    return t.table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), truncate_words(F.col("text"), 8).alias("text"))


@query("snippet", f"""SELECT doc_id, CASE WHEN length(f) <= 80 THEN f ELSE substr(f, 1, 80) || '...' END AS snippet
    FROM (SELECT doc_id, array_to_string({sql.toks('text')}, ' ') AS f FROM documents)""")
def snippet_plan(spark, sf):
    return t.documents(spark, sf).select("doc_id", snippet(F.col("text")).alias("snippet"))


for _strategy in ("recursive", "markdown", "fast", "semantic"):

    def _split_plan(spark, sf, strategy=_strategy):
        docs = t.documents(spark, sf).select("doc_id", "lang", "text")
        return split_documents(docs, strategy, max_tokens=t.CAP, overlap=8 if strategy != "semantic" else 0)

    query(f"chunk_{_strategy}")(_split_plan)


@query("chunk_fallback", f"WITH {sql.chunk_cte()} {CHUNK_OUT}")
def chunk_fallback(spark, sf):
    """A strategy this installation lacks falls back to whitespace windows, with a warning."""
    docs = t.documents(spark, sf).select("doc_id", "lang", "source", "text")
    return _chunk_out(split_documents(docs, "not-installed", max_tokens=t.CAP))


# -- embedding -------------------------------------------------------------------------------------


@query("embed_placeholder", f"""WITH d AS (SELECT doc_id, {sql.toks('text')} AS toks FROM documents), {sql.bag_cte('bag', 'd', 'doc_id', 'toks', 64)}
    SELECT doc_id, b::BIGINT AS bucket, round(c / n, 6) AS weight FROM bag JOIN bag_n USING (doc_id)""")
def embed_placeholder(spark, sf):
    docs = t.documents(spark, sf).select("doc_id", hash_embedder(64, "md5")(F.col("text")).alias("v"))
    cells = fan_out(docs, ["doc_id"], F.col("v"), "weight", "bucket").where("weight > 0")
    return cells.select("doc_id", F.col("bucket").cast(L).alias("bucket"), F.round("weight", 6).alias("weight"))


@query("embed_hash_default")
def embed_hash_default(spark, sf):
    """The default embedder (256 buckets by BLAKE2b) over every document."""
    return t.documents(spark, sf).select("doc_id", hash_embedder()(F.col("text")).alias("vector"))


@query("embed_query_once_per_model", f"""WITH q AS (SELECT DISTINCT lower(event_type) AS text FROM events), {sql.bag_cte('bag', 'q', 'text', "[text]", 64)}
    SELECT event_type, event_type || '-model' AS model_key, count(*)::BIGINT AS requests, 1.0::DOUBLE AS norm FROM events GROUP BY event_type""")
def embed_query_once_per_model(spark, sf):
    """Every event as a search request: each distinct (model, text) is embedded once."""
    requests = t.table(spark, sf, "events").select("event_id", "event_type", F.concat("event_type", F.lit("-model")).alias("model_key"))
    answered = embed_once(requests, "event_type", ["model_key"], hash_embedder(64, "md5"))
    return answered.groupBy("event_type", "model_key").agg(
        F.count("*").alias("requests"), F.round(F.max(V.norm(F.col("vector"))), 6).alias("norm")
    )


@query("vector_normalize", f"""WITH {sql.VECTORS_CTE}
    SELECT vec_id, i::BIGINT AS at, round(3 * v[i + 1] / sqrt(9 * list_inner_product(v, v)), 6) AS x FROM (SELECT vec_id, v, unnest(range(0, len(v))) AS i FROM vecs)""")
def vector_normalize(spark, sf):
    scaled = t.vectors(spark, sf).select("vec_id", F.transform("vector", lambda x: x * 3).alias("v"))
    cells = fan_out(scaled, ["vec_id"], V.normalize(F.col("v")), "x", "at")
    return cells.select("vec_id", F.col("at").cast(L).alias("at"), F.round("x", 6).alias("x"))


@query("vector_truncate", f"""WITH {sql.VECTORS_CTE}, p AS (SELECT vec_id, list_slice(v, 1, 16) AS v FROM vecs)
    SELECT vec_id, i::BIGINT AS at, round(v[i + 1] / sqrt(list_inner_product(v, v)), 6) AS x FROM (SELECT vec_id, v, unnest(range(0, len(v))) AS i FROM p)""")
def vector_truncate(spark, sf):
    cells = fan_out(t.vectors(spark, sf), ["vec_id"], V.truncate(F.col("vector"), 16), "x", "at")
    return cells.select("vec_id", F.col("at").cast(L).alias("at"), F.round("x", 6).alias("x"))


@query("embed_truncation_audit", f"""WITH {sql.chunk_cte(cap=128)},
    c AS (SELECT lang, len(toks) AS n, least(len(toks), 100) AS kept, length(array_to_string(toks, ' ')) AS chars FROM chunks)
    SELECT lang, count(*)::BIGINT AS chunks, count(*) FILTER (kept < n)::BIGINT AS truncated, round(100.0 * count(*) FILTER (kept < n) / count(*), 4)::DOUBLE AS truncated_pct,
           round(100.0 * (sum(n) - sum(kept)) / sum(n), 4)::DOUBLE AS token_mass_lost_pct, max(n)::BIGINT AS max_tokens_full, (100 - max(n))::BIGINT AS headroom_tokens,
           max(chars)::BIGINT AS max_chars FROM c GROUP BY lang""")
def embed_truncation_audit(spark, sf):
    return truncation_audit(t.chunks(spark, sf, 128), ["lang"], 100)


def truncation_audit(chunks, by, token_cap: int):
    """What an embedder's input cap clips, per group: one mergeable aggregation."""
    n = F.col("token_count")
    kept = F.least(n, F.lit(token_cap))
    return chunks.groupBy(*by).agg(
        F.count("*").alias("chunks"),
        F.count_if(kept < n).alias("truncated"),
        F.round(100.0 * F.count_if(kept < n) / F.count("*"), 4).alias("truncated_pct"),
        F.round(100.0 * (F.sum(n) - F.sum(kept)) / F.sum(n), 4).alias("token_mass_lost_pct"),
        F.max(n).cast(L).alias("max_tokens_full"),
        (F.lit(token_cap) - F.max(n)).cast(L).alias("headroom_tokens"),
        F.max(F.length("text")).cast(L).alias("max_chars"),
    )


@query("summarize", f"""WITH {sql.chunk_cte(cap=256, cols='doc_id, text')}
    SELECT doc_id, ordinal::BIGINT AS ordinal, trim(array_to_string(list_slice(regexp_extract_all(text, '[^.!?]+[.!?]*'), 1, 2), '')) AS summary FROM chunks""")
def summarize(spark, sf):
    """The offline summary, taken per document and carried by each of its chunks."""
    docs = t.documents(spark, sf).select("doc_id", "text", leading_sentences(F.col("text")).alias("summary"))
    return C.chunk_whitespace(docs, 256).select("doc_id", F.col("ordinal").cast(L).alias("ordinal"), "summary")


@query("language_of", "SELECT doc_id, 'docs_' || lang || '_slice' AS corpus, CASE WHEN lang = 'de' THEN 'german' ELSE 'english' END AS language FROM documents")
def language_of_plan(spark, sf):
    named = t.documents(spark, sf).select("doc_id", F.concat(F.lit("docs_"), "lang", F.lit("_slice")).alias("corpus"))
    return named.withColumn("language", language_of(F.col("corpus")))
