"""The registered queries of the operators, and their SQL twins where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import documents

QUERIES = {}
ORACLES = {}

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            ORACLES[name] = sql
        return plan

    return register


@query("op1_ngram_jaccard_join")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    from corvane.llm.jaccard import near_components

    return near_components(documents(spark, sf))


@query("op2_document_fingerprints")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    from corvane.llm.merkle import fingerprints

    return fingerprints(documents(spark, sf))


@query("op3_personal_data")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    from corvane.llm.pii import report

    return report(documents(spark, sf))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Expected grade of every document, the chances of a grade above 0 and above 1, and whether it is kept."""
    from corvane.llm.quality import score

    out = score(documents(spark, sf), rated_model(spark, sf))
    return out.select("doc_id", "expected_grade", F.col("tail")[0].alias("p_good"), F.col("tail")[1].alias("p_clean"), (F.col("tail")[1] >= 0.5).alias("kept"))


def rated_model(spark: SparkSession, sf: str):
    """A model fitted to the labels of the documents table."""
    from corvane.llm.quality import fit, grades

    return fit(documents(spark, sf), grades(spark.read.parquet(f"{sf}/labels.parquet")), 3)


@query("op5_best_fit_packing")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    from corvane.llm.packing import pack

    return pack(documents(spark, sf), *packing_files())


def packing_files() -> tuple[str, tuple[str, str]]:
    import public_tokenizers

    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return public_tokenizers.path("byte_bpe_50k.json"), ranks


@query(
    "op7_line_dedup",
    sql=f"""
    WITH l AS (
      SELECT doc_id, t.i AS i, t.line AS line,
        {LOWER.format("trim(t.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents) d,
        LATERAL (SELECT unnest(d.lines) AS line, generate_subscripts(d.lines, 1) AS i) t
    ), s AS (
      SELECT k, min(doc_id) AS keeper FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
    )
    SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (s.k IS NOT NULL AND s.keeper <> l.doc_id) AS n_dropped,
      sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (s.k IS NULL OR s.keeper = l.doc_id), '')) AS kept_sha256
    FROM l LEFT JOIN s ON l.k = s.k GROUP BY l.doc_id""",
)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    from corvane.llm.lines import dedup_lines

    out = dedup_lines(documents(spark, sf))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query("op6_quality_rules")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    from corvane.llm.rules import judge

    return judge(documents(spark, sf))


@query(
    "op8_substring_dedup",
    sql="""
    WITH d AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents
    ), x AS (
      SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
    ), k AS (
      SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM x
    ), m AS (
      SELECT h, min(doc_id) AS a FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)
    ), hit AS (
      SELECT DISTINCT k.doc_id, unnest(range(k.i, k.i + 50)) AS i FROM k JOIN m ON k.h = m.h WHERE k.doc_id > m.a
    ), t AS (
      SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d
    )
    SELECT d.doc_id, count(t.i) AS n_words, count(hit.i) AS n_removed,
      sha256(coalesce(string_agg(t.w, ' ' ORDER BY t.i) FILTER (hit.i IS NULL), '')) AS kept_sha256
    FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN hit ON hit.doc_id = t.doc_id AND hit.i = t.i GROUP BY d.doc_id""",
)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    from corvane.llm.spans import dedup_spans

    out = dedup_spans(documents(spark, sf))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.tokens import decode, encode

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = decode(encode(documents(spark, sf), ranks, pattern), ranks, pattern)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query("op10_rendezvous_sharding")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    from corvane.llm.sharding import place

    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [F.col("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")]
    return place(documents(spark, sf), "doc_id", [1.0] * 8, [1.0] * 9, keep)


@query(
    "op11_spelling_variants",
    # the checksum table is computed, then every byte is one step of a fold; near words share a form without one letter
    sql=f"""
    WITH RECURSIVE t AS (
      SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
      FROM range(256) r(n)
    ), occ AS (
      SELECT doc_id, {LOWER.format("run")} AS run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL
    ), b AS (
      SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM occ
    ), crc AS (
      SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t
    ), v AS (
      SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
      FROM crc GROUP BY 1
    ), words AS (
      SELECT word, n FROM v WHERE length(word) >= 5 AND n >= 3
    ), less AS (
      SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS form FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
    ), pairs AS (
      SELECT a.word, b.word AS near FROM less a JOIN less b ON a.i = b.i AND a.form = b.form AND a.word <> b.word
      UNION SELECT word, form FROM less WHERE form IN (SELECT word FROM words) UNION SELECT form, word FROM less WHERE form IN (SELECT word FROM words)
    ), best AS (
      SELECT pairs.word, w.word AS near, w.n, count(*) OVER (PARTITION BY pairs.word) AS n_near,
        row_number() OVER (PARTITION BY pairs.word ORDER BY w.n DESC, w.word) AS nth FROM pairs JOIN words w ON w.word = pairs.near
    ), j AS (
      SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 2 * words.n THEN near END AS form,
        CASE WHEN best.n >= 2 * words.n THEN best.n END AS form_n FROM words LEFT JOIN best ON best.word = words.word AND nth = 1
    ), f AS (
      SELECT word, form AS last FROM j WHERE form IS NOT NULL UNION ALL SELECT f.word, j.form FROM f JOIN j ON j.word = f.last WHERE j.form IS NOT NULL
    ), roots AS (
      SELECT f.word, f.last FROM f JOIN j ON j.word = f.last WHERE j.form IS NULL
    )
    SELECT j.word, form, coalesce(last, j.word) AS root, n, n_near, form_n FROM j LEFT JOIN roots ON roots.word = j.word""",
)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    from corvane.llm.spelling import variants

    return variants(documents(spark, sf))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    from corvane.llm.alignment import align

    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return align(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), ranks)


@query(
    "op13_suffix_array_dedup",
    # bytes are two hexadecimal letters each; texts are cut into overlapping parts first, as a place in a long string is costly
    sql="""
    WITH d AS (
      SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
    ), c AS (
      SELECT doc_id, base, substr(h, 2 * base + 1, 798) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2, 200)) AS base FROM d)
    ), w AS (
      SELECT doc_id, base + j AS i, md5(substr(part, 2 * j + 1, 400)) AS k
      FROM (SELECT doc_id, base, part, unnest(range(0, length(part) // 2 - 199)) AS j FROM c WHERE length(part) >= 400)
    ), m AS (
      SELECT k FROM w GROUP BY k HAVING count(*) > 1
    ), s AS (
      SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM w SEMI JOIN m USING (k)
    ), r AS (
      SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s) GROUP BY doc_id, run
    ), p AS (
      SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM r
    ), k AS (
      SELECT doc_id, string_agg(substr(h, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept,
        sum(b - a) AS n_removed, count(*) AS n_spans FROM p JOIN d USING (doc_id) GROUP BY doc_id
    )
    SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
      sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    from corvane.llm.suffixes import dedup_bytes

    return dedup_bytes(documents(spark, sf)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
