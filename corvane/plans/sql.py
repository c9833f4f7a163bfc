"""SQL fragments shared by the oracles. They restate the semantics independently of Spark."""

from __future__ import annotations


def toks(expr: str) -> str:
    return rf"list_filter(regexp_split_to_array({expr}, '\s+'), lambda x: x <> '')"


def chunk_cte(name: str = "chunks", cap: int = 64, overlap: int = 0, src: str = "documents",
              cols: str = "doc_id, lang, source") -> str:
    """``cols, ordinal, toks`` of every document cut into windows of ``cap`` tokens."""
    return f"""{name} AS (
      SELECT {cols}, s // {cap} AS ordinal,
             list_slice(t, greatest(s - {overlap}, 0) + 1, s + {cap}) AS toks
      FROM (SELECT {cols}, t, unnest(range(0, len(t), {cap})) AS s
            FROM (SELECT {cols}, {toks('text')} AS t FROM {src})))"""


def bag_cte(name: str, src: str, keys: str, tok_list: str, dim: int) -> str:
    """Sparse bucket counts ``keys, b, c`` plus ``{name}_n`` with each key's norm."""
    return f"""{name} AS (
      SELECT {keys}, ('0x' || substr(md5(lower(w)), 1, 8))::BIGINT % {dim} AS b, count(*)::DOUBLE AS c
      FROM (SELECT {keys}, unnest({tok_list}) AS w FROM {src}) GROUP BY ALL),
    {name}_n AS (SELECT {keys}, sqrt(sum(c * c)) AS n FROM {name} GROUP BY ALL)"""


def query_bag_cte(dim: int, text: str = "text") -> str:
    return bag_cte("qbag", "benchmark", "item_id", toks(text), dim)


def dense_scores_cte(cap: int = 64, dim: int = 64, overlap: int = 0, query_text: str = "text") -> str:
    """Scores of every (passage, chunk) pair that shares a bucket: ``qid, doc_id, lang, ordinal, score``.

    Chunks sharing no bucket score 0, so the zero rows are added by the caller only where a
    ranking could reach them.
    """
    return f"""{chunk_cte(cap=cap, overlap=overlap)},
    {bag_cte('cbag', 'chunks', 'doc_id, lang, ordinal', 'toks', dim)},
    {query_bag_cte(dim, query_text)},
    scored AS (
      SELECT q.item_id AS qid, c.doc_id, c.lang, c.ordinal,
             round(sum(q.c * c.c) / (any_value(qn.n) * any_value(cn.n)), 6) AS score
      FROM qbag q JOIN cbag c USING (b)
      JOIN qbag_n qn ON qn.item_id = q.item_id
      JOIN cbag_n cn ON cn.doc_id = c.doc_id AND cn.ordinal = c.ordinal
      GROUP BY q.item_id, c.doc_id, c.lang, c.ordinal)"""


VECTORS_CTE = """vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"""

CLASS_QUERIES_CTE = """cells AS (
      SELECT label, i, avg(v[i]) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM vecs) GROUP BY ALL),
    qs AS (SELECT label AS qid, list(x ORDER BY i) AS q FROM cells GROUP BY label)"""


def cosine(a: str, b: str) -> str:
    return (f"(list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * "
            f"sqrt(list_inner_product({b}, {b}))))")
