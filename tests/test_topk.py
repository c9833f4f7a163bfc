"""The top-k kernel against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import lexical
from corvane.operators.lexical import ENDINGS, STOPS
from corvane.operators.topk import exact_topk

RNG = np.random.default_rng(3)
DIM = 8


def frame(spark, matrix, name, extra=None):
    rows = [(i, [float(x) for x in v], *(e[i] for e in (extra or []))) for i, v in enumerate(matrix)]
    schema = f"{name} long, vector array<double>" + "".join(f", x{j} string" for j in range(len(extra or [])))
    return spark.createDataFrame(rows, schema)


def brute(vectors, queries, k, decimals=6):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    scores = np.round(unit(vectors) @ unit(queries).T, decimals) + 0.0
    out = set()
    for q in range(len(queries)):
        order = sorted(range(len(vectors)), key=lambda i: (-scores[i, q], i))[:k]
        out |= {(q, i, r + 1, round(float(scores[i, q]), 6)) for r, i in enumerate(order)}
    return out


VECTORS = RNG.normal(size=(60, DIM))
VECTORS[5] = 0.0  # a zero vector scores 0
VECTORS[10] = VECTORS[20] = VECTORS[30]  # equal scores go to the smaller id
QUERIES = np.vstack([RNG.normal(size=(4, DIM)), VECTORS[30]])


@pytest.mark.parametrize("parts", [1, 2, 7])
@pytest.mark.parametrize("k", [1, 3, 100])
def test_equals_brute_force_whatever_the_partitioning(spark, parts, k):
    got = exact_topk(frame(spark, VECTORS, "id").repartition(parts), frame(spark, QUERIES, "qid"), k, dim=DIM, keys=["id"])
    assert {(r.qid, r.id, r.rank, round(r.score, 6)) for r in got.collect()} == brute(VECTORS, QUERIES, k)


def test_query_set_beyond_the_broadcast_bound_is_ranked_in_blocks(spark):
    got = exact_topk(frame(spark, VECTORS, "id"), frame(spark, QUERIES, "qid"), 3, dim=DIM, keys=["id"], max_values=2 * DIM)
    assert {(r.qid, r.id, r.rank, round(r.score, 6)) for r in got.collect()} == brute(VECTORS, QUERIES, 3)


def test_small_blocks_inside_a_task_change_nothing(spark, monkeypatch):
    from corvane.operators import topk

    monkeypatch.setattr(topk, "SCORE_BLOCK_VALUES", 16)
    got = exact_topk(frame(spark, VECTORS, "id").repartition(2), frame(spark, QUERIES, "qid"), 3, dim=DIM, keys=["id"])
    assert {(r.qid, r.id, r.rank, round(r.score, 6)) for r in got.collect()} == brute(VECTORS, QUERIES, 3)


def test_unique_ranks_documents_by_their_best_chunk_inside_segments(spark):
    docs = [str(i % 9) for i in range(60)]
    langs = ["a" if i % 3 else "b" for i in range(60)]
    rows = frame(spark, VECTORS, "id", [docs, langs]).withColumnsRenamed({"x0": "doc", "x1": "lang"}).repartition(5)
    got = exact_topk(rows, frame(spark, QUERIES, "qid"), 2, dim=DIM, keys=["doc", "id"], segments=["lang"], unique=["doc"])
    every = brute(VECTORS, QUERIES, 60)
    want = set()
    for q in range(len(QUERIES)):
        for lang in "ab":
            best = {}
            for _, i, _, s in (x for x in every if x[0] == q and langs[x[1]] == lang):
                key = (-s, docs[i], i)
                best[docs[i]] = min(best.get(docs[i], key), key)
            want |= {(q, lang, d, i, r + 1) for r, (_, d, i) in enumerate(sorted(best.values())[:2])}
    assert {(r.qid, r.lang, r.doc, r.id, r["rank"]) for r in got.collect()} == want


def test_a_vector_of_another_width_fails(spark):
    bad = frame(spark, RNG.normal(size=(3, DIM + 1)), "id")
    with pytest.raises(Exception, match="width"):
        exact_topk(bad, frame(spark, QUERIES, "qid"), 2, dim=DIM, keys=["id"]).collect()


LEXICON = {
    "docs_en": ["cats", "cat", "running", "runs", "boxes", "stories", "story", "the", "and", "sun"],
    "docs_de": ["katzen", "katze", "häuser", "der", "und", "zeitungen", "zeitung", "sonne", "laufen", "lauf"],
    "docs_fr": ["journaux", "journal", "chats", "les", "parler", "parlé", "soleil", "lune", "et", "doucement"],
    "docs_es": ["gatos", "gato", "los", "hablando", "hablar", "sol", "luna", "rápidamente", "rápida", "y"],
}


def bm25_rows():
    docs = [(i, c, " ".join(RNG.choice(words, size=RNG.integers(0, 9)))) for c, words in LEXICON.items() for i in range(60)]
    asked = [(i, " ".join(RNG.choice([w for words in LEXICON.values() for w in words], size=6))) for i in range(25)]
    return docs + [(99, None, "sun"), (98, "docs_en", None)], asked


def plain_bm25(docs, asked, k):
    """Best ``k`` per query and corpus, by counting."""
    out = []
    for corpus in LEXICON:
        language = {"docs_de": "german", "docs_fr": "french", "docs_es": "spanish"}.get(corpus, "english")

        def analyse(text, language=language):
            words = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in STOPS[language]]
            for ending, instead in ENDINGS[language]:
                words = [re.sub(ending, rf"\1{instead}", w) for w in words]
            return words

        held = {i: analyse(t) for i, c, t in docs if c == corpus}
        mean = sum(map(len, held.values())) / len(held)
        df = Counter(w for words in held.values() for w in set(words))
        for qid, text in asked:
            scores = {}
            for w, qtf in Counter(analyse(text)).items():
                for i, words in held.items():
                    if tf := words.count(w):
                        idf = math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5))
                        scores[i] = scores.get(i, 0) + qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))
            ranked = sorted((-round(x, 6), i) for i, x in scores.items())[:k]
            out += [(qid, corpus, i, round(-x, 6), r) for r, (x, i) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_docs", [4096, 7])
def test_postings_equal_counting_in_every_language(spark, monkeypatch, block_docs):
    docs, asked = bm25_rows()
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block_docs)
    got = lexical.bm25_topk(
        spark.createDataFrame(docs, "id long, corpus string, text string"), spark.createDataFrame(asked, "qid long, text string"), 4,
        keys=["id"], corpus=F.col("corpus"),
    )
    assert sorted((r.qid, r.corpus, r.id, round(r.score, 6), r["rank"]) for r in got.collect()) == plain_bm25(docs, asked, 4)


def test_a_stored_index_answers_blocks_of_queries_and_skips_nothing_it_needs(spark, monkeypatch, tmp_path):
    docs, asked = bm25_rows()
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 5)
    index = lexical.PostingsIndex(spark, str(tmp_path / "index"))
    index.build(spark.createDataFrame(docs, "id long, corpus string, text string"), ["id"], corpus=F.col("corpus"), language=lexical.analyzer_of(F.col("corpus")))
    queries = spark.createDataFrame(asked, "qid long, text string")
    whole = sorted(map(tuple, index.search(queries, 3).collect()))
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, lexical.PostingsIndex(spark, index.path).search(queries, 3).collect())) == whole and whole
    merged = {}
    for qid, _, doc, score, _ in index.search(queries, 200).collect():
        merged.setdefault(qid, []).append((-score, doc))
    for r in index.search(queries, 3, per_corpus=False).collect():
        assert -r.score == sorted(merged[r.qid])[r["rank"] - 1][0]
    assert index.statistics().where("df > cf").count() == 0


def test_plan_moves_candidates_only(spark):
    plan = exact_topk(frame(spark, VECTORS, "id"), frame(spark, QUERIES, "qid"), 3, dim=DIM, keys=["id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    assert F is not None
