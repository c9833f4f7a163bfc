"""Chunking, sanitizing, spans, routing and extraction against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import chunking as C
from corvane.operators.embed import Transient, call_in_batches, hash_embedder, provider_embedder, with_retry
from corvane.operators.extract import Route, extract_html, extract_text, route_backend
from corvane.operators.sanitize import SanitizeOptions, sanitize
from corvane.operators.spans import middle_words, piece_marks, text_at, window_spans
from corvane.plans.hygiene import middle_words as whole
from corvane.operators.splitters import SPLIT_STRATEGIES, spans_of, split_documents
from corvane.schema import ConfigError, EngineError, ExtractorBackend

TEXTS = [
    "", "   \n ", "one", " leading and trailing ", "a b c d e f g", "nbsp here and em", "x" * 500,
    "word " * 100, "Heading here\n\n" + "prose " * 30 + "end.\nnot a heading.\n" + "long " * 40 + "end.", "ünï cödé 😀 " * 40,
    "{}();=<>" * 120 + " then words again " * 40,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)


@pytest.mark.parametrize(("cap", "overlap"), [(1, 0), (3, 0), (3, 2), (64, 16)])
def test_whitespace_windows_equal_python_split(docs, cap, overlap):
    want = set()
    for i, text in enumerate(TEXTS):
        toks = text.split()
        for n, s in enumerate(range(0, len(toks), cap)):
            part = toks[max(0, s - overlap) : s + cap]
            want.add((i, n, len(part), " ".join(part)))
    got = C.chunk_whitespace(docs, cap, overlap=overlap).select("id", "ordinal", "token_count", "text")
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("count_extra", [0, 7])
def test_pieces_tile_the_text_and_respect_the_cap(docs, count_extra):
    sized = docs.withColumn("ordinal", F.lit(0)).withColumn("token_count", X.token_count(F.col("text")) + count_extra)
    rows = C.split_oversized(sized, 5).orderBy("id", "piece").collect()
    for i, text in enumerate(TEXTS):
        mine = [r for r in rows if r.id == i]
        assert "".join(r.text for r in mine) == text
        n = len(text.split())
        if n + count_extra > 5 and n > 1:
            assert all(len(r.text.split()) <= 5 for r in mine) and len(mine) > 1


def test_headings_are_marked_and_stripped(docs):
    got = {r.id: (r.m, r.n, r.back) for r in docs.select(
        "id", C.mark_headings(F.col("text")).alias("m"), C.heading_count(F.col("text")).alias("n"),
        C.strip_marks(C.mark_headings(F.col("text"))).alias("back")).collect()}
    assert got[8][0].startswith("## Heading here\n") and got[8][1] == 1
    assert all(got[i][2] == t for i, t in enumerate(TEXTS))


def spans_by_hand(text, o):
    junk = []
    for s in range(0, len(text), o.window_chars):
        w = text[s : s + o.window_chars]
        blanks = sum(c.isspace() for c in w)
        symbols = sum(not c.isalnum() and not c.isspace() for c in w)
        words = w.split()
        mean = sum(map(len, words)) / len(words) if words else float(len(w))
        trips = (blanks / len(w) < o.whitespace_ratio_min) + (symbols / len(w) > o.symbol_ratio_max) + (mean > o.word_length_max)
        if trips >= o.min_detectors:
            junk.append([s, s + len(w)])
    merged = []
    for a, b in junk:
        if merged and merged[-1][1] == a:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged if b - a >= o.min_span_chars]


@pytest.mark.parametrize("options", [SanitizeOptions(), SanitizeOptions(window_chars=50, min_span_chars=100, min_detectors=1)])
def test_sanitizer_equals_a_plain_scan(docs, options):
    rows = sanitize(docs, options, mode="strip").collect()
    for r in rows:
        want = spans_by_hand(TEXTS[r.id], options)
        assert [(s.start, s.end) for s in r.spans] == want
        kept, at = "", 0
        for a, b in want:
            kept, at = kept + TEXTS[r.id][at:a], b
        assert r.text == kept + TEXTS[r.id][at:] and r.removed_chars == sum(b - a for a, b in want)


@pytest.mark.parametrize(("cap", "overlap"), [(4, 0), (4, 2)])
def test_window_spans_hold_the_windows(docs, cap, overlap):
    for r in docs.select("id", window_spans(F.col("text"), cap, overlap).alias("s")).collect():
        text, toks = TEXTS[r.id], [(m.start(), m.end()) for m in re.finditer(r"\S+", TEXTS[r.id])]
        want = [(toks[max(0, s - overlap)][0], toks[min(s + cap, len(toks)) - 1][1]) for s in range(0, len(toks), cap)]
        if text.isascii():  # elsewhere character counts differ between the engines' string types
            assert [(x.start, x.end) for x in r.s] == want


def test_spans_give_the_chunks_back(docs):
    spans = F.transform(window_spans(F.col("text"), 5, 2), lambda s: text_at(F.col("text"), s))
    chunks = F.transform(C.whitespace_windows(X.tokens(F.col("text")), 5, 2), lambda w: F.array_join(w, " "))
    assert all(r.a == r.b for r in docs.select(spans.alias("a"), chunks.alias("b")).collect())


@pytest.mark.parametrize("strategy", SPLIT_STRATEGIES)
def test_splitters_cover_every_word(docs, strategy):
    rows = split_documents(docs.select("id", "text"), strategy, max_tokens=12).collect()
    for i, text in enumerate(TEXTS):
        mine = sorted((r.ordinal, r.start, r.end, r.text) for r in rows if r.id == i)
        assert " ".join(" ".join(m[3] for m in mine).split()) == " ".join(text.split())
        assert all(text[a:b] == piece and len(piece.split()) <= 12 for _, a, b, piece in mine)
    assert spans_of("", strategy, 5, 0) in ([], [(0, 0)])


def test_unknown_strategy_falls_back_with_a_warning(docs):
    with pytest.warns(UserWarning, match="whitespace"):
        assert split_documents(docs, "nope", max_tokens=5).count() == C.chunk_whitespace(docs, 5).count()


def test_hash_embedder_buckets(spark):
    vec = spark.createDataFrame([("Sun sun moon",), ("",)], "text string").select(hash_embedder(16)(F.col("text")).alias("v")).collect()
    at = lambda w: int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") % 16
    want = [0.0] * 16
    want[at("sun")] += 2
    want[at("moon")] += 1
    size = sum(x * x for x in want) ** 0.5
    assert vec[0].v == pytest.approx([x / size for x in want]) and vec[1].v == [0.0] * 16


def test_provider_batches_retries_and_guards(spark):
    calls = []
    assert call_in_batches(lambda g: calls.append(len(g)) or [[1.0]] * len(g), list("abcde"), 2) == [[1.0]] * 5 and calls == [2, 2, 1]
    with pytest.raises(EngineError):
        call_in_batches(lambda g: [], ["a"], 0)
    waits, state = [], {"n": 0}

    def flaky():
        state["n"] += 1
        if state["n"] < 4:
            raise Transient
        return "ok"

    assert with_retry(flaky, sleep=waits.append) == "ok" and waits == [1.0, 2.0, 4.0]
    with pytest.raises(ConfigError):
        provider_embedder(lambda: None, 2, prefix="query: ", applies_own_prefix=True)
    embed = provider_embedder(lambda: lambda group: [[float(len(x)), 0.0] for x in group], 2, batch=1, prefix="q:")
    assert spark.createDataFrame([("abc",)], "t string").select(embed(F.col("t")).alias("v")).first().v == [5.0, 0.0]


def test_extraction_keeps_bad_files_as_rows(spark):
    files = spark.createDataFrame([("a", b"fine"), ("b", b"\xff\xfe bad"), ("c", b"x" * 50)], "uri string, content binary")
    got = {r.uri: (r.text, r.error) for r in extract_text(files, cap=20).collect()}
    assert got["a"] == ("fine", None) and got["b"][0] is None and "UTF-8" in got["b"][1] and "cap" in got["c"][1]
    pages = {
        "<h1>A &amp; B</h1><script>no()</script><ul><li>x</li></ul>": "# A & B\n- x", "a < b &#8364;&#x20AC; &amp;lt; &#xZ;": "a < b €€ &lt; &#xZ;",
        "<HEAD><title>t</title><style>p{}</style></HEAD><P>one<br/>two \n\t three</p><!-- c --><b>bold</b>er": "one\ntwo\nthree\nbolder",
        "shown<script>never closed": "shown", "": "", "&nbsp;cut <a href='x": "cut",
    }
    got = spark.createDataFrame(list(pages.items()), "html string, want string").select(extract_html(F.col("html")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_routing_longest_prefix_first_route_and_scans(spark):
    routes = [Route("in", ExtractorBackend.TEXT), Route("in/deep", ExtractorBackend.DOCLING, ExtractorBackend.XBERG), Route("in/deep", ExtractorBackend.MINERU)]
    files = spark.createDataFrame([
        ("file:///r/in/deep/a.pdf", "", "xberg"), ("file:///r/in/deep/a.pdf", "y" * 40, "docling"), ("file:///r/in/b.PNG", "", "error"),
        ("file:///r/in/deep/c.png", "", "xberg"), ("file:///r/out/d.docx", "", "markitdown"), ("file:///r/out/e.md", "", "text"), ("file:///r/indeed/f.pdf", "", "markitdown"),
    ], "uri string, text string, want string")
    got = files.select("want", route_backend(F.col("uri"), F.col("text"), roots=["/r"], routes=routes).alias("got")).collect()
    assert all(r.want == r.got for r in got), got


def test_uris_round_trip_and_refuse(spark):
    df = spark.createDataFrame([("a/b c*~+é",)], "id string")
    row = df.select(X.doc_uri(F.col("id")).alias("u"), X.doc_id_of(X.doc_uri(F.col("id"))).alias("back")).first()
    assert row.u == "doc://a%2Fb%20c%2A~%2B%C3%A9" and row.back == "a/b c*~+é"
    with pytest.raises(Exception, match="not a file"):
        df.select(X.path_of(F.col("id"))).collect()


def test_marks_of_tokens_and_the_middle_words(spark):
    texts = ["  a bc\u00a0d\x1ce  ", "", None, " \n ", " ".join(f"w{i}\U0001f600" for i in range(21))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("m", piece_marks(F.col("text")))
    for r in rows.select("id", "text", "m", middle_words(F.col("text"), F.col("m")).alias("mid"), whole(F.col("text")).alias("old")).collect():
        found = [x.span() for x in re.finditer(r"\S+", r.text or "")]
        assert r.m is None if r.text is None else list(zip(r.m.starts, r.m.stops, strict=True)) == found
        assert r.mid == r.old
