"""Chunk strategies beyond whitespace windows.

The splitting rules are small per-document helpers; Spark moves the documents. Every strategy
yields pieces that are slices of the document, so each chunk row also carries its character
range.
"""

from __future__ import annotations

import re
import warnings
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.rows import fan_out
from corvane.operators.chunking import chunk_whitespace
from corvane.operators.embed import hash_vectors

Span = tuple[int, int]

# Where a text may be cut, from the coarsest boundary to the finest.
LEVELS = {
    "recursive": (r"\n{2,}", r"\n", r"(?<=[.!?])\s+", r"\s+"),
    "markdown": (r"\n(?=#{1,6} )", r"\n{2,}", r"\n", r"(?<=[.!?])\s+", r"\s+"),
    "fast": (r"\n{2,}", r"\n", r"(?<=[.!?])\s+", r"\s+"),
}
_WORD = re.compile(r"\S+")


def _size(text: str, span: Span) -> int:
    return len(text[span[0] : span[1]].split())


def _cut(text: str, span: Span, pattern: str) -> list[Span]:
    """The span cut after every match, so that the parts tile it."""
    ends = [m.end() for m in re.finditer(pattern, text[span[0] : span[1]])]
    edges = [span[0], *(span[0] + e for e in ends if 0 < e < span[1] - span[0]), span[1]]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def hierarchical(text: str, cap: int, levels: tuple[str, ...], span: Span | None = None) -> list[Span]:
    """Cut at the coarsest boundary that helps, then pack neighbours greedily up to the cap."""
    span = span or (0, len(text))
    if _size(text, span) <= cap or not levels:
        return [span]
    parts: list[Span] = []
    for part in _cut(text, span, levels[0]):
        parts.extend([part] if _size(text, part) <= cap else hierarchical(text, cap, levels[1:], part))
    packed: list[Span] = []
    held = 0
    for part in parts:
        size = _size(text, part)
        if packed and held + size <= cap:
            packed[-1] = (packed[-1][0], part[1])
            held += size
        else:
            packed.append(part)
            held = size
    return packed


def with_context(text: str, spans: list[Span], overlap: int) -> list[Span]:
    """Start each span ``overlap`` words earlier; the cuts themselves stay."""
    if not overlap:
        return spans
    words = [m.start() for m in _WORD.finditer(text)]
    out = []
    for start, end in spans:
        at = bisect_left(words, start)
        out.append((words[max(0, at - overlap)] if at else start, end))
    return out


def windowed(text: str, spans: list[Span], cap: int, overlap: int, strategy: str) -> list[Span]:
    """Re-cut by the strategy's own levels so that the overlap fits inside the cap."""
    if not overlap:
        return spans
    return with_context(text, hierarchical(text, max(1, cap - overlap), LEVELS[strategy]), overlap)


def semantic(text: str, cap: int, dim: int = 256, drop: float = 0.15) -> list[Span]:
    """Cut between sentences whose hash vectors differ most, and wherever the cap is reached."""
    sentences = _cut(text, (0, len(text)), r"(?<=[.!?])\s+")
    if len(sentences) < 2:
        return hierarchical(text, cap, LEVELS["recursive"])
    vectors = hash_vectors([text[a:b] for a, b in sentences], dim, "blake2b")
    alike = (vectors[1:] * vectors[:-1]).sum(axis=1)
    threshold = np.quantile(alike, drop)
    out: list[Span] = []
    start, held = 0, 0
    for i, (a, b) in enumerate(sentences):
        size = _size(text, (a, b))
        if held and (held + size > cap or alike[i - 1] < threshold):
            out.append((start, a))
            start, held = a, 0
        held += size
    out.append((start, len(text)))
    return [s for span in out for s in hierarchical(text, cap, LEVELS["recursive"], span)]


def spans_of(text: str, strategy: str, cap: int, overlap: int) -> list[Span]:
    if strategy == "semantic":
        return semantic(text, cap)
    spans = hierarchical(text, cap, LEVELS[strategy])
    return with_context(text, spans, overlap) if strategy == "recursive" else windowed(text, spans, cap, overlap, strategy)


SPLIT_STRATEGIES = ("recursive", "markdown", "fast", "semantic")
_SCHEMA = "array<struct<text:string,token_count:int,start:int,end:int>>"
_ITEM = pa.struct([("text", pa.string()), ("token_count", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])


def split_documents(
    docs: DataFrame, strategy: str, *, max_tokens: int, overlap: int = 0,
    spans: Callable[[str, str, int, int], list[Span]] = spans_of,
) -> DataFrame:
    """``ordinal, token_count, text, start, end`` per chunk; blank pieces are dropped.

    An unknown strategy falls back to whitespace windows with a warning.
    """
    if strategy == "whitespace" or strategy not in SPLIT_STRATEGIES:
        if strategy != "whitespace":
            warnings.warn(f"no chunker {strategy!r} here, using whitespace windows", stacklevel=2)
        return chunk_whitespace(docs, max_tokens, overlap=overlap)

    @F.arrow_udf(_SCHEMA)
    def split(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            out = []
            for text in batch.to_pylist():
                pieces = [(text[a:b], a, b) for a, b in spans(text or "", strategy, max_tokens, overlap)]
                out.append([
                    {"text": p, "token_count": len(p.split()), "start": a, "end": b} for p, a, b in pieces if p.strip()
                ])
            yield pa.array(out, type=pa.list_(_ITEM))

    keep = [c for c in docs.columns if c != "text"]
    return fan_out(docs, keep, split(F.col("text")), "_c", "ordinal").select(
        *keep, "ordinal", "_c.token_count", "_c.text", "_c.start", "_c.end"
    )
