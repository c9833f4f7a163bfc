"""Chunkers that are plain column expressions: one document row becomes N chunk rows.

A document is one row, so every step here is narrow: no shuffle, and a document's chunks leave
the task in order. ``span_*`` columns carry the character range a chunk covers in its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.rows import fan_out
from corvane.functions.text import is_blank, let, tokens
from corvane.schema import ConfigError


def whitespace_windows(toks: Column, max_tokens: int, overlap: int = 0) -> Column:
    """Arrays of ``max_tokens`` tokens, each led by the ``overlap`` tokens before it.

    The cuts do not move with the overlap: context is prepended to windows already fixed, so a
    window holds up to ``max_tokens + overlap`` tokens.
    """
    if max_tokens < 1 or overlap < 0:
        raise ConfigError("max_tokens must be positive and overlap not negative")
    starts = F.when(
        F.size(toks) > 0, F.sequence(F.lit(0), F.size(toks) - 1, F.lit(max_tokens))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda s: F.slice(
            toks,
            F.greatest(s - overlap, F.lit(0)) + 1,
            s + max_tokens - F.greatest(s - overlap, F.lit(0)),
        ),
    )


def chunk_whitespace(
    docs: DataFrame, max_tokens: int, *, overlap: int = 0, text: str = "text"
) -> DataFrame:
    """``ordinal, token_count, text`` per chunk; the document's other columns ride along."""
    keep = [c for c in docs.columns if c != text]
    split = docs.select(*keep, tokens(F.col(text)).alias("_toks"))
    windows = fan_out(split, keep, whitespace_windows(F.col("_toks"), max_tokens, overlap), "_win", "ordinal")
    return windows.select(
        *keep,
        "ordinal",
        F.size("_win").alias("token_count"),
        F.array_join("_win", " ").alias("text"),
    )


def token_pieces(text: Column) -> Column:
    """The text cut into ``token + blanks after it`` pieces; a leading blank run joins the first."""
    return F.regexp_extract_all(
        text, F.lit(r"(?U)^[\s\x1c-\x1f]*[^\s\x1c-\x1f]+[\s\x1c-\x1f]*|[^\s\x1c-\x1f]+[\s\x1c-\x1f]*"), F.lit(0)
    )


def tile_pieces(text: Column, token_count: Column, max_tokens: int) -> Column:
    """Cut an oversized text into pieces that join back to it exactly.

    ``token_count`` is the recorded count, which may come from another tokenizer: it decides
    whether and into how many pieces the text is cut; the whitespace tokens only decide where.
    Returns ``array<struct<text, token_count>>``.
    """
    whole = F.array(F.struct(text.alias("text"), token_count.cast("int").alias("token_count")))

    def cut(pieces: Column) -> Column:
        n = F.size(pieces)
        even = F.greatest(F.lit(1), F.ceil(n / F.ceil(token_count / F.lit(max_tokens))).cast("int"))
        window = F.when(n <= max_tokens, even).otherwise(F.lit(max_tokens))
        tiled = F.transform(
            F.sequence(F.lit(0), n - 1, window),
            lambda s: F.struct(
                F.array_join(F.slice(pieces, s + 1, window), "").alias("text"),
                F.size(F.slice(pieces, s + 1, window)).alias("token_count"),
            ),
        )
        return F.when(n <= 1, whole).otherwise(tiled)

    return F.when(token_count <= max_tokens, whole).otherwise(let(token_pieces(text), cut))


def split_oversized(chunks: DataFrame, max_tokens: int, *, order: str = "ordinal") -> DataFrame:
    """The size guard over a chunk table: one row per piece, ``piece`` counting from 0."""
    keep = [c for c in chunks.columns if c not in ("text", "token_count")]
    return fan_out(chunks, keep, tile_pieces(F.col("text"), F.col("token_count"), max_tokens), "_p", "piece").select(*keep, "piece", F.col("_p.token_count").alias("token_count"), F.col("_p.text").alias("text"))


def plan_repair(chunks: DataFrame, max_tokens: int) -> DataFrame:
    """Replace oversized chunks by pieces; ``carry`` is the old ordinal, or -1 for "embed again"."""
    keep = [c for c in chunks.columns if c not in ("text", "token_count")]
    pieces = F.col("_ps")
    cut = chunks.select(*keep, tile_pieces(F.col("text"), F.col("token_count"), max_tokens).alias("_ps"))
    return (
        fan_out(cut, [*keep, F.size(pieces).alias("_n")], pieces, "_p", "piece")
        .select(
            *keep,
            "piece",
            F.when(F.col("_n") == 1, F.col("ordinal")).otherwise(F.lit(-1)).alias("carry"),
            F.col("_p.token_count").alias("token_count"),
            F.col("_p.text").alias("text"),
        )
    )


def drop_empty_renumber(pieces: Column) -> Column:
    """Drop blank chunks from a document's ``array<struct<text, token_count>>``.

    The position in the returned array is the new dense ordinal, so renumbering costs no shuffle.
    """
    return F.filter(pieces, lambda p: ~is_blank(p["text"]))


# The heading rule's parameters.
MARK = "## "
HEADING_MAX_CHARS = 79
HEADING_MAX_SPACES = 8
NEXT_LINE_MIN_CHARS = 120

# One heading line, as a pattern: what the line may hold, then (looking ahead, over blank lines
# only) the long prose line that must follow. Matching is linear and needs no line table.
HEADING = (
    r"(?mdU)^"
    rf"(?=[^\n]{{1,{HEADING_MAX_CHARS}}}$)"
    r"(?=[^\n]*[^\s])"
    r"(?!## |[-*•])"
    rf"(?!(?:[^ \n]* ){{{HEADING_MAX_SPACES + 1}}})"
    r"(?![^\n]*[=→+])"
    r"(?![^\n]*\d{3})"
    r"([^\n]*[^.,;:!?)\n])$"
    rf"(?=\n(?:[^\S\n]*\n)*[^\n]{{{NEXT_LINE_MIN_CHARS - 1},}}[.\")]$)"
)


def mark_headings(text: Column) -> Column:
    """Prefix every heading line of a document with the markdown mark."""
    return F.regexp_replace(text, HEADING, MARK + "$1")


def heading_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HEADING))


def strip_marks(text: Column) -> Column:
    """The inverse of :func:`mark_headings` for text its source never marked."""
    return F.regexp_replace(text, r"(?md)^## ", "")
