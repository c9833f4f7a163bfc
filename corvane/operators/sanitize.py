"""Machine-content detection: fixed-size character windows scored inside the document's row.

No window ever leaves its row, so a document of any size costs one linear pass and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import BLANKS, let
from corvane.schema import ConfigError


@dataclass(frozen=True)
class SanitizeOptions:
    """The default thresholds."""

    window_chars: int = 400
    min_span_chars: int = 400
    whitespace_ratio_min: float = 0.08
    symbol_ratio_max: float = 0.35
    word_length_max: float = 15.0
    min_detectors: int = 2

    def __post_init__(self) -> None:
        if self.window_chars < 1 or self.min_detectors < 1:
            raise ConfigError("window_chars and min_detectors must be positive")


def windows(text: Column, chars: int) -> Column:
    """The text as consecutive windows of ``chars`` characters (one regex pass, not N substrings)."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{chars}}}"), F.lit(0))


def detectors_tripped(window: Column, o: SanitizeOptions) -> Column:
    """How many machine-content signals a window trips: few blanks, many symbols, long words."""
    n = F.length(window)

    def tripped(m: Column) -> Column:
        chars = n - m["blanks"]
        mean_word = F.when(m["words"] > 0, chars / m["words"]).otherwise(n.cast("double"))
        return (
            (m["blanks"] / n < o.whitespace_ratio_min).cast("int")
            + (m["symbols"] / n > o.symbol_ratio_max).cast("int")
            + (mean_word > o.word_length_max).cast("int")
        )

    # Runs are removed in bulk, so each pass has a match per word rather than one per character.
    measures = F.struct(
        (n - F.length(F.regexp_replace(window, BLANKS, ""))).alias("blanks"),
        F.length(F.regexp_replace(window, r"(?U)[\p{L}\p{N}\s\x1c-\x1f]+", "")).alias("symbols"),
        F.regexp_count(window, F.lit(r"(?U)[^\s\x1c-\x1f]+")).alias("words"),
    )
    return let(measures, tripped)


def junk_spans(text: Column, o: SanitizeOptions) -> Column:
    """``array<struct<start,end>>`` of merged junk windows of at least ``min_span_chars``."""
    scored = F.transform(
        windows(text, o.window_chars),
        lambda w, i: F.struct(
            (i * o.window_chars).alias("start"),
            (i * o.window_chars + F.length(w)).alias("end"),
            (detectors_tripped(w, o) >= o.min_detectors).alias("junk"),
        ),
    )
    junk = F.transform(
        F.filter(scored, lambda w: w["junk"]), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"))
    )
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def extend(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.array_append(
            F.slice(acc, 1, F.size(acc) - 1), F.struct(last["start"].alias("start"), w["end"].alias("end"))
        )
        return F.when((F.size(acc) > 0) & (last["end"] == w["start"]), grown).otherwise(F.array_append(acc, w))

    merged = F.aggregate(junk, empty, extend)
    return F.filter(merged, lambda s: s["end"] - s["start"] >= o.min_span_chars)


def without_spans(text: Column, spans: Column, o: SanitizeOptions) -> Column:
    """The text without the spans; spans are window-aligned, so the kept windows are joined."""
    kept = F.filter(
        F.transform(windows(text, o.window_chars), lambda w, i: F.struct(w.alias("w"), (i * o.window_chars).alias("at"))),
        lambda w: ~F.exists(spans, lambda s: (w["at"] >= s["start"]) & (w["at"] < s["end"])),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(kept, lambda w: w["w"]), ""))


def sanitize(docs: DataFrame, options: SanitizeOptions | None = None, *, mode: str = "dry_run") -> DataFrame:
    """Adds ``spans`` and ``removed_chars``; ``mode="strip"`` also removes the spans from ``text``."""
    if mode not in ("dry_run", "strip"):
        raise ConfigError(f"unknown sanitize mode {mode!r}")
    o = options or SanitizeOptions()
    found = docs.withColumn("spans", junk_spans(F.col("text"), o)).withColumn(
        "removed_chars", F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    )
    return found.withColumn("text", without_spans(F.col("text"), F.col("spans"), o)) if mode == "strip" else found
