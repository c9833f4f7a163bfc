"""Text expressions. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.schema import ConfigError

# Unicode blanks plus the four ASCII separators.
BLANKS = r"(?U)[\s\x1c-\x1f]+"
EDGE_BLANKS = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside a lambda a repeated expression is evaluated for every element; binding it to a lambda
    variable of a one-element array evaluates it once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Whitespace tokens without the empty ones ``split`` leaves at the edges."""
    return F.filter(F.split(text, BLANKS), lambda t: t != "")


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_BLANKS, "")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def collapse(text: Column) -> Column:
    """Every run of blanks becomes one space; no blanks at the edges."""
    return F.array_join(tokens(text), " ")


def snippet(text: Column, width: int = 80) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.substring(flat, 1, width), F.lit("...")))


def truncate_words(text: Column, words: int) -> Column:
    """The first ``words`` whitespace words, joined by single spaces."""
    if words < 1:
        raise ConfigError("a query needs at least one word")
    return F.array_join(F.slice(tokens(text), 1, words), " ")


def percent_encode(text: Column) -> Column:
    """Whole-string percent encoding: ``url_encode`` keeps ``*`` and writes a space as ``+``."""
    encoded = F.url_encode(text)
    for raw, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(raw), F.lit(wanted))
    return encoded


def percent_decode(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def doc_uri(doc_id: Column, scheme: str = "doc") -> Column:
    """A reversible URI holding the whole id as one path segment."""
    return F.concat(F.lit(f"{scheme}://"), percent_encode(doc_id.cast("string")))


def doc_id_of(uri: Column, scheme: str = "doc") -> Column:
    prefix = f"{scheme}://"
    return F.when(F.startswith(uri, F.lit(prefix)), percent_decode(F.substr(uri, F.lit(len(prefix) + 1)))).otherwise(
        F.raise_error(F.concat(F.lit(f"not a {scheme} URI: "), uri))
    )


def file_uri(path: Column) -> Column:
    """A ``file://`` URI for an absolute path: dots resolved as text, segments percent-encoded.

    The fold keeps a stack of path parts: ``..`` pops, ``.`` and empty parts vanish. Links are
    not followed.
    """
    parts = F.split(path, "/")
    stack = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, part)),
    )
    return F.concat(F.lit("file:///"), F.array_join(F.transform(stack, percent_encode), "/"))


def path_of(uri: Column) -> Column:
    """The path inside a ``file:`` URI; anything else is refused."""
    return F.when(F.startswith(uri, F.lit("file://")), percent_decode(F.substr(uri, F.lit(8)))).otherwise(
        F.raise_error(F.concat(F.lit("not a file: URI: "), uri))
    )


def suffix_of(path: Column) -> Column:
    """The last dotted suffix of a path, lower case, with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]+(\.[^./]+)$", 1))


# Spelled-out figures that a published count may use.
NUMERAL_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "once": 1, "twice": 2,
}


def published_value(printed: Column) -> Column:
    """The number a printed figure stands for: spelled words, signs and thousands commas."""
    words = F.create_map(*[F.lit(x) for pair in NUMERAL_WORDS.items() for x in (pair[0], float(pair[1]))])
    bare = F.regexp_replace(F.regexp_replace(printed, ",", ""), r"^\+", "")
    return F.coalesce(F.element_at(words, F.lower(strip(printed))), bare.try_cast("double"))


def published_tolerance(printed: Column) -> Column:
    """Half a unit in the last printed place."""
    places = F.length(F.regexp_extract(F.regexp_replace(printed, ",", ""), r"\.(\d+)$", 1))
    return F.lit(0.5) * F.pow(F.lit(10.0), -places)


def within_tolerance(derived: Column, printed: Column) -> Column:
    slack = F.lit(1 + 1e-6)
    return F.abs(derived - published_value(printed)) <= published_tolerance(printed) * slack


# Letters, digits and single CJK characters count as words.
WORD_PATTERN = r"[0-9a-z]+|[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def normalized(text: Column) -> Column:
    return F.lower(collapse(text))
