"""Text extraction: bytes to text, HTML to text, remote converters, and the routing between them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import let, path_of, strip, suffix_of
from corvane.operators.embed import with_retry
from corvane.schema import ConfigError, ExtractorBackend

TEXT_CAP = 5 * 1024 * 1024  # fixed value: bytes a plain text file may have
SCAN_MIN_CHARS = 24  # fixed value: less text than this in a PDF means it is a scan

# Suffixes per kind of file and the backends that can read an image.
OFFICE_SUFFIXES = (".pdf", ".docx", ".doc", ".pptx", ".ppt", ".xlsx", ".xls", ".html", ".htm", ".epub")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp", ".gif")
OCR_BACKENDS = ("xberg", "docling", "mineru", "olmocr", "openai_vision")


def extract_text(files: DataFrame, *, cap: int = TEXT_CAP) -> DataFrame:
    """``content`` bytes to ``text``; a bad file gets an ``error`` instead of failing the job."""
    decoded = F.try_validate_utf8(F.col("content").cast("string"))
    error = (
        F.when(F.length("content") > cap, F.lit("file is larger than the text cap"))
        .when(decoded.isNull(), F.lit("file is not valid UTF-8"))
    )
    return files.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), decoded)).drop("content")


# Elements that hold no prose, elements that end a line, and the named characters that are read.
HIDDEN = ("script", "style", "noscript", "template", "head")
LINES = ("p", "br", "div", "li", "ul", "ol", "tr", "table", "section", "article", "nav", "h1", "h2", "h3", "h4", "h5", "h6",
         "header", "footer", "blockquote", "pre")
NAMED = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "middot": "·", "hellip": "…", "ndash": "–",
    "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£",
    "sect": "§", "deg": "°", "times": "×", "bull": "•", "trade": "™", "shy": "", "amp": "&",
}
TAG = r"</?[A-Za-z][^>]*(?:>|\z)|<[!?][^>]*(?:>|\z)"
LINE_BLANKS = r"[ \t\r\x0B\f\x{00A0}]+"

# What a page is rewritten by, one after the other: pattern and replacement. An element that is never closed hides the rest.
HTML_RULES = (
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    *((rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)", "") for tag in HIDDEN),
    *((rf"(?i)<h{n}\b[^>]*>", "\n" + "#" * n + " ") for n in range(1, 7)),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (rf"(?i)</?(?:{'|'.join(LINES)})\b[^>]*>", "\n"),
    (TAG, ""),
)


def numbered(text: Column) -> Column:
    """Numbered characters such as ``&#8364;`` and ``&#x20AC;`` as themselves."""

    def one(part: Column) -> Column:
        number = F.regexp_extract(part, r"^(x[0-9A-Fa-f]{1,6}|[0-9]{1,7});", 1)
        code = F.when(F.startswith(number, F.lit("x")), F.substring(number, 2, 6)).otherwise(F.conv(number, 10, 16))
        letter = F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")
        return F.when(number == "", F.concat(F.lit("&#"), part)).otherwise(F.concat(letter, F.substr(part, F.char_length(number) + 2)))

    read = let(F.split(text, "&#"), lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, F.lit(2), F.size(p)), one), "")))
    return F.when(F.contains(text, F.lit("&#")), read).otherwise(text)


def extract_html(html: Column) -> Column:
    """Markdown-like text of a page: headings and list items marked, one line per block, no scripts, styles or comments.

    Regular expressions over the column, so a page stays in its row and in the JVM. A null page stays null.
    """
    text = html
    for pattern, instead in HTML_RULES:
        text = F.regexp_replace(text, pattern, instead)
    text = numbered(text)
    for name, letter in NAMED.items():
        text = F.regexp_replace(text, f"&{name};", letter)
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, LINE_BLANKS, " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


Converter = Callable[[bytes, str], str]


def remote_extractor(connect: Callable[[], Converter], *, cap: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """A REST or vision converter over ``uri, content``: text, or an ``error`` for that file only.

    ``connect`` opens the client once per Python worker. Transport failures are retried inside
    the call; a task retry would convert (and bill) the whole batch again.
    """

    def apply(files: DataFrame) -> DataFrame:
        names = [c for c in files.columns if c != "content"]
        texts_and_errors = [T.StructField(c, T.StringType()) for c in ("text", "error")]
        schema = T.StructType([*files.select(*names).schema.fields, *texts_and_errors])

        def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            client = connect()
            for batch in batches:
                texts, errors = [], []
                for uri, content in zip(batch.column("uri").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    try:
                        if cap is not None and len(content) > cap:
                            raise ValueError("file is larger than the converter's cap")
                        texts.append(with_retry(lambda c=content, u=uri: client(c, u)))
                        errors.append(None)
                    except Exception as exc:  # noqa: BLE001 - one bad file must not fail the others
                        texts.append(None)
                        errors.append(f"{type(exc).__name__}: {exc}")
                out = batch.select(names)
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*names, "text", "error"]
                )

        return files.mapInArrow(convert, schema)

    return apply


def join_pages(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Page texts (``keys..., page, text``) as one document text, pages parted by a blank line."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    return pages.groupBy(*keys).agg(F.array_join(ordered, "\n\n").alias("text"))


@dataclass(frozen=True)
class Route:
    """Files below ``subtree`` go to ``extractor``; scans among them to ``on_scan``."""

    subtree: str
    extractor: ExtractorBackend | None = None
    on_scan: ExtractorBackend | None = None


def route_backend(
    uri: Column,
    text: Column | None,
    *,
    roots: Sequence[str],
    routes: Sequence[Route],
    default: ExtractorBackend = ExtractorBackend.TEXT,
    scan_min_chars: int = SCAN_MIN_CHARS,
) -> Column:
    """The backend a file goes to; ``error`` for an image nothing can read.

    The longest matching subtree wins, the first route among equals. The handful of configured
    routes becomes a ``CASE`` chain ordered by depth: no join, and nothing to broadcast. ``text``
    is the base extraction of a PDF, when it is already known; with too little of it the PDF is a
    scan.
    """
    path = path_of(uri)
    candidates: list[tuple[int, int, Route, Column]] = []
    for i, route in enumerate(routes):
        parts = [p for p in route.subtree.split("/") if p not in ("", ".")]
        below = [root.rstrip("/") + "".join("/" + p for p in parts) for root in roots]
        match = F.lit(False)
        for prefix in below:
            match = match | (path == prefix) | F.startswith(path, F.lit(prefix + "/"))
        candidates.append((-len(parts), i, route, match))
    candidates.sort(key=lambda c: c[:2])

    def pick(value: Callable[[Route], str | None]) -> Column:
        chain: Column | None = None
        for _, _, route, match in candidates:
            found = F.lit(value(route)).cast("string")
            chain = F.when(match, found) if chain is None else chain.when(match, found)
        return F.lit(None).cast("string") if chain is None else chain

    explicit, on_scan = pick(lambda r: r.extractor), pick(lambda r: r.on_scan)
    suffix = suffix_of(path)
    office = F.when(suffix.isin(*OFFICE_SUFFIXES), F.lit("markitdown")).otherwise(F.lit("text"))
    fallback = office if default is ExtractorBackend.TEXT else F.lit(str(default))
    base = F.coalesce(explicit, fallback)
    reader = F.coalesce(explicit, F.lit(str(default)))
    image = F.coalesce(on_scan, F.when(reader.isin(*OCR_BACKENDS), reader), F.lit("error"))
    scanned = (suffix == ".pdf") & on_scan.isNotNull()
    if text is not None:
        scanned = scanned & (F.length(strip(text)) < scan_min_chars)
    else:
        scanned = F.lit(False)
    return F.when(suffix.isin(*IMAGE_SUFFIXES), image).when(scanned, on_scan).otherwise(base)


def check_routes(routes: Sequence[Route]) -> None:
    for route in routes:
        if route.on_scan is not None and route.on_scan not in OCR_BACKENDS:
            raise ConfigError(f"route {route.subtree!r}: {route.on_scan} cannot read a scan")
