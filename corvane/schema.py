"""Table schemas, option enums and the checks that guard them."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCES = T.StructType(
    [
        T.StructField("uri", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("mtime", T.DoubleType(), False),
    ]
)

DOCUMENTS = T.StructType([*SOURCES.fields, T.StructField("text", T.StringType(), False)])

CHUNKS = T.StructType(
    [
        T.StructField("uri", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("content_hash", T.StringType(), False),
        T.StructField("mtime", T.DoubleType(), False),
        T.StructField("ordinal", T.IntegerType(), False),
        T.StructField("token_count", T.IntegerType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("summary", T.StringType(), True),
        T.StructField("vector", T.ArrayType(T.DoubleType(), False), False),
        T.StructField("seq", T.LongType(), False),
    ]
)

CHUNK_FILE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("source_uri", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("token_count", T.IntegerType()),
    ]
)

SQUAD = T.StructType(
    [
        T.StructField("context", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField(
            "answers",
            T.StructType(
                [
                    T.StructField("text", T.ArrayType(T.StringType())),
                    T.StructField("answer_start", T.ArrayType(T.IntegerType())),
                ]
            ),
        ),
    ]
)

LAYOUT_PAGE = T.ArrayType(
    T.StructType(
        [
            T.StructField("category_type", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("ignore", T.BooleanType()),
            T.StructField("order", T.DoubleType()),
        ]
    )
)


class ChunkStrategy(StrEnum):
    WHITESPACE = "whitespace"
    RECURSIVE = "recursive"
    MARKDOWN = "markdown"
    FAST = "fast"
    SEMANTIC = "semantic"
    LATE = "late"


class ExtractorBackend(StrEnum):
    TEXT = "text"
    MARKITDOWN = "markitdown"
    DOCLING = "docling"
    XBERG = "xberg"
    MINERU = "mineru"
    OLMOCR = "olmocr"
    OPENAI_VISION = "openai_vision"


class ChangeKind(StrEnum):
    CREATED = "created"
    MODIFIED = "modified"
    DELETED = "deleted"


class EngineError(Exception):
    """Base of every error this package raises on purpose."""


class StoreError(EngineError):
    """A collection is unknown, damaged or asked for something it cannot hold."""


class DimensionError(EngineError, ValueError):
    """A vector has a width other than its collection's."""


class ConfigError(EngineError, ValueError):
    """An option or a declarative spec does not make sense."""


@dataclass(frozen=True)
class Collection:
    """A named vector table pinned to one model and one width."""

    name: str
    model_id: str
    dim: int

    def __post_init__(self) -> None:
        if not self.name.strip() or not self.model_id.strip():
            raise ConfigError("a collection needs a name and a model id")
        if self.dim <= 0:
            raise ConfigError("a collection needs a positive dimension")


@dataclass(frozen=True)
class Dataset:
    """One searchable dataset: a collection plus how it may be used."""

    name: str
    collection: str
    model_key: str
    roots: tuple[str, ...] = ()
    read_only: bool = False
    writable: bool = False

    def __post_init__(self) -> None:
        if self.writable and (self.read_only or self.roots):
            raise ConfigError("a writable dataset has no sources of its own and is not read-only")

    @property
    def watched(self) -> bool:
        return bool(self.roots) and not self.read_only and not self.writable

    def check_reindex(self) -> None:
        if self.read_only or self.writable:
            raise EngineError(f"dataset {self.name!r} does not accept a re-index")

    def check_write(self) -> None:
        if not self.writable:
            raise EngineError(f"dataset {self.name!r} is not writable")


def pick_dataset(datasets: dict[str, Dataset], name: str) -> Dataset:
    """The named dataset; the error lists the ones that exist."""
    if name not in datasets:
        raise EngineError(f"unknown dataset {name!r}; known: {', '.join(sorted(datasets))}")
    return datasets[name]


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ConfigError(f"missing columns {missing}; got {df.columns}")


def checked_vector(vector: Column, dim: int) -> Column:
    """``vector``, failing the row's task when its width is not ``dim``."""
    message = F.concat(F.lit(f"expected a vector of width {dim}, got "), F.size(vector).cast("string"))
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(message))
