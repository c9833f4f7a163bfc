"""Embedding providers as Arrow UDFs, and the deterministic hash embedder that needs no model."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.schema import ConfigError, EngineError

DEFAULT_DIM = 256  # fixed value: buckets of the hash embedder


def _bucket(token: str, dim: int, digest: str) -> int:
    raw = token.encode("utf-8")
    if digest == "blake2b":
        return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "big") % dim
    return int.from_bytes(hashlib.md5(raw, usedforsecurity=False).digest()[:4], "big") % dim


class _Buckets(dict):
    """Token -> bucket; a token in use is hashed once per worker batch stream.

    A full table becomes the earlier one, in which tokens are still found, so rare tokens push out rare ones only.
    """

    def __init__(self, dim: int, digest: str, limit: int = 1 << 17) -> None:
        super().__init__()
        self.dim, self.digest, self.limit = dim, digest, limit
        self.earlier: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        if len(self) >= self.limit:
            self.earlier = dict(self)
            self.clear()
        value = self.earlier.get(token)
        if value is None:
            value = _bucket(token, self.dim, self.digest)
        self[token] = value
        return value


def hash_vectors(texts: Sequence[str], dim: int, digest: str, buckets: _Buckets | None = None) -> np.ndarray:
    """Bucket counts of the lower-cased tokens of each text, L2-normalised; zero rows stay zero."""
    table = buckets if buckets is not None else _Buckets(dim, digest)
    rows = [[table[t] for t in (text or "").lower().split()] for text in texts]
    sizes = np.fromiter((len(r) for r in rows), dtype=np.int64, count=len(rows))
    flat = np.fromiter((b for r in rows for b in r), dtype=np.int64, count=int(sizes.sum()))
    cells = np.repeat(np.arange(len(rows)), sizes) * dim + flat
    counts = np.bincount(cells, minlength=len(rows) * dim).astype(np.float64).reshape(len(rows), dim)
    norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
    return np.divide(counts, norms, out=np.zeros_like(counts), where=norms > 0)


def list_array(matrix: np.ndarray) -> pa.Array:
    """A matrix as an Arrow ``list<double>`` column, without a Python object per value."""
    n, dim = matrix.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dim)
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1), type=pa.float64()))


def hash_embedder(dim: int = DEFAULT_DIM, digest: str = "blake2b") -> Callable[[Column], Column]:
    """The model-free embedder as a column function."""
    if dim < 1:
        raise ConfigError("an embedder needs a positive dimension")
    if digest not in ("blake2b", "md5"):
        raise ConfigError(f"unknown digest {digest!r}")

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _Buckets(dim, digest)
        for batch in batches:
            yield list_array(hash_vectors(batch.to_pylist(), dim, digest, table))

    return embed


def hash_buckets(dim: int, digest: str = "blake2b") -> Callable[[Column], Column]:
    """The bucket of every token of a text under :func:`hash_embedder`, two bytes each: what its windows' vectors are counted from."""
    if not 1 <= dim <= 1 << 16:
        raise ConfigError("buckets of two bytes need a dimension of 1 to 65,536")

    @F.arrow_udf("binary")
    def buckets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _Buckets(dim, digest)
        for batch in batches:
            yield pa.array([None if x is None else np.array([table[t] for t in x.lower().split()], dtype="<u2").tobytes() for x in batch.to_pylist()], pa.binary())

    return buckets


def window_bags(docs: Sequence[np.ndarray], dim: int, profiles: Sequence[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per ``(cap, overlap)``: document, ordinal and bucket counts of every whitespace window (:func:`whitespace_windows`) of
    documents given by their buckets.

    Counts are differences of running sums over blocks that all cuts and overlaps fall on, so no token is counted per window.
    """
    width = math.gcd(*[x for profile in profiles for x in profile])
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    blocks = -(-sizes // width)
    begun = np.cumsum(blocks) - blocks
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    cells = (np.repeat(begun, sizes) + place // width) * dim + (np.concatenate(docs) if len(docs) else place)
    sums = np.zeros((int(blocks.sum()) + 1, dim), dtype=np.int64)
    np.cumsum(np.bincount(cells, minlength=int(blocks.sum()) * dim).reshape(-1, dim), axis=0, out=sums[1:])
    for cap, overlap in profiles:
        windows = -(-sizes // cap)
        doc = np.repeat(np.arange(len(docs)), windows)
        ordinal = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        first = np.maximum(ordinal * cap - overlap, 0) // width
        last = np.minimum((ordinal + 1) * (cap // width), blocks[doc])
        yield doc, ordinal, sums[begun[doc] + last] - sums[begun[doc] + first]


Client = Callable[[list[str]], list[list[float]]]


def call_in_batches(client: Client, texts: list[str], batch: int) -> list[list[float]]:
    """Cap the passages per call; a non-positive cap, or one not reached, means one call."""
    if not texts:
        return []
    if batch <= 0 or batch >= len(texts):
        groups = [texts]
    else:
        groups = [texts[i : i + batch] for i in range(0, len(texts), batch)]
    out: list[list[float]] = []
    for group in groups:
        vectors = client(group)
        if len(vectors) != len(group):
            raise EngineError(f"the provider returned {len(vectors)} vectors for {len(group)} texts")
        out.extend(vectors)
    return out


class Transient(Exception):
    """A failure worth another try: a server error, a rate limit, a broken transport."""


def with_retry(
    call: Callable[[], object], *, tries: int = 4, first_wait: float = 1.0, longest: float = 30.0,
    sleep: Callable[[float], None] = time.sleep,
) -> object:
    """Try ``tries`` times, doubling the wait up to ``longest``; other errors pass through."""
    wait = first_wait
    for attempt in range(tries):
        try:
            return call()
        except Transient:
            if attempt == tries - 1:
                raise
            sleep(min(wait, longest))
            wait *= 2
    raise AssertionError("unreachable")


def resilient(
    call: Callable[[], object], *, restart: Callable[[], None] | None, healthy: Callable[[], bool],
    timeout: float = 60.0, poll: float = 1.0, sleep: Callable[[float], None] = time.sleep,
) -> object:
    """Run ``call``; on a failure restart the provider, wait until it is healthy, try once more."""
    try:
        return call()
    except EngineError:
        if restart is None:
            raise
        restart()
        waited = 0.0
        while not healthy():
            if waited >= timeout:
                raise
            sleep(poll)
            waited += poll
        return call()


def provider_embedder(
    connect: Callable[[], Client], dim: int, *, batch: int = 0, prefix: str = "", applies_own_prefix: bool = False
) -> Callable[[Column], Column]:
    """Any external model as a column function.

    ``connect`` runs once per Python worker (it loads the model or opens the HTTP client), never
    on the driver. A prefix is refused for providers that add their own.
    """
    if prefix and applies_own_prefix:
        raise ConfigError("this provider applies its own query and passage prefixes")

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client = connect()
        for texts in batches:
            wanted = texts.to_pylist()
            vectors = with_retry(lambda: call_in_batches(client, wanted, batch))
            matrix = np.asarray(vectors, dtype=np.float64).reshape(len(wanted), -1)
            if len(wanted) and matrix.shape[1] != dim:
                raise EngineError(f"the provider returned width {matrix.shape[1]}, the collection has {dim}")
            yield list_array(matrix.reshape(len(wanted), dim))

    return (lambda c: embed(F.concat(F.lit(prefix), c))) if prefix else embed


def embed_once(rows: DataFrame, text: str, keys: Sequence[str], embedder: Callable[[Column], Column]) -> DataFrame:
    """Embed each distinct ``(keys, text)`` once and join the vector back to every row."""
    distinct = rows.select(*keys, text).distinct()
    vectors = distinct.withColumn("vector", embedder(F.col(text)))
    return rows.join(vectors, [*keys, text])


def leading_sentences(text: Column, sentences: int = 2) -> Column:
    """An offline summary: the first sentences of a text, however long they are."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)[^.!?]+[.!?]*"), F.lit(0))
    return F.trim(F.array_join(F.slice(found, 1, sentences), ""))


def summarizer(connect: Callable[[], Callable[[str], str]]) -> Callable[[Column], Column]:
    """A language-model summary per document, of its whole text, taken before chunking so it is one call a document."""

    @F.arrow_udf("string")
    def summarize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client = connect()
        for texts in batches:
            yield pa.array(
                [with_retry(lambda t=t: client(t)) for t in texts.to_pylist()], type=pa.string()
            )

    return summarize
