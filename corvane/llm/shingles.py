"""Words and word sequences as 64-bit hashes, in numpy, one text at a time."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

from corvane.llm.common import mix64

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE), np.full(size, INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(12, (n - 1).bit_length()))
    return up[:n], down[:n]


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every ``k`` consecutive words: a polynomial modulo 2**64, shifted to its start and mixed."""
    n = len(hashes)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(n)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    return mix64((sums[k:] - sums[:-k]) * down[: n - k + 1])


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of a lower-cased text (A-Z only).

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    hashes = word_hashes(text.lower().split())
    if not len(hashes):
        return hashes
    return np.unique(rolling(hashes, min(k, len(hashes))) ^ np.uint64(min(k, len(hashes))))


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``width`` consecutive values, by doubling."""
    size = 1
    while size * 2 <= width:
        values = best(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def minimizers(mers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For mers of a text: which are least in some run of ``width``, and each run's least mer."""
    least = sliding(mers, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    return sliding(np.concatenate([edge, least, edge]), width, np.maximum) == mers, least
