"""Deterministic resampling weights, usable in any SQL engine."""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5
from itertools import accumulate
from math import exp, factorial, sin

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Cumulative Poisson(1) probabilities: how many copies of a unit a resample holds.
POISSON_CDF = [round(p, 12) for p in accumulate(exp(-1) / factorial(i) for i in range(9))]


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends only on the values of ``parts``."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


DRAWS = 8  # 16-bit numbers in one MD5


WEIGHT_OF = np.searchsorted(np.array(POISSON_CDF), np.arange(1 << 16) / 65536.0, side="right").astype(np.uint8)  # of a drawn number
UNITS = 16  # units that are hashed together: some 20,000 messages
MD5_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
MD5_SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def poisson_weights(unit: str, resamples: int) -> np.ndarray:
    """How often each resample holds ``unit``: 16-bit uniform numbers from MD5s of the unit and a counter."""
    return poisson_matrix([unit], resamples)[0]


def poisson_matrix(units: Sequence[str], resamples: int) -> np.ndarray:
    """:func:`poisson_weights` of many units, a row each."""
    names = [u.encode() for u in units]
    out = np.empty((len(names), resamples), dtype=np.uint8)
    blocks = -(-resamples // DRAWS)
    for at in range(0, len(names), UNITS):
        some = names[at : at + UNITS]
        out[at : at + UNITS] = WEIGHT_OF[_digests(some, blocks).view(">u2").reshape(len(some), -1)[:, :resamples]]
    return out


def _digests(names: list[bytes], blocks: int) -> np.ndarray:
    """The MD5 of ``name|k`` for every name and each k below ``blocks``: an array of words, four a digest."""
    tails = [b"|%d" % k for k in range(blocks)]
    if max(len(n) for n in names) + len(tails[-1]) > 55:  # more than one block of MD5
        raw = b"".join(md5(n + t, usedforsecurity=False).digest() for n in names for t in tails)
        return np.frombuffer(raw, dtype="<u4").reshape(len(names), blocks, 4)
    ends = np.array([t + b"\x80" for t in tails])
    ends = ends.view(np.uint8).reshape(blocks, -1)
    sizes = np.array([len(t) for t in tails])
    text = np.zeros((len(names), blocks, 64), dtype=np.uint8)
    for i, name in enumerate(names):
        text[i, :, : len(name)] = np.frombuffer(name, dtype=np.uint8)
        text[i, :, len(name) : len(name) + ends.shape[1]] = ends
        text[i, :, 56:58] = ((len(name) + sizes) * 8).astype("<u2").view(np.uint8).reshape(blocks, 2)
    return md5_blocks(np.ascontiguousarray(text.reshape(-1, 64).view("<u4").T)).reshape(len(names), blocks, 4)


def md5_blocks(words: np.ndarray) -> np.ndarray:
    """MD5 of many padded messages of one block each: ``words`` has a row per word of the block and a column per message."""
    a, b, c, d = (np.full(words.shape[1], x, dtype=np.uint32) for x in MD5_START)
    for i in range(64):
        turn, g = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        mixed = (lambda: d ^ (b & (c ^ d)), lambda: c ^ (d & (b ^ c)), lambda: b ^ c ^ d, lambda: c ^ (b | ~d))[turn]()
        mixed += a
        mixed += words[g]
        mixed += np.uint32(MD5_SINES[i])
        shift = MD5_SHIFTS[turn][i % 4]
        a, d, c, b = d, c, b, b + ((mixed << np.uint32(shift)) | (mixed >> np.uint32(32 - shift)))
    return np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), MD5_START, strict=True)], axis=1)
