import random
from collections import Counter

import brute
import numpy as np
import pytest

from corvane.llm import suffixes
from corvane.llm.suffixes import dedup_bytes, leading, pieces_of, suffix_array


def expected(rows, window=200):
    seen = Counter()
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        seen.update(b[i : i + window] for i in range(len(b) - window + 1))
    out = []
    for d, b in raw:
        lost = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                lost[i : i + window] = b"\1" * window
        spans = len([x for x in bytes(lost).split(b"\0") if x])
        out.append((d, len(b), sum(lost), spans, bytes(x for x, gone in zip(b, lost, strict=True) if not gone)))
    return brute.by_key(out)


def shifted():
    """Passages at odd places, overlapping, in one text, of one letter, of a short period, at both ends and just too short."""
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcde é\n") for _ in range(n))
    passage, other = make(420), make(260)
    rows = [(k, make(rng.randrange(300)) + passage[k : k + 330] + make(rng.randrange(200))) for k in range(24)]
    rows += [(100 + k, passage[k * 10 : k * 10 + 199] + make(50)) for k in range(6)]
    rows += [(200, other + make(30) + other), (201, "z" * 199), (202, "z" * 700), (203, "xy" * 120), (204, "abcdefg" * 40 + "!"), (205, other[40:] + other[:200])]
    return rows


def collected(spark, rows, **more):
    return brute.by_key(tuple(r)[:4] + (bytes(r["kept"]),) for r in dedup_bytes(brute.frame(spark, rows), **more).collect())


@pytest.mark.parametrize("rows", [shifted(), [r for r in brute.odd_rows() if len(r[1] or "") < 60_000], [(1, "q" * 450)]], ids=["shifted", "odd", "one"])
def test_bytes_equal_brute_force(spark, rows):
    assert collected(spark, rows) == expected(rows)


def test_small_window(spark):
    rows = shifted()
    assert collected(spark, rows, window=60, mer=20) == expected(rows, 60)


def test_an_anchor_of_several_shards(spark, monkeypatch):
    """One passage in all texts, each time in other words, and some of these twice: what is left is found across shards."""
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage = make(90)
    ends = [(make(120), make(120)) for _ in range(40)]
    rows = [(k, f"{ends[k % 37][0]}{passage}{ends[k % 31][1]}{k:05d}") for k in range(70)]
    monkeypatch.setattr(suffixes, "KINDS", 8)
    seen = []
    across = suffixes.across
    monkeypatch.setattr(suffixes, "across", lambda x: (seen.append(x.count()), across(x))[1])
    assert collected(spark, rows) == expected(rows) and seen[0] > 8


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(4)
    for data in (rng.integers(0, 3, 500), np.zeros(90), np.tile(rng.integers(0, 9, 7), 40), rng.integers(0, 256, 1), np.array([0, 0, 5, 0, 0, 0, 5, 0, 0])):
        text = data.astype(np.uint8)
        order, place = suffix_array(text, leading(text))
        raw = text.tobytes()
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:]) and place[order].tolist() == list(range(len(raw)))


def test_every_window_is_in_one_piece(monkeypatch):
    rng = np.random.default_rng(6)
    for data in (rng.integers(0, 4, 5000), np.zeros(3000), rng.integers(0, 256, 199), rng.integers(0, 256, 200)):
        for starts in (1 << 18, 777):
            monkeypatch.setattr(suffixes, "STARTS", starts)
            start, many, _, _ = pieces_of(data.astype(np.uint8), 200, 32)
            covered = np.concatenate([np.arange(s, s + n) for s, n in zip(start, many, strict=True)]) if len(start) else np.empty(0)
            assert covered.tolist() == list(range(max(0, len(data) - 199))) and (many <= 169).all()
            assert len(start) < len(data) / 40 + 3 * (len(data) / starts + 1)


def test_bytes_of_an_empty_table(spark):
    assert dedup_bytes(brute.frame(spark, [])).collect() == []
