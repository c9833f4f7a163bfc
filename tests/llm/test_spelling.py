import random
import re
import zlib
from collections import Counter

import brute
import pytest

from corvane.llm.spelling import LEVELS, variants


def expected(rows):
    """word, form, root, n, n_near, form_n by trying every edit of every word."""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = brute.lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    known = {w: n for w, n in counts.items() if n >= 3 and len(w) >= 5}
    letters = sorted({c for w in known for c in w})

    def near(w):
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        edits |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        return [x for x in edits - {w} if x in known]

    others = {w: near(w) for w in known}
    form = {}
    for w, some in others.items():
        best = min(some, key=lambda x: (-known[x], x), default=None)
        if best is not None and known[best] >= 2 * known[w]:
            form[w] = best
    out = []
    for w, n in known.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(others[w]), known.get(form.get(w))))
    return brute.by_key(out)


def odd():
    rng = random.Random(5)
    base = "".join(rng.choice("abcdéÿ×") for _ in range(LEVELS + 6))
    long = [
        base, base[:30] + base[31:], base[:30] + "z" + base[31:], base[:30] + "y" + base[31:], base + "q", base[1:], base[:LEVELS],
        base[: LEVELS - 1], base[: LEVELS + 1], "z" + base[:LEVELS], base[:10] + base[11:LEVELS],
    ]
    runs = "aaaaa aaaaaa aaaaaaa " * 5 + "aabbb abbbb aabbbb babab ababa " * 4
    return [
        (None, " ".join(long * 3)), (5, "Hello hello hEllo hellos helo heLLo hallo hallo hallo"), (5, None), (6, ""), (7, runs),
        (7, runs), (8, "École école ÉCOLE ecole ecole Ecole 123 --"), (9, "x" * 30_000), (9, "x" * 30_000), (10, "x" * 30_000),
    ]


@pytest.mark.parametrize("rows", [odd(), brute.odd_rows()], ids=["words", "texts"])
def test_variants_equal_brute_force(spark, rows):
    short = [r for r in rows if not (r[1] or "").startswith("x" * 99)]
    got = [tuple(r) for r in variants(brute.frame(spark, rows)).collect()]
    long = [r for r in got if r[0].startswith("x" * 99)]
    assert brute.by_key([r for r in got if r not in long]) == expected(short)
    assert len(long) == (len(short) < len(rows)) and all(r[1:] == (None, r[0], 3, 0, None) for r in long)


def test_variants_of_whole_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert brute.by_key(tuple(r) for r in variants(docs).collect()) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_variants_of_an_empty_table(spark):
    assert variants(brute.frame(spark, [])).collect() == []
