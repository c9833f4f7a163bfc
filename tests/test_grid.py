"""The chunks of the sweep are counted per token and ranked past a floor."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators import embed, topk
from corvane.operators.chunking import whitespace_windows

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("profiles", [[(4, 0), (4, 2), (8, 0), (8, 2)], [(3, 0)], [(5, 7)]])
def test_windows_are_counted_from_the_buckets_of_a_text(spark, profiles):
    texts = [" ".join(RNG.choice(["Red", "fox", "Σας", "über", "a b"], size=n)) for n in (0, 1, 3, 4, 5, 8, 17)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1)
    held = [r.b for r in df.orderBy("i").select(embed.hash_buckets(16, "md5")(F.col("text")).alias("b")).collect()]
    assert held[-1] is None
    docs = [np.frombuffer(b or b"", dtype="<u2").astype(np.int64) for b in held]
    for (cap, overlap), (doc, ordinal, bags) in zip(profiles, embed.window_bags(docs, 16, profiles), strict=True):
        cut = df.select("i", F.posexplode(whitespace_windows(tokens(F.col("text")), cap, overlap)).alias("o", "w")).orderBy("i", "o").collect()
        assert [(r.i, r.o) for r in cut] == list(zip(doc.tolist(), ordinal.tolist(), strict=True))
        want = embed.hash_vectors([" ".join(r.w) for r in cut], 16, "md5")
        assert np.allclose(topk._unit_rows(bags.astype(float)), want)


def test_tokens_in_use_stay_known_when_the_table_fills(monkeypatch):
    hashed = []
    monkeypatch.setattr(embed, "_bucket", lambda token, dim, digest: hashed.append(token) or len(token))
    table = embed._Buckets(8, "md5", limit=10)
    for i in range(100):
        assert table["the"] == 3 and table[f"rare{i}"] == len(f"rare{i}")
    assert hashed.count("the") == 1 and len(table) + len(table.earlier) <= 20


class Sent:
    """What a broadcast gives a task."""

    def __init__(self, value):
        self.value = value


@pytest.mark.parametrize("unique", [[], ["doc"]])
def test_few_rows_are_sorted_once_the_floor_is_known(monkeypatch, unique):
    vectors, asked = RNG.normal(size=(40_000, 8)), topk._unit_rows(RNG.normal(size=(5, 8)))
    doc, lang = RNG.integers(0, 9_000, 40_000), RNG.choice(["a", "b", None], 40_000)
    table = pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(np.arange(40_000)), pa.array(lang.tolist(), pa.string()), embed.list_array(vectors)], ["doc", "id", "lang", "vector"]
    )
    sorted_rows, best = [], topk._best
    monkeypatch.setattr(topk, "_best", lambda found, *rest: sorted_rows.append(found.num_rows) or best(found, *rest))
    monkeypatch.setattr(topk, "WAITING", 500)
    build = lambda part: topk._unit_rows(topk._matrix(part.column("vector"), 8))
    batches = [table.slice(at, 200) for at in range(0, 40_000, 200)]
    out = topk._scan(batches, Sent((list(range(5)), asked)), build, 8, 4, ["doc", "id"], ["lang"], unique, 6, pa.int64(), None)
    got = sorted((r["qid"], r["lang"] or "", r["doc"], r["id"], r["score"]) for b in out for r in b.to_pylist())
    scores = np.round(topk._unit_rows(vectors) @ asked.T, 6) + 0.0
    want = []
    for q in range(5):
        for one in ("a", "b", None):
            seen, left = set(), 4
            for s, d, i in sorted((-scores[i, q], doc[i], i) for i in np.flatnonzero(lang == one)):  # noqa: E711
                if left and not (unique and d in seen):
                    seen.add(d)
                    left -= 1
                    want.append((q, one or "", int(d), int(i), float(-s)))
    assert got == sorted(want)
    assert sum(sorted_rows) < 6_000  # every batch sorted with the rows kept: 200 x 60 at least
