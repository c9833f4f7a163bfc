"""Words are counted and listed in bulk; an index for one search looks at asked stems only."""

import pyarrow as pa

from corvane.operators import lexical


def test_every_word_counts_for_the_length_but_asked_stems_alone_are_listed():
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([1, 2, 3]), pa.array(["c"] * 3), pa.array(["english", "german", "english"]),
            pa.array([["the", "foxes", "fox", "running", "whale"], ["der", "katzen", "fox"], []], pa.list_(pa.string())),
        ],
        ["doc", "corpus", "language", "words"],
    )
    got = {r["doc"]: (r["len"], {x["term"]: x["tf"] for x in r["terms"]}) for b in lexical._counted([batch], {"english": {"fox", "runn"}, "german": {"katze"}}) for r in b.to_pylist()}
    assert got == {1: (4, {"fox": 2, "runn": 1}), 2: (2, {"katze": 1}), 3: (0, {})}
    every = {r["doc"]: (r["len"], {x["term"]: x["tf"] for x in r["terms"]}) for b in lexical._counted([batch], None) for r in b.to_pylist()}
    assert every[1] == (4, {"fox": 2, "runn": 1, "whal": 1})


def test_no_ending_takes_the_head_of_a_word():
    for language, rules in lexical.ENDINGS.items():
        endings = {e for rule, _ in rules for e in rule.split("(?:")[-1].removeprefix("^(.{3,})").strip("()$").split("|")}
        for word in (head + e + more for head in ("a", "ab", "abc", "abcd") for e in endings for more in ("", "s", "es")):
            found = lexical.stemmed(word, language)
            assert found is None or found[: lexical.STEM_HEAD] == word[: lexical.STEM_HEAD]


def test_lists_of_a_block_split_over_batches_and_of_an_overfull_one_keep_every_posting(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 2)
    term = pa.struct([("term", pa.string()), ("tf", pa.int32())])
    doc = pa.array([{"id": i} for i in range(12)], pa.struct([("id", pa.int64())]))
    rows = pa.RecordBatch.from_arrays(
        [
            pa.array(["c"] * 12), pa.array([0] + [1] * 11), doc, pa.array([1.0] * 12),
            pa.array([[{"term": "x", "tf": i + 1}, {"term": "y", "tf": 1}][: 1 + i % 2] for i in range(12)], pa.list_(term)),
        ],
        ["corpus", "block", "doc", "long", "terms"],
    )
    made = [r for b in lexical._lists([rows.slice(0, 3), rows.slice(3, 1), rows.slice(4)], 1.5, 0.75) for r in b.to_pylist()]
    held = sorted((r["term"], r["block"], p["doc"]["id"]) for r in made for p in r["postings"])
    assert held == sorted([("x", int(i > 0), i) for i in range(12)] + [("y", 1, i) for i in range(1, 12, 2)])
    assert max(len(r["postings"]) for r in made) <= 8 and sum(r["occurrences"] for r in made) == 78 + 6
    assert all(r["most"] == max(p["impact"] for p in r["postings"]) for r in made)
