import random

import brute
import numpy as np
import pytest

from corvane.llm import components as module
from corvane.llm import jaccard
from corvane.llm.components import components
from corvane.llm.jaccard import across, most_shared, near_components, signature
from corvane.llm.lines import dedup_lines
from corvane.llm.shingles import minimizers, rolling, shingle_set, word_hashes
from corvane.llm.spans import dedup_spans, repeated_spans

ROWS = brute.odd_rows()


def test_near_components_equal_brute_force(spark):
    got = [tuple(r) for r in near_components(brute.frame(spark, ROWS)).collect()]
    assert brute.by_key(got) == brute.by_key(brute.near_components(ROWS))


def test_repeated_ids_with_texts_of_two_sizes(spark):
    """Chains whose ends meet only through the middle, each id with two texts: under every key each id stands twice."""
    rows = []
    for family in range(8):
        words = [f"f{family}x{k}" for k in range(250)]
        for member in range(3):
            doc = None if (family, member) == (5, 2) else 100 * family + member
            text = words[24 * member : 24 * member + 200]
            rows += [(doc, " ".join(text)), (doc, " ".join([*text, f"more{family}of{member}"]))]
    got = [tuple(r) for r in near_components(brute.frame(spark, rows)).collect()]
    assert brute.by_key(got) == brute.by_key(brute.near_components(rows))


def edited_family(members, least, most, seed):
    """Edits of one text, all of about its size; the smallest ids are edited most, so that few are near them."""
    rng = random.Random(seed)
    words = [f"s{seed}w{k}" for k in range(150)]
    rows = []
    for member in range(members):
        text = list(words)
        for at in rng.sample(range(150), most if member < 5 else rng.randrange(least, most)):
            text[at] = f"m{member}at{at}"
        rows.append((1000 * seed + member, " ".join(text)))
    return rows


def test_a_family_without_a_hub_gives_pairs_in_proportion(spark, monkeypatch):
    """Very many pairs are similar or nearly so, and no leader ties them: only likely ties leave the tiles."""
    rows = edited_family(240, 1, 7, 1) + edited_family(60, 3, 5, 2)
    made = []

    def counted(*x):
        made.append((out := across(*x)).count())
        return out

    monkeypatch.setattr(jaccard, "across", counted)
    got = [tuple(r) for r in near_components(brute.frame(spark, rows)).collect()]
    assert brute.by_key(got) == brute.by_key(brute.near_components(rows))
    assert len(made) == 2 and sum(made) <= 4 * len(rows), made


def test_tiles_of_many_groups_lose_no_link(spark, monkeypatch):
    for name, value in {"TILE": 9, "TILE_SHINGLES": 1000, "FIRSTS": 1}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = edited_family(60, 1, 7, 3) + ROWS
    got = [tuple(r) for r in near_components(brute.frame(spark, rows)).collect()]
    assert brute.by_key(got) == brute.by_key(brute.near_components(rows))


@pytest.mark.parametrize("few", [0, 32, 1000])
def test_tiles_give_the_pairs_that_bitmaps_allow(monkeypatch, few):
    """A tile's rows against each other, one pair at a time, over bitmaps of several widths."""
    monkeypatch.setattr(jaccard, "FEW", few)
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    sets = sorted((np.unique(rng.choice(pool[: int(n * 1.12)], n, replace=False)) for n in rng.integers(55, 600, 120)), key=len)
    n, sigs = np.array([len(s) for s in sets]), [signature(s) for s in sets]
    part, group = rng.integers(0, 40, len(sets)), rng.integers(0, 2, len(sets))
    for g in (None, group):
        allowed = {
            (j, i) for i in range(len(sets)) for j in range(i)
            if part[i] != part[j] and (g is None or g[i] != g[j]) and 3 * n[i] <= 4 * n[j] and jaccard.similar(most_shared(n[i], sigs[i], n[j], sigs[j]), n[i], n[j])
        }
        tile = jaccard.Tile(n, sigs)
        firsts = np.arange(len(sets))[:, None] + 1000 * np.ones((1, 8), np.int64)
        assert set(tile.complete(part, g, 7, firsts)) == allowed and len({len(s) for s in sigs}) > 2
        met = np.full((len(sets), 8), 7)
        assert set(tile.complete(part, g, 7, met)) == allowed and tile.complete(part, g, 8, met) == []

        def tied(pairs):
            root = {int(p): int(p) for p in part}
            for a, b in pairs:
                x, y = root[int(part[a])], root[int(part[b])]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
            return root

        forest = tile.forest(part, g)
        assert {(min(p), max(p)) for p in forest} <= allowed and tied(forest) == tied(allowed)
        assert len(forest) == len(set(part.tolist())) - len(set(tied(allowed).values()))


def test_lines_equal_brute_force(spark):
    got = [tuple(r)[:4] for r in dedup_lines(brute.frame(spark, ROWS), carry=["lang", "id"]).collect()]
    assert brute.by_key(got) == brute.by_key(brute.dedup_lines(ROWS))


def test_a_full_filter_costs_no_result(spark):
    got = [tuple(r)[:4] for r in dedup_lines(brute.frame(spark, ROWS), bits=1 << 10).collect()]
    assert brute.by_key(got) == brute.by_key(brute.dedup_lines(ROWS))


def test_spans_equal_brute_force(spark):
    got = [tuple(r) for r in dedup_spans(brute.frame(spark, ROWS)).collect()]
    assert brute.by_key(got) == brute.by_key(brute.dedup_spans(ROWS))


def test_source_coordinates_hold_the_same_words(spark):
    rows = [r for r in ROWS if r[0] not in (None, 5, 18)]
    texts = {d: brute.words(t) for d, t in rows}
    spans = repeated_spans(brute.frame(spark, rows)).collect()
    assert spans
    for s in spans:
        mine = texts[s["id"]][s["first"] : s["first"] + s["n_words"]]
        assert s["source_id"] < s["id"] and len(mine) == s["n_words"] >= 50
        assert mine == texts[s["source_id"]][s["source_first"] : s["source_first"] + s["n_words"]]


@pytest.mark.parametrize("operator", [near_components, dedup_lines, dedup_spans])
def test_empty_table(spark, operator):
    assert operator(brute.frame(spark, [])).collect() == []


def test_components_of_a_long_path_and_a_busy_id(spark):
    path = [(k, k + 1) for k in range(100, 300)]
    star = [(1, k) for k in range(1000, 1100)]
    links = spark.createDataFrame([*path, *star, (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(links, "a", "b").collect()}
    assert got == {k: 100 for k in range(100, 301)} | {k: 1 for k in [1, *range(1000, 1100)]}


def test_few_links_are_united_in_one_pass(spark, monkeypatch):
    """Rounds over a few links cost the driver plans, threads and broadcasts; many links still take them."""
    rng = random.Random(5)
    pairs = [(rng.randrange(-50, 400), rng.randrange(-50, 400)) for _ in range(300)] + [(2**62, -(2**62)), (3, 3), (None, 4)]
    links = spark.createDataFrame(pairs, "a long, b long")
    written = []
    settled = module.settled
    monkeypatch.setattr(module, "settled", lambda edges: written.append(1) or settled(edges))
    few = {tuple(r) for r in components(links, "a", "b").collect()}
    assert len(written) == 1 and components(links.limit(0), "a", "b").collect() == []
    monkeypatch.setattr(module, "FEW", 0)
    rounds = [tuple(r) for r in components(links, "a", "b").collect()]
    assert len(written) > 3 and len(rounds) == len(few) and set(rounds) == few
    monkeypatch.setattr(module, "FEW", 240)  # some rounds, and then few links
    assert {tuple(r) for r in components(links, "a", "b").collect()} == few


def test_bitmaps_never_bound_the_overlap_too_low():
    texts = [(t or "").encode() for _, t in ROWS]
    sets = [s for s in (shingle_set(t, 5) for t in texts) if len(s)]
    for a in sets:
        for b in sets:
            assert most_shared(len(a), signature(a), len(b), signature(b)) >= len(set(a.tolist()) & set(b.tolist()))


def test_equal_windows_have_equal_least_anchors():
    text = ROWS[0][1].encode().split()
    at = word_hashes([b"other"] * 7 + text + [b"end"] * 5)
    own, moved = (minimizers(rolling(h, 32), 19)[1] for h in (word_hashes(text), at))
    assert own.tolist() == moved[7 : 7 + len(own)].tolist()
