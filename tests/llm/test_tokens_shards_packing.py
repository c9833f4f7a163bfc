import random
import struct
import zlib
from collections import Counter, defaultdict

import brute
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm.packing import pack, sweep, token_ids, tokenizer
from corvane.llm.queries import packing_files
from corvane.llm.sharding import place
from corvane.llm.tokens import decode, encode, encoding, parts

ROWS = brute.odd_rows()
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def test_encoding_is_the_librarys_and_decodes_to_the_bytes(spark):
    code = encoding(RANKS, PATTERN)
    df = brute.frame(spark, ROWS)
    out = decode(encode(df.select("doc_id", "text"), RANKS, PATTERN), RANKS, PATTERN).collect()
    got = brute.by_key((r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in out)
    assert got == brute.by_key((d, code.encode_ordinary(t or ""), (t or "").encode()) for d, t in ROWS)


@given(st.text(alphabet="ab1 .\n\t'sé🙂", max_size=200), st.integers(1, 20))
@settings(max_examples=300, deadline=None)
def test_parts_are_cut_where_matches_end(text, size):
    code = encoding(RANKS, PATTERN)
    cut = list(parts(text, size))
    assert "".join(cut) == text
    assert [i for p in cut for i in code.encode_ordinary(p)] == code.encode_ordinary(text)


def test_broken_ids_decode_to_raw_bytes(spark):
    ids = encoding(RANKS, PATTERN).encode_ordinary("日本")[:1]
    out = decode(spark.createDataFrame([(ids,), (None,)], "ids array<int>"), RANKS, PATTERN).collect()
    assert [bytes(r["decoded"]) for r in out] == [encoding(RANKS, PATTERN).decode_bytes(ids), b""]


@given(st.text(alphabet="ab1 .\n\t'sé🙂 \x1c　", max_size=80))
@settings(max_examples=300, deadline=None)
def test_both_ways_give_the_same_ids(text):
    files = packing_files()
    for t in (text, text + "<|endoftext|>"):
        ids = tokenizer(files[0]).encode(t, add_special_tokens=False).ids
        assert token_ids([t], *files) == token_ids([t], files[0], None) == [struct.pack(f"<{len(ids)}I", *ids)]


def test_packing(spark):
    width = 64
    rows = [*ROWS, *[(k, " ".join(["word"] * (k % 60))) for k in range(200, 500)]]
    got = pack(brute.frame(spark, rows), *packing_files(), width=width).collect()
    code = tokenizer(packing_files()[0])
    want = Counter()
    for d, t in rows:
        ids = [*code.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % width or width, len(ids), width), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[d, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= width
    assert len(bins) <= 1.05 * sum(r["length"] for r in got) / width + 1
    assert pack(brute.frame(spark, []), *packing_files()).collect() == []


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
@settings(max_examples=200, deadline=None)
def test_sweep_is_best_fit_by_falling_length(counts):
    gaps, n = [], 0  # one document after the other into the smallest gap that holds it
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [g for g in gaps if g >= length]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - length)
            else:
                n += 1
                gaps.append(40 - length)
    plan = sweep(counts, 40)
    left = Counter()
    for length, _, many, first, at, per in plan:
        for k in range(many):
            left[first + k // per] += length
            assert at + (k % per + 1) * length <= 40
    assert len(left) == n and Counter({c: sum(p[2] for p in plan if p[0] == c) for c in counts}) == Counter(counts)
    assert sorted(40 - v for v in left.values()) == sorted(gaps)


def best(key, shards):
    """The shard by the definition: Spark's hash of the key and then the shard, as a uniform number."""
    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    return max(range(shards), key=lambda i: xxhash.xxh64_intdigest(struct.pack("<i", i), seed=seed) >> 11)


def test_sharding(spark):
    rng = random.Random(1)
    rows = [*ROWS, *[(rng.getrandbits(60), "t") for _ in range(3000)]]
    df = brute.frame(spark, rows).repartition(5)
    out = place(df, "doc_id", [1.0] * 8, [1.0] * 9, [F.col("doc_id")]).collect()
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        assert r["shard"] == best(r["doc_id"], 8) and r["grown_shard"] in (r["shard"], 8) and r["grown_shard"] == best(r["doc_id"], 9)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert place(brute.frame(spark, []), "doc_id", [1.0], [1.0, 1.0], [F.col("doc_id")]).collect() == []


def test_weights_share_the_rows(spark):
    keys = spark.range(20_000)
    n = Counter(r["shard"] for r in place(keys, "id", [1.0, 3.0], [1.0, 3.0, 1.0], [F.col("id")]).collect())
    assert abs(n[1] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        place(keys, "id", [1.0, 0.0], [1.0], [])


def test_carried_names_do_not_clash(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, __text string")
    got = encode(df.withColumn("text_", F.lit("z")), RANKS, PATTERN, keep=("doc_id", "__text", "text_"))
    assert sorted((r["doc_id"], r["__text"], r["text_"], len(r["ids"])) for r in got.collect()) == [(1, "x", "z", 2), (2, "y", "z", 0)]
    placed = place(df, "doc_id", [1.0] * 3, [1.0] * 4, [F.col("doc_id"), F.col("__text").alias("__own"), F.lit(9).alias("shard"), F.lit("p").alias("part")])
    assert placed.columns == ["doc_id", "__own", "part", "shard", "slot", "grown_shard"]
    assert sorted((r["doc_id"], r["__own"], r["part"]) for r in placed.collect()) == [(1, "x", "p"), (2, "y", "p")]
