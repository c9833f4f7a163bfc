import functools
import hashlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import alignment
from corvane.llm.packing import PLAIN

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@functools.cache
def sides():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    return a, b, lambda i: bytes(letters[c] for c in a.id_to_token(i)) if i != 50256 else b"<|endoftext|>"


def piece_bytes(i):
    piece = sides()[1].id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()


def spans(ids, spelt):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(spelt(i)), i))
        at = out[-1][1]
    return out


def expected(rows):
    a_side, b_side, entry = sides()
    docs, counts = [], Counter()
    for doc, text in rows:
        whole = f" {text or ''}".encode()
        a = spans(a_side.encode(whole.decode(), add_special_tokens=False).ids, entry)
        b = spans(b_side.encode(text or ""), piece_bytes)
        good = text and b"".join(entry(i) for _, _, i in a) == whole == b"".join(piece_bytes(i) for _, _, i in b)
        if not good:
            docs.append((doc, [], [], [], ""))
            continue
        links, k = [], 0
        for s, e, i in b:
            while a[k][1] <= s:
                k += 1
            j = k
            while j < len(a) and a[j][0] < e:
                links.append((a[j][2], i))
                j += 1
        counts.update(links)
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups = [[[], []] for _ in ends]
        for side, tokens in enumerate((a, b)):
            g = 0
            for _, e, i in tokens:
                groups[g][side].append(str(i))
                g += e == ends[g]
        docs.append((doc, a, b, links, ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)))
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return brute.by_key(
        (doc, len(a), len(b), named.count(";") + 1 if a else 0, len(links), sum(counts[x] == most[x[1]] for x in links),
         sum(counts[x] for x in links), hashlib.sha256(named.encode()).hexdigest() if a else "")
        for doc, a, b, links, named in docs
    )


ODD = [
    (50, "plain <|endoftext|> and </s> inside"), (51, "a▁b"), (52, "  two  blanks \n\n\tand tabs  "), (53, "\x00nul ﻿mark é é ﬁ ½"),
    (54, "🙂🙃 日本語のテキスト привет"), (55, " "), (56, "x" * 3000), (57, "ab cd " * 30_000), (58, "<0x41> [UNK]"), (59, "line\r\nend x y"),
]


@pytest.mark.parametrize("ranks", [RANKS, None], ids=["both-ways", "one-way"])
def test_alignment_equals_brute_force(spark, ranks):
    rows = [*brute.odd_rows(), *ODD]
    got = alignment.align(brute.frame(spark, rows), A, B, ranks).collect()
    assert brute.by_key(tuple(r) for r in got) == expected(rows)


def test_many_runs_and_several_levels_of_merging(spark, monkeypatch):
    rows = [(k, text) for k, (_, text) in enumerate(brute.odd_rows() * 4) if len(text or "") < 9000]
    layout = alignment.Layout(50257, 32000)
    rng = np.random.default_rng(1)
    runs = [Counter(rng.choice(rng.integers(0, 1 << 30, 400), 900).tolist()) for _ in range(7)]
    monkeypatch.setattr(alignment, "BLOCK", 16)
    blobs = [alignment.pack(np.array(sorted(r)), np.array([r[x] for x in sorted(r)])) for r in runs]
    parts = list(alignment.with_best(alignment.merge(blobs), layout))
    got = {p: (n, bool(x)) for block in parts for p, n, x in zip(*(c.tolist() for c in block), strict=True)}
    total = sum(runs, Counter())
    most = defaultdict(int)
    for p, n in total.items():
        most[p >> layout.a_bits] = max(most[p >> layout.a_bits], n)
    assert got == {p: (n, n == most[p >> layout.a_bits]) for p, n in total.items()} and [p for b in parts for p in b[0].tolist()] == sorted(total)
    monkeypatch.setattr(alignment, "FAN", 2)  # read on the driver: runs of eight tasks are merged in three levels
    assert brute.by_key(tuple(r) for r in alignment.align(brute.frame(spark, rows).repartition(8), A, B, RANKS).collect()) == expected(rows)


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(brute.frame(spark, []), A, B, RANKS).collect() == []


def test_long_texts_are_cut_where_no_piece_reaches_across():
    text = " ".join(f"word{k % 977}  is\tNr. {k}\n" for k in range(20_000))
    assert len(text) > 3 * alignment.PART_CHARS and alignment.b_ids([text], B)[0] == sides()[1].encode(text)


def test_both_ways_split_every_plain_character_alike():
    letters = [chr(k) for k in range(0x2600) if PLAIN.fullmatch(chr(k))]
    kinds = "aZ9é .,'\n\t\r-_§’s€"
    texts = [f"{x}{c}{y}" for c in letters for x in kinds for y in kinds]
    assert alignment.a_ids(texts, A, RANKS) == alignment.a_ids(texts, A, None)
