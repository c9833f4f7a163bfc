import random
import re
import time

import brute
import pytest
from pyspark.sql import functions as F

from corvane.functions.rows import offsets
from corvane.llm import pii
from corvane.llm.merkle import fingerprint_codes, fingerprints, likeness, paragraphs

ROWS = brute.odd_rows()


def ordered(rows):
    """By id, a null one last, equal ids by text; each with its edited text."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1].encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        nxt, cut = rows[(i + 1) % len(rows)][1], len(t) // 4
        out.append((d, t, t[: len(t) - cut] + nxt[:cut], nxt))
    return out


def test_fingerprints(spark):
    got = fingerprints(brute.frame(spark, ROWS)).collect()
    want = [(d, len(t), brute.sha(e)) for d, t, e, _ in ordered(ROWS)]
    assert brute.by_key((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == brute.by_key(want)
    prints = {}
    for r in got:
        prints.setdefault((r["doc_id"], r["n_chars"]), r)
    same = [r["fingerprint"] for r in got if r["doc_id"] in (1, 2)]
    assert same[0] == same[1] != prints[3, len(dict(ROWS)[3])]["fingerprint"]
    texts = {t for _, t, _, _ in ordered(ROWS)}
    assert len({r["fingerprint"] for r in got}) == len(texts)
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["edit_start"] is None) == (r["fingerprint"] == r["edited_fingerprint"])
    long = prints[15, len(dict(ROWS)[15])]
    assert 0.65 < long["near_edited"] < 0.9 and long["near_next"] < 0.05
    assert long["n_chars"] * 3 // 4 - 64 < long["edit_start"] <= long["n_chars"] * 3 // 4


def test_paragraphs_join_to_the_text_and_codes_come_back(spark):
    df = brute.frame(spark, ROWS).where("text is not null")
    parts = df.select("text", F.array_join(paragraphs(F.col("text")), "").alias("again")).collect()
    assert all(r["text"] == r["again"] for r in parts)
    out = fingerprints(df).select(likeness(fingerprint_codes(F.col("fingerprint")), fingerprint_codes(F.col("edited_fingerprint"))).alias("x"), "near_edited")
    assert all(r["x"] == r["near_edited"] for r in out.collect())


@pytest.mark.parametrize("rows", [[], [(5, "alone. It has no other next")], [(None, None)]])
def test_few_rows(spark, rows):
    got = fingerprints(brute.frame(spark, rows)).collect()
    assert [(r["doc_id"], r["edited_sha256"]) for r in got] == [(d, brute.sha(e)) for d, _, e, _ in ordered(rows)]


def test_many_ids_far_apart(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(-(10**15), 10**15) if k % 2 else k, f"text number {k} " * 3) for k in range(1500)]
    got = fingerprints(brute.frame(spark, rows)).collect()
    assert {(r["doc_id"], r["edited_sha256"]) for r in got} == {(d, brute.sha(e)) for d, _, e, _ in ordered(rows)}


def card(rng):
    head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(head + d for d in "0123456789" if brute.luhn(head + d))


def private_rows():
    rng = random.Random(5)
    rows = [*ROWS]
    for k in range(99):
        phone = f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
        one = [f"mail me{k}.x@mail{k}.example.com now", f"card {card(rng)}, thanks", f"from {k}.{k + 3}.22.{k * 2} to", f"call {phone} soon"][k % 4]
        rows.append((300 + k, f"some words 🙂 before\n{one} and\tafter it"))
    rows += [
        (200, f"two {card(rng)} {card(rng)} in a row"), (201, f"ring +1 (523) 555-1055 {card(rng)} or not"),
        (202, "1.2.3.4.5 and 300.1.1.1 and 999.1.1.1.1.1"), (203, "a@b.c%d@e.f g@h..i @x.y j@k j@k.l."), (204, "+12345 +1234567890123456 ++1 234 567 890"),
        (205, "1234567890123456 not a card, version 2.0, 4.0"), (206, " ".join(["12"] * 3000)), (207, "9" * 4000 + " a" * 10), (208, "x" * 3000 + "@" + "y" * 3000 + ".z"),
        (209, "12-34 56-78 90-12 34-56"), (210, None), (300, "again me@x.example.com"),
    ]
    return rows


def test_base_spans_equal_brute_force(spark):
    rows = private_rows()
    got = pii.report(brute.frame(spark, rows)).collect()
    want = []
    for d, t in rows:
        n, spans = brute.personal(t)
        want.append((d, *n, brute.sha(spans)))
    assert brute.by_key(tuple(r)[:6] for r in got) == brute.by_key(want)
    for r in got:  # base spans stay among all spans
        text = [t for d, t in rows if d == r["doc_id"]]
        assert any({x for x in brute.personal(t)[1].split(",") if x} <= set(r["spans"].split(",")) for t in text)


def test_patterns_find_what_runs_of_numbers_hide(spark):
    rows = private_rows()
    texts = dict(rows)
    got = {r["doc_id"]: r["spans"] for r in pii.report(brute.frame(spark, rows)).collect()}
    values = lambda d: [texts[d][int(s) : int(e)] for _, s, e in (x.split(":") for x in got[d].split(",") if x)]
    assert values(200) == texts[200].split()[1:3]
    assert texts[201][5:22] in values(201) and texts[201].split()[4] in values(201)
    assert got[205] == got[206] == got[207] == "" and got[1] == ""


def test_long_identifiers_in_runs_of_numbers(spark):
    rng = random.Random(8)
    grouped = lambda c: " ".join(c[i : i + 4] for i in range(0, 16, 4))
    phone = lambda: f"+1 {rng.randrange(200, 999)} 555 {rng.randrange(1000, 9999)}"
    spaced = lambda: f"+44 ( {rng.randrange(20, 99)} )  {rng.randrange(1000, 9999)} - {rng.randrange(1000, 9999)}"
    rows = [(k, f"pay with {grouped(card(rng))} today or {phone()} tomorrow, {spaced()} later") for k in range(40)]
    hidden, called, wide = grouped(card(rng)), phone(), spaced()
    while any(brute.luhn(x.replace(" ", "")) for x in (f"7 {hidden}", f"7 {hidden}"[:-5])):
        hidden = grouped(card(rng))
    rows += [(100, f"ref 7 {hidden} and more"), (101, f"ref {called} 20 30 40 and more"), (102, f"ref {wide} 20 30 40 and more"), (103, "12 34 56 78 90 12 34 56")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(brute.frame(spark, rows)).collect()}
    assert got[100] == "ref 7 [CARD] and more"
    assert got[101] == got[102] == "ref [PHONE] 20 30 40 and more"
    assert got[103] == rows[-1][1]


def test_contexts_find_forms_that_no_seed_has(spark):
    rng = random.Random(9)
    rows = []
    for k in range(40):
        number = rng.randrange(10**8, 10**9)
        rows += [
            (4 * k, f"please call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} soon and order {number} apples"),
            (4 * k + 1, f"just mail me{k}@mail{k}.example.com now or buy {number + 1} pears"), (4 * k + 2, f"came from 10.{k}.22.7 to room {k}"),
            (4 * k + 3, f"paid with card {card(rng)} for {number + 2} plums"),
        ]
    spaced = " - ".join(re.findall("....", card(rng)))
    planted = [
        (500, "please call (030) 123456 today", "please call [PHONE] today"), (501, "phone call: 0170-1234567, thanks", "phone call: [PHONE], thanks"),
        (502, "just mail name at host dot org instead", "just mail [EMAIL] instead"), (503, "came from 10[.]0[.]0[.]77 again", "came from [IP] again"),
        (504, f"paid with card {spaced} twice", "paid with card [CARD] twice"),
        (600, "please call 12 times", None), (601, "order 201234567 apples and 030 123456 pears", None), (602, "look at 12 dot 5 and at host dot org", None),
        (603, "paid with card 1234 - 5678 - 9012 - 3456 twice", None), (604, "since 2024-05-06 and 0170 1234567 apples", None),
    ]
    got = {r["doc_id"]: r["text"] for r in pii.redact(brute.frame(spark, rows + [r[:2] for r in planted])).collect()}
    assert [got[d] for d, _, _ in planted] == [want or text for _, text, want in planted]
    assert all(str(n) in got[d] for d, t in rows for n in re.findall(r"\b[0-9]{9}\b", t))


def test_redaction(spark):
    rows = private_rows()
    df = brute.frame(spark, rows)
    out = pii.redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    texts = dict(rows)
    assert got[301] == re.sub(r"[0-9]{16}", "[CARD]", texts[301])
    assert got[200] == "two [CARD] [CARD] in a row" and got[201] == "ring [PHONE] [CARD] or not"
    assert got[210] is None and got[1] == texts[1] and got[15] == texts[15]
    assert pii.redact(brute.frame(spark, [])).collect() == [] == pii.report(brute.frame(spark, [])).collect()


def test_offsets(spark):
    for n in (0, 1, 2, 5, 37, 100):
        lengths = list(range(3, n + 3))
        r = spark.createDataFrame([(lengths,)], "a array<int>").select(offsets(F.col("a")).alias("o")).first()
        assert r["o"] == [sum(lengths[:i]) for i in range(n)]


def timed(spark, text):
    rows = [(1, text), (2, "plain words"), *((k, f"mail me{k}@host.org or call +49 170 12345{k:02d} please") for k in range(10, 50))]
    pii.find(brute.frame(spark, rows[1:])).collect()  # compiles
    began = time.monotonic()
    got = {r["doc_id"]: r for r in pii.report(brute.frame(spark, rows)).collect()}
    return got, time.monotonic() - began


def test_many_addresses_in_one_text(spark):
    text = " ".join(f"name{k}@host{k % 97}.example.org" for k in range(20_000))
    got, took = timed(spark, text)
    assert got[1]["n_email"] == 20_000 and got[1]["base_sha256"] == brute.sha(brute.personal(text)[1]) and took < 60


def test_many_numbers_in_one_text(spark):
    text = ", ".join(str(k % 90 + 10) for k in range(100_000))
    got, took = timed(spark, text)
    assert got[1]["n_phone"] == 0 and got[1]["base_sha256"] == brute.sha(brute.personal(text)[1]) and took < 60
