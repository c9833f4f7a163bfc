"""Plain-Python versions of what the operators compute, for small tables."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import types as T

BLANK = " \t\n\x0b\x0c\r"
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that operators use inside: they must not get in the way
    + [T.StructField(c, T.StringType()) for c in ("id", "n", "tag", "keys", "rest", "block", "component", "shard", "score", "__id", "slot")]
)


def frame(spark, rows):
    """``rows`` of (doc_id, text), or of (doc_id, text, lang, source)."""
    full = []
    for r in rows:
        doc, text, lang, source = (*r, "en", "web")[:4] if len(r) == 2 else r
        full.append((doc, text, lang, source, None if text is None else len(text), *["x"] * (len(SCHEMA) - 5)))
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    """Nulls, empty and blank texts, ties, repeated rows, one very long text, and near copies."""
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ünïcode", "ñandú", "日本語", "🙂"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    first, passage = prose(120), prose(70)
    words = first.split()
    edited = [*words[:-3], "x", "y", "z"]
    rows = [
        (1, first), (2, first), (3, " ".join(edited)), (4, first.upper()), (5, prose(200)), (5, prose(30)), (6, None), (7, ""),
        (8, " \t\n "), (9, "one two"), (10, "ONE\ttwo"), (11, "one two three"), (None, first), (None, None),
        (12, prose(60) + "\n" + passage + "\n" + prose(60)), (13, passage + "\n" + prose(90)), (14, prose(3) + "\n" + passage),
        (15, prose(30_000)), (16, "same line here\nother\nsame line here\n\n  SAME LINE here \nshort"), (17, "Same Line Here\nshort\nend of it, really"),
        (18, "same line here"), (18, "same line here"), (19, "a" * 5000), (20, "tail \n"), (21, "end of it, really\r\nsecond  blank"), (-4, passage),
        (10**12, "far away words that stand alone"),
    ]
    for k in range(30, 44):
        w = list(words)
        w[k] = f"edit{k}"
        rows.append((k, " ".join(w)))
    return rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text, k=5):
    w = words(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def near_components(rows):
    """Sorted (doc_id, n_shingles, component_id); a null id comes last and is one document."""
    far = float("inf")
    sets = [(far if d is None else d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    full = {d for d, s in sets if s}
    out = [(d, len(s), find(d) if s or d not in full else d) for d, s in sets]
    return sorted((None if d == far else d, n, None if c == far else c) for d, n, c in out if d != far) + [
        (None, n, None if c == far else c) for d, n, c in out if d == far
    ]


def dedup_lines(rows):
    held = defaultdict(set)
    key = lambda x: lower(x.strip(BLANK))
    place = lambda d: float("inf") if d is None else d
    for d, t in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(place(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == place(d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def dedup_spans(rows, window=50):
    place = lambda d: float("inf") if d is None else d
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            first[s] = min(first.get(s, place(d)), place(d))
    out = []
    for d, t in rows:
        w = words(t)
        lost = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < place(d):
                lost.update(range(i, i + window))
        out.append((d, len(w), len(lost), " ".join(x for i, x in enumerate(w) if i not in lost)))
    return out


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(re.sub(r"\D", "", v)) <= 19 and luhn(re.sub(r"\D", "", v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub(r"[^0-9]", "", v)) <= 15),
)


def personal(text):
    """Counts per kind and the base spans as text."""
    spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m[0])] for k, p, ok in PII]
    return [len(s) for s in spans], ",".join(x for s in spans for x in s)


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def by_key(rows):
    return sorted(rows, key=repr)
