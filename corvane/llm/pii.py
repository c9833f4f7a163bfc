"""Personal data: fixed patterns as seeds, then bootstrapped contextual extraction. Column expressions only.

Seeds are the matches of fixed patterns. A lexical pattern is the shape of an identifier with the word before it, or with
any; a context is the word before or behind alone, and its instances are segments of any shape. Patterns and instances score
each other: a pattern by the share of its instances that are known, an instance by the patterns it occurs in. Instances of
good patterns are personal data too; shapes find them where a fixed pattern fails, as in a run of numbers, and contexts
find forms that no seed has, as far as a loose check of the kind allows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.rows import fan_out, offsets
from corvane.functions.text import let
from corvane.llm.common import NO_ID, fresh, id_back, stored

# Fixed values. The added look-arounds only spare starts that cannot match: a run is tried at its first
# character, or where the match before it ended. Possessive repeats keep long runs linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINTS = {
    "email": r"@", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]",
}
KINDS = tuple(PATTERNS)
SPELT_AT = r"(?:\x20at\x20|\x20?[\[(](?:at|@)[\])]\x20?)"
SPELT_DOT = r"(?:\x20dot\x20|\x20?[\[(](?:dot|\.)[\])]\x20?)"
NAME = r"[a-z0-9_%+-]++"
SPELT = (  # an email with its signs in words or brackets
    rf"{NAME}(?:(?:{SPELT_DOT}|\.){NAME})*+(?:(?:{SPELT_AT}|@){NAME}(?:{SPELT_DOT}{NAME})++"
    rf"|\x20?[\[(](?:at|@)[\])]\x20?{NAME}(?:(?:{SPELT_DOT}|\.){NAME})++)"
)
GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{0,4}){2,7}"
NUMBER = rf"[+(]{{0,2}}[0-9]++(?:(?:{SPELT_DOT}|\x20?\(|\)\x20?[/-]?\x20?|\x20[/-]\x20|[\x20./-])[0-9]++)*+"
# Segments: whatever may be an identifier in some form, each number or address in the text being one.
LOOSE = rf"(?i)(?<![\p{{L}}0-9._%+-])(?:[a-z0-9._%+-]++@[a-z0-9-]++(?:\.[a-z0-9-]++)++(?!{SPELT_DOT})|{SPELT}|{GROUPS}|{NUMBER})(?![\p{{L}}0-9])"
# no kind is without one of these
ANY = r"[0-9@]|(?i:[\[(]at[\])]|\x20at\x20[^\x20]++[\x20\[(]++dot[\x20\])])"
TOKEN = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
# Blanks and lone punctuation between tokens belong to the token before them, so an identifier has at most as many tokens as digits.
BETWEEN = r"(?:\x20++[().-]++(?=\x20))*+\x20++"
RUN = rf"(?<![^\x20\x09-\x0D]){TOKEN}(?:{BETWEEN}{TOKEN})*+"
PIECE = rf"{TOKEN}(?:{BETWEEN})?+"
ROUNDS = 3
GOOD = 0.8  # least score of a pattern that is followed, and of an instance that is taken
SUPPORT = 5  # known instances that a pattern needs
FEW = 20_000  # rows up to which a table of patterns is broadcast


def matches(text: Column, pattern: str) -> Column:
    """``start, end, value, gap, next`` of the leftmost matches, in code points; ``gap`` is the text since the one before, ``next`` that to the one after."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(hits: Column) -> Column:
        around = let(gaps, lambda g: F.zip_with(g, F.slice(g, F.lit(2), F.size(hits)), lambda x, y: F.struct(x.alias("g"), y.alias("h"))))
        pairs = F.zip_with(hits, F.slice(around, F.lit(1), F.size(hits)), lambda m, g: F.struct(m.alias("m"), g["g"].alias("g"), g["h"].alias("h")))
        return let(pairs, lambda p: F.zip_with(
            p, offsets(F.transform(p, lambda x: F.char_length(x["m"]) + F.char_length(x["g"]))),
            lambda x, at: F.struct(
                (at + F.char_length(x["g"])).alias("start"), (at + F.char_length(x["g"]) + F.char_length(x["m"])).alias("end"),
                x["m"].alias("value"), x["g"].alias("gap"), x["h"].alias("next"),
            ),
        ))

    kind = "array<struct<start:int,end:int,value:string,gap:string,next:string>>"
    return F.when(F.regexp_like(text, F.lit(pattern)), let(found, placed)).otherwise(F.array().cast(kind))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """What a match must pass besides its pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return F.regexp_like(value, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    size = F.length(digits(value))
    if kind == "phone":
        return size.between(9, 15)
    return size.between(13, 19) & luhn(digits(value))


def loose(kind: str, value: Column) -> Column:
    """What an instance must pass: the fixed pattern, or another form that can be of the kind."""
    whole = F.regexp_like(value, F.lit(f"^(?:{PATTERNS[kind]})$")) & valid(kind, value)
    if kind == "email":
        return whole | F.regexp_like(value, F.lit(rf"(?i)^(?:{SPELT})$"))
    if kind == "ip":
        part = r"(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        four = F.regexp_like(value, F.lit(rf"(?i)^{part}(?:(?:{SPELT_DOT}|[.-]){part}){{3}}$"))
        return whole | four | F.regexp_like(value, F.lit(rf"(?i)^(?=.*::|(?:[^:]+:){{7}}[^:]+$)(?!.*::.*::){GROUPS}$"))
    number = F.regexp_like(value, F.lit(rf"^{'[+(]{0,2}' if kind == 'phone' else ''}[0-9][0-9\x20()./-]*+$"))
    return whole | (number & valid(kind, value))


def of_kind(check) -> Column:
    """``check(kind, value)`` for the kind of the row."""
    fits = F.lit(False)
    for kind in KINDS:
        fits = F.when(F.col("kind") == kind, check(kind, F.col("value"))).otherwise(fits)
    return fits


def luhn(number: Column) -> Column:
    """Every second digit from the right doubled, its digits summed; the total must end in 0."""
    each = F.transform(F.split(F.reverse(F.substring(number, 1, 19)), ""), lambda d: d.try_cast("int"))
    each = F.filter(each, lambda d: d.isNotNull())
    sums = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(sums, F.lit(0), lambda a, x: a + x) % 10 == 0


def base(text: Column, kind: str) -> Column:
    """``start, end, value`` of the kind's matches that are valid."""
    kept = F.filter(matches(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
    bare = F.transform(kept, lambda s: F.struct(s["start"], s["end"], s["value"]))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(F.regexp_like(text, F.lit(HINTS[kind])), bare).otherwise(none)


def shape(value: Column) -> Column:
    """Letters become ``a``, short, middle and card-long numbers ``d``, ``M`` and ``L``; the rest stays."""
    for pattern, sign in ((r"\p{L}+", "a"), (r"[0-9]{20,}", "X"), (r"[0-9]{13,19}", "L"), (r"[0-9]{5,12}", "M"), (r"[0-9]+", "d")):
        value = F.regexp_replace(value, pattern, sign)
    return value


def small(df: DataFrame) -> DataFrame:
    """A written table, broadcast only while it is small."""
    table = stored(df, "patterns")
    return F.broadcast(table) if table.count() <= FEW else table


def scanned(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, tag``, one array of base spans per kind, ``runs`` of tokens that may hold an identifier, and ``segments``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"))
    t = F.col("text")
    some = F.regexp_like(t, F.lit(ANY))
    runs = F.transform(
        matches(t, RUN),
        lambda s: F.struct(
            s["start"].alias("start"), s["value"].alias("value"),
            F.lower(F.substring_index(F.rtrim(F.substring(s["gap"], -64, 64)), " ", -1)).alias("left"),
        ),
    )
    none = F.array().cast("array<struct<start:int,value:string,left:string>>")
    segments = F.transform(
        matches(t, LOOSE),
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.lower(F.regexp_extract(F.substring(s["gap"], -64, 64), r"(\p{L}++)\P{L}*+$", 1)).alias("left"),
            F.lower(F.regexp_extract(F.substring(s["next"], 1, 64), r"^\P{L}*+(\p{L}++)", 1)).alias("right"),
        ),
    )
    empty = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    return stored(
        rows.select(
            "id", F.xxhash64("text").alias("tag"), *[base(t, k).alias(k) for k in KINDS], F.when(some, runs).otherwise(none).alias("runs"),
            F.when(some, segments).otherwise(empty).alias("segments"),
        ), "scanned",
    )


def in_context(scan: DataFrame) -> DataFrame:
    """``id, tag, start, end, value, left, right``: the segments that are a base span or touch none."""
    other = lambda s, b: overlaps(s, b) & ((s["start"] != b["start"]) | (s["end"] != b["end"]))
    free = scan.select("id", "tag", apart(F.col("segments"), [F.col(k) for k in KINDS], other).alias("segments"))
    return free.select("id", "tag", F.explode("segments").alias("s")).select("id", "tag", "s.*")


def pieces(value: Column) -> Column:
    """The tokens of a run, each with the blanks and lone punctuation behind it."""
    return F.regexp_extract_all(value, F.lit(PIECE), F.lit(0))


def candidates(scan: DataFrame, widths: list[int]) -> DataFrame:
    """``id, tag, start, end, value, shape, left``: as many tokens of a run as one of ``widths``, without outer punctuation."""
    runs = scan.select("id", "tag", F.explode("runs").alias("run")).select("id", "tag", "run.*")

    def cut(tokens: Column) -> Column:
        """The windows of all widths; a row of its own gets each window, never the array that it is cut from."""

        def of_width(at: Column, many: int) -> Column:
            places = F.when(F.size(tokens) >= many, F.sequence(F.lit(0), F.size(tokens) - many)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda i: F.struct(
                (F.col("start") + F.get(at, i)).alias("start"), F.array_join(F.slice(tokens, i + 1, F.lit(many)), "").alias("raw"),
                F.when(i == 0, F.col("left")).otherwise(F.lower(F.rtrim(F.get(tokens, i - 1)))).alias("left"),
            ))

        return let(offsets(F.transform(tokens, lambda t: F.char_length(t))), lambda at: F.concat(*[of_width(at, k) for k in widths]))

    if not widths:
        nothing = F.array().cast("array<struct<start:int,raw:string,left:string>>")
        token = runs.select("id", "tag", F.inline(nothing))
    else:
        windows = runs.select("id", "tag", "start", "left", let(pieces(F.col("value")), cut).alias("windows"))
        token = fan_out(windows, ["id", "tag"], F.col("windows"), "w").select("id", "tag", "w.*")
    bare = F.regexp_replace(F.col("raw"), r"^[^\p{L}0-9+(]++", "")
    token = token.withColumn("start", F.col("start") + F.char_length("raw") - F.char_length(bare))
    token = token.withColumn("value", F.regexp_replace(bare, r"[^\p{L}0-9)]++$", "")).where(F.char_length("value") >= 6)
    return token.select("id", "tag", "start", (F.col("start") + F.char_length("value")).alias("end"), "value", shape(F.col("value")).alias("shape"), "left")


def seeded(scan: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """Seeds ``kind, value``, their shapes ``kind, shape, n`` and the numbers of tokens that these have.

    A card has at most 19 digits and a phone 15, so there are never more than 19 widths.
    """
    values = lambda k: F.transform(F.col(k), lambda s: F.struct(F.lit(k).alias("kind"), s["value"].alias("value")))
    spans = F.concat(*map(values, KINDS))
    seeds = stored(scan.select(F.explode(spans).alias("s")).select("s.*").distinct(), "seeds")
    shapes = seeds.groupBy("kind", shape(F.col("value")).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(pieces(F.col("value")))).alias("width"))
    shapes = small(shapes.where(F.col("n") >= SUPPORT))
    widths = sorted(r["width"] for r in shapes.select("width").distinct().collect())
    return seeds, shapes.drop("width"), widths


def bootstrap(seeds: DataFrame, shapes: DataFrame, windows: DataFrame, segments: DataFrame) -> DataFrame:
    """``kind, value``: identifiers that good patterns find among windows and segments, with the seeds among them."""
    # each instance once under each pattern, however often it occurs: a frequent one weighs no more
    graph = windows.join(shapes, "shape").select("kind", "value", "shape", "left")
    graph = graph.where(of_kind(valid)).distinct()  # windows that cut a number in two say nothing about a shape
    graph = graph.select("kind", "value", F.explode(F.array(
        F.struct("shape", F.lit(None).cast("string").alias("left")), F.struct("shape", "left"),
    )).alias("p")).select("kind", "value", F.concat_ws("\u0001", "p.shape", "p.left").alias("pattern")).distinct()
    # a word tells nothing of a kind if it stands by other numbers as well, so all of them count, whatever they are
    words = F.array(F.struct(F.lit("before").alias("side"), F.col("left").alias("word")), F.struct(F.lit("behind").alias("side"), F.col("right").alias("word")))
    near = segments.select("value", F.explode(words).alias("p")).where("p.word <> ''")
    near = near.select("value", F.concat_ws("\u0001", F.lit(""), "p.side", "p.word").alias("pattern")).distinct()
    near = near.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in KINDS])))
    graph = graph.withColumn("fit", F.lit(True)).unionByName(near.withColumn("fit", of_kind(loose)))
    graph = stored(graph, "graph")
    known = seeds.withColumn("score", F.lit(1.0))
    for _ in range(ROUNDS):
        scored = graph.join(known, ["kind", "value"], "left").fillna(0.0, ["score"])
        good = scored.groupBy("kind", "pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("trust"), F.sum((F.col("score") > 0).cast("int")).alias("support")
        ).where((F.col("trust") >= GOOD) & (F.col("support") >= SUPPORT))
        doubt = F.sum(F.log(F.lit(1.0) - F.least("trust", F.lit(0.99))))
        found = graph.where("fit").join(small(good), ["kind", "pattern"]).groupBy("kind", "value").agg((F.lit(1.0) - F.exp(doubt)).alias("found"))
        known = stored(
            found.join(seeds.withColumn("seed", F.lit(1.0)), ["kind", "value"], "full").select(
                "kind", "value", F.coalesce("seed", "found").alias("score")
            ), "known",
        )
    return known.where(F.col("score") >= GOOD).select("kind", "value")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def apart(spans: Column, others: list[Column], meets: Callable[[Column, Column], Column]) -> Column:
    """The ``spans`` that ``meets`` none of ``others``, each of which is in order and without overlaps.

    Each of the others is cut into blocks of about the square root of its size. A span looks at the bounds of the
    blocks, and inside those it overlaps.
    """

    def blocks(of: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(of))).cast("int"))
        cut = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(of) / w).cast("int") - 1), lambda b: F.slice(of, b * w + 1, w)))
        bounded = F.transform(cut, lambda c: F.struct(F.get(c, F.lit(0))["start"].alias("start"), F.element_at(c, -1)["end"].alias("end"), c.alias("held")))
        return F.when(F.size(of) > 0, bounded)

    def free(of: Column) -> Callable[[Column], Column]:
        bare = F.transform(of, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

        def kept(left: Column) -> Column:
            met = lambda bs, s: F.exists(bs, lambda b: overlaps(s, b) & F.exists(b["held"], lambda o: meets(s, o)))
            return F.when((F.size(of) > 0) & (F.size(left) > 0), let(blocks(bare), lambda bs: F.filter(left, lambda s: ~met(bs, s)))).otherwise(left)

        return kept

    for of in others:
        spans = let(spans, free(of))
    return spans


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, tag``, base spans per kind and ``spans``, all spans of a row by kind, then start. ``tag`` is a hash of the text.

    A found instance becomes a span where it can be of its kind (``loose``) and touches no base span; of found ones that
    overlap the earliest stays, of those the longest.
    """
    scan = scanned(df, id_col, text_col)
    # a value that a good pattern holds is looked up where it occurs; frequent values are split by the adaptive skew join
    seeds, shapes, widths = seeded(scan)
    windows = candidates(scan, widths)
    segments = in_context(scan)
    places = windows.select("id", "tag", "start", "end", "value").unionByName(segments.select("id", "tag", "start", "end", "value"))
    hits = places.join(bootstrap(seeds, shapes, windows, segments), "value")
    extra = hits.where(of_kind(loose)).groupBy("id", "tag").agg(
        F.sort_array(F.collect_set(F.struct("start", (-F.col("end")).alias("far"), "kind"))).alias("hits")
    )
    rows = scan.drop("runs", "segments").join(extra, ["id", "tag"], "left")
    of = lambda k: F.transform(F.col(k), lambda s: F.struct(F.lit(KINDS.index(k)).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    number = lambda c: sum(F.when(c == k, i).otherwise(0) for i, k in enumerate(KINDS))
    more = F.transform(F.coalesce("hits", F.array().cast("array<struct<start:int,far:int,kind:string>>")), lambda h: F.struct(
        number(h["kind"]).alias("kind"), h["start"].alias("start"), (-h["far"]).alias("end"),
    ))
    rows = rows.withColumn("base", F.concat(*[of(k) for k in KINDS])).withColumn("more", more)
    free = apart(F.col("more"), [F.col(k) for k in KINDS], overlaps)
    kind = "array<struct<kind:int,start:int,end:int>>"
    taken = F.aggregate(
        free, F.array().cast(kind),
        lambda got, m: F.when(F.coalesce(F.element_at(F.when(F.size(got) > 0, got), -1)["end"], F.lit(0)) <= m["start"], F.array_append(got, m)).otherwise(got),
    )
    return rows.withColumn("found", F.when(F.size("more") > 0, taken).otherwise(F.array().cast(kind))).withColumn(
        "spans", F.sort_array(F.concat("base", "found"))
    )


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    name = lambda s: F.get(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``: counts and hash of base spans, and all spans.

    A null text is empty and has no spans. Repeated rows are reported as often as they occur; a null id stays null; an empty
    table gives an empty one; other columns are not read.
    """
    found = find(df, id_col, text_col)
    return found.select(
        id_back("id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span of its text replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``; overlapping spans become one.

    Texts without a digit, an at sign or such a sign in words cannot hold a span and are passed on without a shuffle.
    """
    text = F.col(text_col).cast("string")
    some = F.coalesce(F.regexp_like(text, F.lit(ANY)), F.lit(False))
    name = fresh(df, "found")
    found = find(df.where(some), id_col, text_col).where(F.size("spans") > 0).select("id", "tag", "spans").distinct()
    found, at = found.select(F.struct("id", "tag", "spans").alias(name)), F.col(name)
    keys = (F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == at["id"]) & (F.xxhash64(text) == at["tag"])
    hit = df.where(some).join(found, keys, "left")
    by_start = F.sort_array(F.transform(at["spans"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    sign = lambda s: F.get(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["kind"])
    done = F.aggregate(
        by_start, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(acc["out"], F.array(F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), sign(s))).alias("out"),
            )
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1)),
    )
    changed = F.when(at.isNull(), text).otherwise(done)
    kept = [changed.alias(c) if c == text_col else F.col(c) for c in df.columns]
    return hit.select(*kept).unionByName(df.where(~some))
