"""Document fingerprints: a Merkle tree over sections and paragraphs. Column expressions only.

Lines are sections; a section's paragraphs end at a sentence mark or after some thirty characters at a blank, so a
change stays inside one of them. A paragraph's hash is its MD5, a section's the SHA-256 of its paragraphs'
hashes, the root the SHA-256 of the sections' hashes. The fingerprint is ``root:`` and, per paragraph, the first six
digits of its hash, sections separated by ``/``: roots tell equality, the digits how much two texts have in common and where
they differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.text import let
from corvane.llm.common import NO_ID, id_back, stored

PARAGRAPH = r"[^\n.!?]{0,31}[\n.!? ]|[^\n.!?]{1,32}"
CODE = 6
BLOCK = 256  # ids that are walked in order together
BLOCKS = 1 << 16  # blocks at most, so that the table of their first ids stays small


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, in order; joined they are the text again."""
    return F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0))


def hashes(parts: Column) -> Column:
    """One hash per paragraph, followed by ``/`` where it ends its section."""
    return F.transform(parts, lambda p: F.concat(F.md5(p), F.when(F.endswith(p, F.lit("\n")), "/").otherwise("")))


def root(leaves: Column) -> Column:
    sections = F.split(F.array_join(leaves, ""), "/")
    return F.sha2(F.array_join(F.transform(sections, lambda s: F.sha2(s, 256)), ""), 256)


def codes(leaves: Column) -> Column:
    return F.transform(leaves, lambda h: F.substring(h, 1, CODE))


def fingerprint(leaves: Column) -> Column:
    body = F.transform(leaves, lambda h: F.concat(F.substring(h, 1, CODE), F.when(F.endswith(h, F.lit("/")), "/").otherwise("")))
    return F.concat(root(leaves), F.lit(":"), F.array_join(body, ""))


def fingerprint_codes(print_: Column) -> Column:
    """The paragraph codes inside a fingerprint."""
    return F.regexp_extract_all(F.substring_index(print_, ":", -1), F.lit("[0-9a-f]{6}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """Twice the distinct codes in common by those of both; 1 for two empty texts."""
    sizes = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(sizes == 0, 1.0).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / sizes)


def first_difference(a: Column, b: Column) -> Column:
    """Number (from 1) of the first paragraph that differs; 0 when all are equal."""
    return F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))


def in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text, block, late``: rows dealt into blocks of neighbouring ids, small enough to be walked in order.

    Each block ends with a copy (``late`` = 1) of the first row of the next one, the last block with that of the
    first, so every row finds its successor inside its block.
    """
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ends = rows.where(F.col("id") != NO_ID).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    low, high = float(ends["lo"] or 0), float(ends["hi"] or 0)
    step = max(float(BLOCK), (high - low + 1) / BLOCKS)
    block = F.when(F.col("id") == NO_ID, BLOCKS + 2).otherwise(F.floor((F.col("id").cast("double") - low) / step)).cast("long")
    rows = rows.withColumn("block", block)
    firsts = stored(rows.groupBy("block").agg(F.min("id").alias("first")), "blocks")  # at most BLOCKS + 3 rows
    walk = W.orderBy("block")
    before = F.coalesce(F.lag("block").over(walk), F.max("block").over(W.partitionBy()))
    firsts = F.broadcast(firsts.select(F.col("first").alias("id"), before.alias("before")))
    own = F.struct(F.col("block"), F.lit(0).alias("late"))
    copy = F.struct(F.col("before").alias("block"), F.lit(1).alias("late"))
    dealt = rows.join(firsts, "id", "left").withColumn("place", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    return dealt.select("id", "text", "place.block", "place.late")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edit_start``. The edited text
    has its last ``floor(n_chars / 4)`` code points replaced by the first as many of the next document's text, or by
    all of it; next is by ascending id, after the last comes the first. ``edit_start`` is the code point at which the first
    differing branch starts, null when the roots are equal.

    A null text is empty. Rows that repeat an id follow each other by their texts; a null id comes last. A single
    row is its own successor; an empty table gives an empty one; other columns are not read.
    """
    walk = W.partitionBy("block").orderBy("late", "id", "text")
    rows = in_order(df, id_col, text_col).withColumn("next", F.lead("text").over(walk))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - cut), F.substr(F.coalesce("next", F.lit("")), F.lit(1), cut))
    rows = rows.select("block", "late", "id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("parts", paragraphs(F.col("text"))).withColumn("edited_leaves", hashes(paragraphs(F.col("edited"))))
    rows = rows.withColumn("leaves", hashes(F.col("parts")))
    start = let(
        first_difference(F.col("leaves"), F.col("edited_leaves")),
        lambda k: F.when(k > 0, F.char_length(F.array_join(F.slice(F.col("parts"), F.lit(1), (k - 1).cast("int")), ""))),
    )
    rows = rows.select(
        "block", "late", "id", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("leaves")).alias("fingerprint"), fingerprint(F.col("edited_leaves")).alias("edited_fingerprint"),
        codes(F.col("leaves")).alias("codes"), codes(F.col("edited_leaves")).alias("edited_codes"), start.cast("long").alias("edit_start"),
    )
    rows = rows.withColumn("next_codes", F.lead("codes").over(walk)).where("late = 0")
    return rows.select(
        id_back("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"),
        likeness(F.col("codes"), F.coalesce("next_codes", "codes")).alias("near_next"), "edit_start",
    )
