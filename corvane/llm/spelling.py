"""Groups of spelling variants: words one edit apart, found by walking a trie as a relational frontier."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import map_batches, map_partitions, mix64, stored, texts
from corvane.llm.shingles import INVERSE, powers

# One run of letters in UTF-8: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
SLIP = 97  # one run in so many loses a letter
LEAST_CHARS, LEAST_COUNT = 5, 3
LEVELS = 64  # words of more code points are matched by their shortened forms instead of level by level
ENTRIES = 200_000  # words that a task counts before it hands them on


def slipped(run: bytes, crc: int) -> bytes:
    """``run`` without the code point that the checksum names, where it names one."""
    if crc % SLIP:
        return run
    letters = run.decode()
    at = crc % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def vocabulary(df: DataFrame, id_col: str, text_col: str, least_chars: int, least_count: int) -> DataFrame:
    """``word, n`` for the words of all whole texts; counts are added up in the task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(held.keys(), type=pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), type=pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(LETTERS.findall(text.lower())).items():
                    crc = zlib.crc32(word, start)
                    held[word if crc % SLIP else slipped(word, crc)] += n
                if len(held) > ENTRIES:
                    yield out()
                    held.clear()
        yield out()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = map_partitions(rows, run, "word string, n long").where(F.char_length("word") >= least_chars)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def node_of(reverse: Column, letters: Column) -> Column:
    """A trie node is the hash of the letters that lead to it; the two tries have nodes of their own."""
    return F.xxhash64(reverse, letters)


def letter(place: Column) -> Column:
    return F.substr(F.col("walk"), place + 1, F.lit(1))


def oriented(words: DataFrame) -> DataFrame:
    """``walk, reverse, size``: every word forwards and backwards."""
    ways = F.array(F.struct(F.lit(False).alias("reverse"), F.col("word").alias("walk")), F.struct(F.lit(True).alias("reverse"), F.reverse("word").alias("walk")))
    return words.select(F.inline(ways), F.char_length("word").alias("size"))


def edge_table(walks: DataFrame) -> DataFrame:
    """``depth, node, step, child, others``: an edge per node and letter; ``others`` are the node's children by later letters.

    A walk first may differ in the second half of a word, so only edges from there on are built. A node has at
    most one edge per letter of the alphabet.
    """
    half = F.floor(F.col("size") / 2).cast("int")
    steps = walks.select("walk", "reverse", F.explode(F.sequence(half, F.col("size") - 1)).alias("depth")).select(
        "depth", node_of(F.col("reverse"), F.substr(F.col("walk"), F.lit(1), F.col("depth"))).alias("node"),
        F.struct(letter(F.col("depth")).alias("step"), node_of(F.col("reverse"), F.substr(F.col("walk"), F.lit(1), F.col("depth") + 1)).alias("child")).alias("edge"),
    )
    fans = steps.groupBy("depth", "node").agg(F.array_sort(F.collect_set("edge")).alias("fan"))
    each = fans.select("depth", "node", "fan", F.posexplode("fan").alias("at", "edge"))
    later = F.slice(F.col("fan.child"), F.col("at") + 2, F.size("fan"))
    return each.select("depth", "node", F.col("edge.step").alias("step"), F.col("edge.child").alias("child"), later.alias("others"))


def frontier(words: DataFrame) -> DataFrame:
    """``walk, reverse, node``: words that reach ``node`` with one letter replaced by a later one, or left out.

    A state is a word, the place in it, a trie node and the edits so far. The round of depth d joins the states at
    nodes of that depth with the edges that leave them: the same letter goes on without an edit, a later letter with one
    edit, and leaving out the letter stays at the node. Edits in the second half of a word are found from its first half
    forwards, those in the first half from its second half backwards; so no state is made where the trie fans out most.
    The other directions (an earlier letter, a letter put in) are the same pairs seen from the other word.
    """
    walks = oriented(words)
    # after half a word, rounded down forwards and up backwards
    start = F.when(F.col("reverse"), F.ceil(F.col("size") / 2)).otherwise(F.floor(F.col("size") / 2)).cast("int")
    begun = stored(walks.withColumn("place", start).withColumn("node", node_of(F.col("reverse"), F.substr(F.col("walk"), F.lit(1), F.col("place")))), "walks")
    edges = stored(edge_table(walks), "edges")
    span = begun.agg(F.min("place").alias("first"), F.max("size").alias("last")).first()
    # a word without its last letter needs no walk
    cut = F.substr(F.col("walk"), F.lit(1), F.col("size") - 1)
    ends = walks.select("walk", "reverse", node_of(F.col("reverse"), cut).alias("node"))
    if span["first"] is None:
        return ends
    states = None
    for depth in range(span["first"], span["last"]):
        fresh = begun.where(F.col("place") == depth).select("walk", "reverse", "size", "place", "node", F.lit(0).alias("edits"))
        states = fresh if states is None else states.where("place < size").unionByName(fresh)
        here = letter(F.col("place"))
        skip = (F.col("edits") == 0) & (F.col("place") + 1 < F.col("size")) & (here != letter(F.col("place") + 1))
        ways = F.array_compact(F.array(
            F.struct("place", "edits"), F.when(skip, F.struct((F.col("place") + 1).alias("place"), F.lit(1).alias("edits"))),
        ))
        asked = states.select("walk", "reverse", "size", "node", F.inline(ways)).withColumn("step", letter(F.col("place")))
        met = asked.join(edges.where(F.col("depth") == depth).drop("depth"), ["node", "step"])
        same = F.array(F.struct(F.col("child").alias("node"), F.col("edits").alias("edits")))
        other = F.when(F.col("edits") == 0, F.transform("others", lambda x: F.struct(x.alias("node"), F.lit(1).alias("edits"))))
        nexts = F.concat(same, F.coalesce(other, F.array().cast("array<struct<node:bigint,edits:int>>")))
        moved = met.select("walk", "reverse", "size", (F.col("place") + 1).alias("place"), F.inline(nexts))
        states = stored(moved.select("walk", "reverse", "size", "place", "node", "edits").where("place < size or edits = 1"), "frontier")
        ends = ends.union(states.where("place = size and edits = 1").select("walk", "reverse", "node"))
    return ends


def short_pairs(words: DataFrame) -> DataFrame:
    """``a, b``: pairs of words one edit apart, each pair at least once, of words of ``LEVELS`` code points at most."""
    some = words.where(F.char_length("word") <= LEVELS).select("word")
    goals = oriented(some).select("reverse", node_of(F.col("reverse"), F.col("walk")).alias("node"), F.col("walk").alias("goal"))
    met = frontier(some).join(goals, ["reverse", "node"]).where(F.levenshtein("walk", "goal", 1) == 1)  # nodes are hashes
    turn = lambda c: F.when(F.col("reverse"), F.reverse(c)).otherwise(F.col(c))
    return met.select(turn("walk").alias("a"), turn("goal").alias("b"))


def long_pairs(words: DataFrame) -> DataFrame:
    """``a, b`` likewise, of the words that are longer: equal when one letter of one or of both is left out.

    A word has one shortened form per place, each known by a hash in constant time; at most as many words as the
    alphabet has letters share a form and its place.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for word in batch.column(0).to_pylist():
            codes = mix64(np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64) + np.uint64(1))
            n = len(codes)
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * powers(n)[0], dtype=np.uint64)])
            forms = np.concatenate([sums[-1:], sums[:-1] + (sums[-1] - sums[1:]) * INVERSE]).view(np.int64)
            # place -1 is the whole word; a shorter word has no shortened forms here
            forms = forms if n > LEVELS else forms[:1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([hash_of(word)] * len(forms), pa.int64()), pa.array(np.arange(-1, len(forms) - 1, dtype=np.int32)), pa.array(forms), pa.array([n] * len(forms), pa.int32())],
                ["key", "place", "form", "size"],
            )

    def hash_of(word: str) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(word) - (1 << 63)

    some = words.where(F.char_length("word") >= LEVELS).select("word")
    forms = stored(map_batches(some, run, "key long, place int, form long, size int"), "forms")
    named = map_batches(some, lambda batch: iter([pa.RecordBatch.from_arrays([pa.array([hash_of(w) for w in batch.column(0).to_pylist()], pa.int64()), batch.column(0)], ["key", "word"])]), "key long, word string")
    named = stored(named, "long-words")
    less = forms.where("place >= 0")
    whole = forms.where("place = -1").select(F.col("key").alias("b"), "form", (F.col("size") + 1).alias("size"))
    swapped = less.select(F.col("key").alias("a"), "place", "form", "size").join(less.select(F.col("key").alias("b"), "place", "form", "size"), ["form", "place", "size"]).where("a < b")
    pairs = swapped.select("a", "b").union(less.select(F.col("key").alias("a"), "form", "size").join(whole, ["form", "size"]).select("a", "b")).distinct()
    texts_of = [named.select(F.col("key").alias(c), F.col("word").alias(f"{c}_word")) for c in "ab"]
    met = pairs.join(texts_of[0], "a").join(texts_of[1], "b").where(F.levenshtein("a_word", "b_word", 1) == 1)
    return met.select(F.col("a_word").alias("a"), F.col("b_word").alias("b"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word with a form: forms followed to the last, twice as far in every round."""
    at = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = stored(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not at.where("moved").head(1):
            return at.drop("moved")
        at = at.drop("moved")


def variants(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT
) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word of the texts with the more frequent one it may be a slip of.

    Words are runs of letters with A-Z in lower case; a run whose checksum with the document's id says so loses a
    letter first. A word counts with ``least_chars`` code points and ``least_count`` occurrences. Two words are near
    when one code point is put in, left out or replaced. The form is the near word of largest ``n`` (ties: the
    smallest in code-point order) if that is twice the word's own or more; the root follows forms to the last.

    A null or empty text has no words; a null id is an empty id in the checksum. Repeated rows count as often as
    they occur. An empty table gives an empty one; other columns are not read.
    """
    words = stored(vocabulary(df, id_col, text_col, least_chars, least_count), "vocabulary")
    pairs = short_pairs(words).union(long_pairs(words))
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))
    near = pairs.select(F.inline(both)).distinct().join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near").alias("form"))).alias("best"))
    counted = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.col1")).alias("form_n"))
    right = F.col("form_n") >= 2 * F.col("n")
    judged = stored(counted.withColumn("form", F.when(right, F.col("form"))).withColumn("form_n", F.when(right, F.col("form_n"))), "near-words")
    last = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
