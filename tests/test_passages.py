"""Passages are looked for in the words of many texts at once."""

import sys

from pyspark.sql import functions as F

from corvane.functions.text import tokens
from corvane.operators import passages


def test_blanks_part_words_alike_in_both_languages(spark):
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x3100 or c % 97 == 0)]
    df = spark.createDataFrame([(f"a{chr(c)}b c", c) for c in points], "text string, c int")
    got = {r.c: r.n for r in df.select("c", F.size(tokens(F.col("text"))).alias("n")).collect()}
    assert got == {c: len(f"a{chr(c)}b c".split()) for c in points}


def test_runs_are_found_in_many_texts_at_once_and_never_across_them():
    known = passages.Passages([("long", "", "a b c d e f g h i".split()), ("short", "", ["x", "y"])])
    texts = ["z a b c d e f g h z x", "y a b c d", "e f g h i", "", "q x y", "b c d e f g h i x y"]
    assert known.within(texts) == [(0, 0), (4, 1), (5, 0), (5, 1)]
