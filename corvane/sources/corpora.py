"""Readers for retrieval corpora, judgements, question sets and page annotations.

Each reader has a parsing half that works on any DataFrame, so a table that already holds the
lines or the JSON needs no file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import strip, tokens
from corvane.schema import CHUNK_FILE, LAYOUT_PAGE

CORPUS_LINE = T.StructType([T.StructField(n, T.StringType()) for n in ("_id", "title", "text")])

# Which annotated regions are running text, and how long a block must be.
TEXT_CATEGORIES = ("text_block", "title")
MIN_BLOCK_CHARS = 20


def corpus_documents(lines: DataFrame) -> DataFrame:
    """``value`` lines of a jsonl corpus as ``doc_id, text``; of a repeated id the last line counts.

    ``position`` orders the lines; title and text are joined by one space.
    """
    parsed = lines.select("position", F.from_json("value", CORPUS_LINE).alias("d")).select(
        "position",
        F.col("d._id").alias("doc_id"),
        strip(F.concat_ws(" ", F.coalesce("d.title", F.lit("")), F.coalesce("d.text", F.lit("")))).alias("text"),
    )
    return parsed.groupBy("doc_id").agg(F.max_by("text", "position").alias("text"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One or more ``corpus.jsonl`` files; lines are ordered by file name, then by their place in the file."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    return corpus_documents(spark.read.text(path).select("value", place.alias("position")))


def read_tsv_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``query-id, corpus-id, score`` with a header, positive judgements only."""
    schema = "qid string, doc_id string, rel int"
    return spark.read.schema(schema).csv(path, sep="\t", header=True).where("rel > 0")


def trec_qrels(lines: DataFrame) -> DataFrame:
    """Whitespace-separated ``qid _ doc rel`` lines (column ``value``): at least four fields, rel > 0."""
    parts = lines.select(tokens(F.col("value")).alias("p")).where(F.size("p") >= 4)
    rows = parts.select(
        F.get("p", F.lit(0)).alias("qid"), F.get("p", F.lit(2)).alias("doc_id"), F.get("p", F.lit(3)).cast("int").alias("rel")
    )
    return rows.where("rel > 0")


def read_trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    return trec_qrels(spark.read.text(path))


def read_query_map(spark: SparkSession, path: str) -> DataFrame:
    """A one-object JSON file ``{qid: text}`` as rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("qid", "text"))


def read_qrels_map(spark: SparkSession, path: str) -> DataFrame:
    """A one-object JSON file ``{qid: {doc: rel}}`` as rows."""
    whole = spark.read.text(path, wholetext=True)
    per_query = whole.select(F.explode(F.from_json("value", "map<string,map<string,int>>")).alias("qid", "docs"))
    return per_query.select("qid", F.explode("docs").alias("doc_id", "rel"))


def read_chunk_file(spark: SparkSession, path: str) -> DataFrame:
    """A cached chunk set; selecting columns afterwards prunes the scan."""
    return spark.read.schema(CHUNK_FILE).parquet(path)


def verified_answer(context: Column, answers: Column) -> Column:
    """The first ``struct<start, text>`` whose offset really holds that text, else null."""
    pairs = F.arrays_zip(answers["text"], answers["answer_start"])
    return F.get(
        F.filter(
            F.transform(pairs, lambda p: F.struct(p["answer_start"].alias("start"), p["text"].alias("text"))),
            lambda p: F.substring(context, p["start"] + 1, F.length(p["text"])) == p["text"],
        ),
        F.lit(0),
    )


def squad_items(rows: DataFrame, order: str) -> DataFrame:
    """SQuAD-style rows as ``context_id, question, answer, start, end``.

    Equal contexts share the id of their first row (by ``order``). An answer no offset reproduces
    leaves ``answer`` null; such rows are for counting, not for measuring.
    """
    found = rows.select(
        order, "question", F.sha2("context", 256).alias("_key"), verified_answer(F.col("context"), F.col("answers")).alias("a")
    )
    ids = found.groupBy("_key").agg(F.min(order).alias("context_id"))
    return found.join(ids, "_key").select(
        order,
        "context_id",
        "question",
        F.col("a.text").alias("answer"),
        F.col("a.start").alias("start"),
        (F.col("a.start") + F.length("a.text")).alias("end"),
    )


def layout_blocks(layout_json: Column) -> Column:
    """The running-text blocks of a page annotation (JSON array), in reading order."""
    items = F.from_json(layout_json, LAYOUT_PAGE)
    kept = F.filter(
        items,
        lambda b: b["category_type"].isin(*TEXT_CATEGORIES)
        & ~F.coalesce(b["ignore"], F.lit(False))
        & (F.length(strip(F.coalesce(b["text"], F.lit("")))) >= MIN_BLOCK_CHARS),
    )
    keyed = F.transform(
        kept, lambda b, i: F.struct(F.coalesce(b["order"], F.lit(0.0)).alias("o"), i.alias("i"), strip(b["text"]).alias("t"))
    )
    return F.transform(F.array_sort(keyed), lambda b: b["t"])
