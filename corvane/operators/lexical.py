"""BM25 over a stored inverted index, one per corpus, each analysed in its own language.

Documents are dealt to blocks by hash. A posting list holds a term's documents of one block, with their impacts
(the saturated, length-normalised term counts) and the largest of these, so a frequent term never meets in one
place. A search moves the lists of the query terms only; a block's scores are added up sparsely, and a
query skips the blocks whose largest impacts cannot reach its best ``k`` so far.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.topk import in_blocks, table_codes
from corvane.schema import ConfigError
from corvane.session import cut_lineage, shared_folder

K1 = 1.5  # fixed values: the public defaults of the ranking function
B = 0.75

TERM = r"[\p{L}\p{N}_]{2,}"

# The usual English stop words of lexical search engines.
ENGLISH_STOPS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it",
    "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they",
    "this", "to", "was", "will", "with",
)

# The most frequent German function words.
GERMAN_STOPS = (
    "aber", "als", "am", "an", "auch", "auf", "aus", "bei", "bin", "bis", "das", "dem", "den", "der",
    "des", "die", "durch", "ein", "eine", "einem", "einen", "einer", "er", "es", "für", "hat", "ich",
    "im", "in", "ist", "mit", "nach", "nicht", "noch", "oder", "sich", "sie", "sind", "so", "über",
    "um", "und", "von", "vor", "war", "wie", "wir", "zu", "zum", "zur",
)

# The most frequent French function words.
FRENCH_STOPS = (
    "au", "aux", "avec", "ce", "ces", "dans", "de", "des", "du", "elle", "en", "est", "et", "eux", "il",
    "ils", "je", "la", "le", "les", "leur", "lui", "ma", "mais", "me", "mes", "mon", "ne", "nos", "notre",
    "nous", "on", "ou", "où", "par", "pas", "pour", "qu", "que", "qui", "sa", "se", "ses", "son", "sur",
    "ta", "te", "tes", "ton", "tu", "un", "une", "vos", "votre", "vous", "été", "sont", "plus", "comme",
)

# The most frequent Spanish function words.
SPANISH_STOPS = (
    "al", "como", "con", "de", "del", "desde", "el", "ella", "ellas", "ellos", "en", "entre", "era",
    "es", "esta", "este", "esto", "fue", "ha", "hasta", "hay", "la", "las", "le", "les", "lo", "los", "me",
    "mi", "más", "muy", "ni", "no", "nos", "nosotros", "o", "para", "pero", "por", "porque", "que", "quien",
    "se", "ser", "sin", "sobre", "son", "su", "sus", "también", "te", "tu", "un", "una", "y", "ya", "yo",
)

STOPS = {"english": ENGLISH_STOPS, "german": GERMAN_STOPS, "french": FRENCH_STOPS, "spanish": SPANISH_STOPS}
MARKERS = {"de": "german", "fr": "french", "es": "spanish", "en": "english"}

# Endings that are taken off one after the other, with what is put in their place; three letters stay.
ENDINGS = {
    "english": (("^(.{3,})ies$", "y"), ("^(.{2,}(?:ss|sh|ch|x|z))es$", ""), ("^(.{3,}[^su])s$", ""), ("^(.{3,})(?:ingly|edly|ing|ed|ly)$", ""), ("^(.{3,})e$", "")),
    "german": (("^(.{3,})(?:ungen|heiten|keiten|schaften)$", "ung"), ("^(.{3,})(?:ern|em|en|er|es|e|n|s)$", "")),
    "french": (("^(.{3,})aux$", "al"), ("^(.{3,})(?:s|x)$", ""), ("^(.{3,})(?:ement|ment|ée|er|é|e)$", "")),
    "spanish": (("^(.{3,})(?:es|s)$", ""), ("^(.{3,})(?:amente|mente|ando|iendo|ado|ido|ar|er|ir|o|a|e)$", "")),
}


def language_of(corpus: Column) -> Column:
    """The language a corpus name asks for: its ``_de`` or ``_en`` marker, else English."""
    marked = F.concat(corpus, F.lit("_"))
    return F.when(F.contains(marked, F.lit("_de_")), F.lit("german")).otherwise(F.lit("english"))


def analyzer_of(corpus: Column) -> Column:
    """The analyzer of a corpus: as :func:`language_of`, with the ``_fr`` and ``_es`` markers beside."""
    marked = F.concat(corpus, F.lit("_"))
    found = language_of(corpus)
    for marker in ("fr", "es"):
        found = F.when(F.contains(marked, F.lit(f"_{marker}_")), F.lit(MARKERS[marker])).otherwise(found)
    return found


def terms(text: Column, stops: Sequence[str] = ENGLISH_STOPS) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stops)) if stops else found


def stem(word: Column, language: str) -> Column:
    for ending, instead in ENDINGS[language]:
        word = F.regexp_replace(word, ending, f"$1{instead}")
    return word


def analysed(text: Column, language: str) -> Column:
    """The stems of a text's words that are no stop words of the language."""
    return F.transform(terms(text, STOPS[language]), lambda w: stem(w, language))


def terms_of(text: Column, language: Column) -> Column:
    """:func:`analysed` in a text's own language."""
    found = F.when(language == "german", analysed(text, "german"))
    for one in ("french", "spanish"):
        found = found.when(language == one, analysed(text, one))
    return found.otherwise(analysed(text, "english"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


@functools.lru_cache(maxsize=500_000)
def stemmed(word: str, language: str) -> str | None:
    """The stem of a word, None for a stop word; a word is looked at once per worker."""
    if word in STOPS[language]:
        return None
    for pattern, instead in _endings(language):
        word = pattern.sub(instead, word)
    return word


@functools.cache
def _endings(language: str) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(ending), rf"\1{instead}") for ending, instead in ENDINGS[language]]


def _counted(batches: Iterator[pa.RecordBatch], asked: dict[str, set[str]] | None) -> Iterator[pa.RecordBatch]:
    """Each document's stems with their counts (of ``asked`` ones by language, if given), and how many there are.

    A word is looked at once per slice of documents, and only if it starts as an asked stem does; the rest is counting of numbers.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            for language in part.column("language").unique().to_pylist():
                yield _counts(part.filter(pc.equal(part.column("language"), language)), language, None if asked is None else asked.get(language, set()))


def _counts(part: pa.RecordBatch, language: str, asked: set[str] | None) -> pa.RecordBatch:
    if language not in STOPS:
        raise ConfigError(f"no analyzer for {language!r}")
    words = part.column("words")
    flat = words.flatten().dictionary_encode()
    doc = np.repeat(np.arange(part.num_rows), words.value_lengths().to_numpy())
    counted = pc.invert(pc.is_in(flat.dictionary, pa.array(STOPS[language], pa.string()))).to_numpy(zero_copy_only=False)
    near = counted
    if asked is not None:
        heads = pa.array({x[:STEM_HEAD] for x in asked}, pa.string())
        near = counted & pc.is_in(pc.utf8_slice_codeunits(flat.dictionary, 0, STEM_HEAD), heads).to_numpy(zero_copy_only=False)
    numbers: dict[str, int] = {}
    of = np.full(len(flat.dictionary), -1, dtype=np.int64)
    for i, word in zip(np.flatnonzero(near).tolist(), flat.dictionary.filter(pa.array(near)).to_pylist(), strict=True):
        found = stemmed(word, language)
        if asked is None or found in asked:
            of[i] = numbers.setdefault(found, len(numbers))
    at = flat.indices.to_numpy()
    lengths = np.bincount(doc[counted[at]], minlength=part.num_rows).astype(np.int32)
    doc, number = doc[of[at] >= 0], of[at][of[at] >= 0]
    pairs, tf = np.unique(doc * max(1, len(numbers)) + number, return_counts=True)
    doc, number = np.divmod(pairs, max(1, len(numbers)))
    terms = pa.array(list(numbers), pa.string()).take(pa.array(number))
    flat = pa.StructArray.from_arrays([terms, pa.array(tf.astype(np.int32))], ["term", "tf"])
    ends = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
    columns = [part.column(c) for c in ("doc", "corpus", "language")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(lengths), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc", "corpus", "language", "len", "terms"])


def _lists(batches: Iterator[pa.RecordBatch], k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """The posting lists of documents that come block by block; a block of very many documents (repeated keys) has several lists of a term."""
    now, held, many = (None, None), [], 0
    for batch in batches:
        corpora, numbers = batch.column("corpus").to_pylist(), batch.column("block").to_pylist()
        start = 0
        for i in range(batch.num_rows):
            if (corpora[i], numbers[i]) != now or many + i - start >= 4 * BLOCK_DOCS:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield _listed(pa.Table.from_batches(held).combine_chunks(), *now, k1, b)
                now, held, many, start = (corpora[i], numbers[i]), [], 0, i
        if batch.num_rows > start:
            held.append(batch.slice(start))
            many += batch.num_rows - start
    if held:
        yield _listed(pa.Table.from_batches(held).combine_chunks(), *now, k1, b)


def _listed(rows: pa.Table, corpus: str, block: int, k1: float, b: float) -> pa.RecordBatch:
    terms = rows.column("terms").chunk(0)
    flat = terms.flatten()
    code = flat.field("term").dictionary_encode()
    doc = np.repeat(np.arange(rows.num_rows), terms.value_lengths().to_numpy())
    tf = flat.field("tf").to_numpy()
    impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * rows.column("long").to_numpy()[doc]))
    order = np.argsort(code.indices.to_numpy(), kind="stable")
    starts = np.searchsorted(code.indices.to_numpy()[order], np.arange(len(code.dictionary) + 1))
    postings = pa.StructArray.from_arrays([pa.array(impact[order]), rows.column("doc").chunk(0).take(pa.array(doc[order]))], ["impact", "doc"])
    columns = [
        pa.array([corpus] * len(code.dictionary), pa.string()), code.dictionary, pa.array(np.full(len(code.dictionary), block)),
        pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), postings), pa.array(np.maximum.reduceat(impact[order], starts[:-1])),
        pa.array(np.add.reduceat(tf[order].astype(np.int64), starts[:-1])),
    ]
    return pa.RecordBatch.from_arrays(columns, ["corpus", "term", "block", "postings", "most", "occurrences"])


BLOCK_DOCS = 512  # documents of a block, about
FEW_TERMS = 100_000  # terms of queries that are sent to the documents
SLICE = 2048  # documents whose words are counted at a time
STEM_HEAD = 3  # characters of a word that no ending takes
QUERY_BLOCK = 4096  # queries that a search answers at a time


class PostingsIndex:
    """Posting lists, document frequencies and corpus sizes under one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}")

    def build(
        self, docs: DataFrame, keys: Sequence[str], *, corpus: Column, language: Column, k1: float = K1, b: float = B, asked: DataFrame | None = None
    ) -> PostingsIndex:
        """Index ``docs`` (``keys..., text``); documents without a corpus are left out.

        With ``asked`` (``text``) the index serves those queries alone: every word counts for the lengths, but lists are made
        of their terms only: a task counts these alone unless they are too many to be sent to it.

        Texts are analysed once. A task counts a document's terms where its text is; what is shuffled are documents' counted
        terms, gathered per corpus and block, where they become lists.
        """
        keys = list(keys)
        source = docs.select(F.struct(*keys).alias("doc"), corpus.alias("corpus"), language.alias("language"), terms(F.coalesce("text", F.lit("")), ()).alias("words"))
        source = source.where(F.col("corpus").isNotNull())
        found = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))
        shape = T.StructType([*source.schema.fields[:3], T.StructField("len", T.IntegerType()), T.StructField("terms", found)])
        few = words = None
        if asked is not None:
            words = cut_lineage(self._asked(asked.select(F.lit(0).alias("qid"), "text"), list(STOPS)).select("language", "term").distinct())
            if words.count() <= FEW_TERMS:
                few = {language: set() for language in STOPS}
                for row in words.collect():
                    few[row["language"]].add(row["term"])
        sent = self.spark.sparkContext.broadcast(few)
        known = cut_lineage(source.mapInArrow(lambda batches: _counted(batches, sent.value), shape))
        sizes = known.groupBy("corpus").agg(
            F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), F.first("language").alias("language"),
            F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("blocks"),
        )
        sizes.coalesce(1).write.parquet(f"{self.path}/corpora")
        size = self._table("corpora").select("corpus", "avg_len", "blocks")  # a row per corpus
        rows = known.join(F.broadcast(size) if size.count() <= 10_000 else size, "corpus")
        rows = rows.select("corpus", F.pmod(F.xxhash64("doc"), F.col("blocks")).alias("block"), "doc", (F.col("len") / F.col("avg_len")).alias("long"), "terms")
        rows = rows.where(F.size("terms") > 0).repartition("corpus", "block").sortWithinPartitions("corpus", "block")
        posting = T.StructType([T.StructField("impact", T.DoubleType()), known.schema["doc"]])
        made = T.StructType([
            T.StructField("corpus", T.StringType()), T.StructField("term", T.StringType()), T.StructField("block", T.LongType()),
            T.StructField("postings", T.ArrayType(posting)), T.StructField("most", T.DoubleType()), T.StructField("occurrences", T.LongType()),
        ])
        lists = rows.mapInArrow(lambda batches: _lists(batches, k1, b), made)
        if words is not None and few is None:
            wanted = self._table("corpora").select("corpus", "language").join(words, "language").select("corpus", "term").distinct()
            lists = lists.join(wanted, ["corpus", "term"], "left_semi")
        lists.sortWithinPartitions("corpus", "term").write.parquet(f"{self.path}/postings")
        frequent = self._table("postings").groupBy("corpus", "term").agg(F.sum(F.size("postings")).alias("df"), F.sum("occurrences").alias("cf"))
        frequent.write.parquet(f"{self.path}/terms")
        return self

    def statistics(self) -> DataFrame:
        """``corpus, term, df, cf, idf`` of every term."""
        sizes = self._table("corpora").select("corpus", "n_docs")
        return self._table("terms").join(sizes, "corpus").select("corpus", "term", "df", "cf", idf(F.col("n_docs"), F.col("df")).alias("idf"))

    def _asked(self, queries: DataFrame, languages: list[str] | None = None) -> DataFrame:
        """``qid, language, term``: the terms of ``queries`` (``qid, text``) as each analyzer (of the corpora, if none are named) finds them."""
        if languages is None:
            languages = [r["language"] for r in self._table("corpora").select("language").distinct().collect()]  # one per analyzer
        if not languages:
            return queries.select("qid", F.lit("").alias("language"), F.col("text").alias("term")).limit(0)
        found = F.array(*[F.struct(F.lit(x).alias("language"), analysed(F.col("text"), x).alias("terms")) for x in languages])
        return queries.select("qid", F.inline(found)).select("qid", "language", F.explode("terms").alias("term"))

    def search(self, queries: DataFrame, k: int, *, per_corpus: bool = True, decimals: int = 6) -> DataFrame:
        """``qid, corpus, keys..., score, rank``: the best ``k`` documents per query, of each corpus or of all.

        ``queries`` (``qid, text``) are analysed as the corpora are. A document that shares no term with a query is no hit.
        """
        if not queries.head(1):
            raise ConfigError("no queries")
        asked = cut_lineage(self._asked(queries).groupBy("qid", "language", "term").agg(F.count("*").alias("qtf")))
        postings = self._table("postings")
        qid_type, key_fields = queries.schema["qid"].dataType, postings.schema["postings"].dataType.elementType["doc"].dataType.fields
        keys = [f.name for f in key_fields]
        order = Window.partitionBy("qid", *(["corpus"] if per_corpus else [])).orderBy(F.desc("score"), *keys, *([] if per_corpus else ["corpus"]))

        def one_pass(block: DataFrame) -> DataFrame:
            words = asked.join(block.select("qid"), "qid", "left_semi").join(self._table("corpora").select("corpus", "language", "n_docs"), "language")
            weighed = words.join(self._table("terms"), ["corpus", "term"]).select(
                "corpus", "term", F.struct("qid", (F.col("qtf") * idf(F.col("n_docs"), F.col("df"))).alias("w")).alias("ask")
            )
            weights = weighed.groupBy("corpus", "term").agg(F.collect_list("ask").alias("asks"))  # at most QUERY_BLOCK queries each
            met = postings.join(weights, ["corpus", "term"]).select("corpus", "block", "most", "postings", "asks")
            met = met.repartition("corpus", "block").sortWithinPartitions("corpus", "block")
            shape = T.StructType([T.StructField("qid", qid_type), T.StructField("corpus", T.StringType()), *key_fields, T.StructField("score", T.DoubleType())])
            found = met.mapInArrow(lambda batches: scored(batches, keys, k, decimals), shape)
            return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        return in_blocks(queries.select("qid"), QUERY_BLOCK, one_pass)


def scored(batches: Iterator[pa.RecordBatch], keys: list[str], k: int, decimals: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of every query and corpus among the blocks of a task, which come one after the other."""
    best: dict[object, pa.Table] = {}
    floor: dict[object, float] = {}
    now, held = (None, None), []

    def block_done() -> None:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists, asks = (rows.column(c).chunk(0) for c in ("postings", "asks"))
        impact, docs = lists.flatten().field("impact").to_numpy(), lists.flatten().field("doc")
        known = pa.Table.from_arrays([docs.field(c) for c in keys], keys)
        doc = table_codes(known, keys)
        codes, first, doc = np.unique(doc, return_index=True, return_inverse=True)
        begin, many = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.value_lengths().to_numpy()
        most = rows.column("most").to_numpy()
        qids = asks.flatten().field("qid").dictionary_encode()
        of_ask, weight = np.repeat(np.arange(rows.num_rows), asks.value_lengths().to_numpy()), asks.flatten().field("w").to_numpy()
        order = np.argsort(qids.indices.to_numpy(), kind="stable")
        cuts = np.searchsorted(qids.indices.to_numpy()[order], np.arange(len(qids.dictionary) + 1))
        for n, qid in enumerate(qids.dictionary.to_pylist()):
            mine = order[cuts[n] : cuts[n + 1]]
            row, w = of_ask[mine], weight[mine]
            if (w * most[row]).sum() < floor.get(qid, -1.0) - 10.0**-decimals:
                continue  # nothing here reaches the best so far
            size = many[row]
            at = np.repeat(begin[row] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            total = np.round(np.bincount(doc[at], weights=impact[at] * np.repeat(w, size), minlength=len(codes)), decimals)
            hit = np.flatnonzero(total > 0)
            if len(hit) > k:
                hit = hit[total[hit] >= np.partition(total[hit], len(hit) - k)[len(hit) - k]]
            if len(hit):
                new = known.take(pa.array(first[hit])).append_column("score", pa.array(total[hit]))
                new = pa.concat_tables([best[qid], new]) if qid in best else new
                best[qid] = new.sort_by([("score", "descending"), *((c, "ascending") for c in keys)]).slice(0, k)
                if best[qid].num_rows == k:
                    floor[qid] = best[qid].column("score")[k - 1].as_py()

    def corpus_done() -> Iterator[pa.RecordBatch]:
        for qid, found in best.items():
            full = found.add_column(0, "qid", pa.array([qid] * found.num_rows)).add_column(1, "corpus", pa.array([now[0]] * found.num_rows))
            yield from full.combine_chunks().to_batches()
        best.clear()
        floor.clear()

    for batch in batches:
        corpora, numbers = batch.column("corpus").to_pylist(), batch.column("block").to_pylist()
        start = 0
        for i in range(batch.num_rows):
            if (corpora[i], numbers[i]) != now:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    block_done()
                    held = []
                if corpora[i] != now[0]:
                    yield from corpus_done()
                now, start = (corpora[i], numbers[i]), i
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        block_done()
    yield from corpus_done()


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, *, keys: Sequence[str], corpus: Column, language: Column | None = None, per_corpus: bool = True) -> DataFrame:
    """An index built for one search, in the shared folder."""
    spark = docs.sparkSession
    index = PostingsIndex(spark, f"{shared_folder(spark).rstrip('/')}/postings-{uuid.uuid4().hex}")
    index.build(docs, keys, corpus=corpus, language=analyzer_of(corpus) if language is None else language, asked=queries)
    return index.search(queries, k, per_corpus=per_corpus)
