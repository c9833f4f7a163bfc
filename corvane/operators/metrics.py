"""Retrieval metrics over ``ranking(qid, doc, rank)`` and ``qrels(qid, doc, rel)`` tables.

Gains are linear, the ideal ranking covers every judged document of a query, a query without hits
counts as zero, and means run over all queries. ``segments`` repeats the evaluation per corpus or
cell in the same plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import tokens


def word_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct lower-case words that the text holds."""
    wanted = F.array_distinct(tokens(F.lower(query)))
    held = F.size(F.array_intersect(wanted, tokens(F.lower(text))))
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(held / F.size(wanted))


def recall_vs_exact(exact: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Mean share of each query's exact set that the candidate set holds (both distinct)."""
    found = candidate.select("qid", key, F.lit(1).alias("_hit"))
    per_query = exact.join(found, ["qid", key], "left").groupBy("qid").agg(
        F.count("*").alias("target"), F.count("_hit").alias("found")
    )
    return per_query.agg(
        F.count("*").alias("queries"), F.avg(F.col("found") / F.col("target")).alias("recall")
    )


def gain(rel: Column, rank: Column) -> Column:
    return rel / F.log2(rank + 1)


def per_query_metrics(
    ranking: DataFrame,
    qrels: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    segments: Sequence[str] = (),
    doc: str = "doc_id",
    decimals: int = 9,
) -> DataFrame:
    """``segments..., qid, ndcg, recall, mrr, p1`` for every row of ``queries(segments..., qid)``.

    ``qrels`` may carry the segment columns or leave them out, when one set of judgements serves
    all segments.
    """
    keys = [*segments, "qid"]
    judged_keys = [c for c in keys if c in qrels.columns]
    judged = qrels.where(F.col("rel") > 0)
    hits = (
        ranking.where(F.col("rank") <= k)
        .join(judged, [*judged_keys, doc])
        .groupBy(*keys)
        .agg(
            F.sum(gain(F.col("rel"), F.col("rank"))).alias("dcg"),
            F.count("*").alias("found"),
            F.min("rank").alias("first"),
        )
    )
    # Only the k best judgements of a query make its ideal, so the ranking is cut before the
    # shuffle; the number of relevant documents is a plain count.
    place = Window.partitionBy(*judged_keys).orderBy(F.desc("rel"))
    best = judged.select(*judged_keys, "rel", F.row_number().over(place).alias("_at")).where(F.col("_at") <= k)
    ideal = best.groupBy(*judged_keys).agg(F.sum(gain(F.col("rel"), F.col("_at"))).alias("ideal")).join(
        judged.groupBy(*judged_keys).agg(F.count("*").alias("relevant")), judged_keys
    )
    zero = F.lit(0.0)
    return (
        queries.select(*keys)
        .join(hits, keys, "left")
        .join(ideal, judged_keys, "left")
        .select(
            *keys,
            F.round(F.coalesce(F.col("dcg") / F.col("ideal"), zero), decimals).alias("ndcg"),
            F.round(F.coalesce(F.col("found") / F.col("relevant"), zero), decimals).alias("recall"),
            F.round(F.coalesce(1 / F.col("first"), zero), decimals).alias("mrr"),
            F.coalesce((F.col("first") == 1).cast("double"), zero).alias("p1"),
        )
    )


def mean_metrics(per_query: DataFrame, by: Sequence[str]) -> DataFrame:
    return per_query.groupBy(*by).agg(
        F.count("*").alias("n_queries"), *[F.avg(m).alias(m) for m in ("ndcg", "recall", "mrr", "p1")]
    )


def delivered_views(
    chunk_ranking: DataFrame, doc_ranking: DataFrame, qrels: DataFrame, queries: DataFrame, ks: Sequence[int], *, doc: str = "doc_id"
) -> DataFrame:
    """nDCG at each depth of ``ks`` as delivered and over distinct documents.

    Delivered: the first k chunks as they come, where a repeated document earns nothing but still
    takes its slot. Documents: the first k distinct documents. Distinct: how many the first k
    chunks name. Both rankings reach as deep as the largest k: ``doc_ranking`` ranks documents by
    their best chunk, so no depth of chunks has to hold enough of them.
    """
    depths = F.array(*[F.lit(int(x)) for x in sorted(set(ks))])
    seen = chunk_ranking.groupBy("qid", doc).agg(F.min("rank").alias("rank"))
    firsts = (
        doc_ranking.select("qid", doc, F.col("rank").alias("doc_rank")).where(F.col("doc_rank") <= max(ks))
        .join(seen, ["qid", doc], "left")
        .join(qrels.where("rel > 0"), ["qid", doc], "left")
        .select("qid", doc, "rank", "doc_rank", F.coalesce("rel", F.lit(0)).alias("rel"))
    )
    by_k = firsts.withColumn("k", F.explode(F.filter(depths, lambda x: x >= F.col("doc_rank")))).groupBy("qid", "k").agg(
        F.sum(F.when(F.col("rank") <= F.col("k"), gain(F.col("rel"), F.col("rank"))).otherwise(0.0)).alias("dcg_delivered"),
        F.sum(gain(F.col("rel"), F.col("doc_rank"))).alias("dcg_documents"),
        F.count_if(F.col("rank") <= F.col("k")).alias("distinct_docs"),
    )
    place = Window.partitionBy("qid").orderBy(F.desc("rel"))
    judged = qrels.where("rel > 0").select("qid", "rel", F.row_number().over(place).alias("_at")).where(
        F.col("_at") <= max(ks)
    )
    ideal = judged.withColumn("k", F.explode(F.filter(depths, lambda x: x >= F.col("_at")))).groupBy("qid", "k").agg(
        F.sum(gain(F.col("rel"), F.col("_at"))).alias("ideal")
    )
    zero = F.lit(0.0)
    return (
        queries.select("qid", F.explode(depths).alias("k"))
        .join(by_k, ["qid", "k"], "left")
        .join(ideal, ["qid", "k"], "left")
        .select(
            "qid",
            "k",
            F.round(F.coalesce(F.col("dcg_delivered") / F.col("ideal"), zero), 9).alias("delivered"),
            F.round(F.coalesce(F.col("dcg_documents") / F.col("ideal"), zero), 9).alias("documents"),
            F.coalesce("distinct_docs", F.lit(0)).cast("double").alias("distinct_docs"),
        )
    )


def rungs_for_cap(caps: DataFrame, product_k: int, budgets: Sequence[int], ladder_caps: Sequence[int]) -> DataFrame:
    """``cap, k, budgets, product``: the depths a cell of that cap is scored at."""
    per_budget = caps.select(
        "cap", F.explode(F.array(*[F.lit(b) for b in budgets]) if budgets else F.array().cast("array<int>")).alias("budget")
    ).where(F.col("cap").isin(*ladder_caps)).select("cap", F.floor(F.col("budget") / F.col("cap")).cast("int").alias("k"), "budget")
    rows = per_budget.where("k >= 1").unionByName(
        caps.select("cap", F.lit(product_k).alias("k"), F.lit(None).cast("int").alias("budget"))
    )
    return rows.groupBy("cap", "k").agg(
        F.array_join(F.array_sort(F.collect_set("budget")), ",").alias("budgets"),
        (F.col("k") == product_k).alias("product"),
    )


def multiset_overlap(left: Column, right: Column) -> Column:
    """How many elements two short arrays of strings share, repeated ones as often as both have them; inside the row.

    Both are sorted into one array, in which equal elements stand together, and one fold counts each side's.
    """

    def marked(values: Column, side: int) -> Column:
        return F.transform(values, lambda x: F.struct(x.alias("x"), F.lit(side).alias("side")))

    def step(acc: Column, e: Column) -> Column:
        here, other = (e["side"] == 0).cast("int"), (e["side"] == 1).cast("int")
        return F.when(e["x"] == acc["x"], F.struct(acc["x"].alias("x"), (acc["l"] + here).alias("l"), (acc["r"] + other).alias("r"), acc["n"].alias("n"))).otherwise(
            F.struct(e["x"].alias("x"), here.alias("l"), other.alias("r"), (acc["n"] + F.least(acc["l"], acc["r"])).alias("n"))
        )

    start = F.struct(F.lit("").alias("x"), F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(0).alias("n"))
    both = F.array_sort(F.concat(marked(left, 0), marked(right, 1)))
    return F.aggregate(both, start, step, lambda acc: acc["n"] + F.least(acc["l"], acc["r"]))


COUNTED = 1 << 18  # words that are counted at a time


def counted_overlap(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Per row how many elements two lists of strings share, repeated ones as often as both have them.

    Rows are taken together until they have ``COUNTED`` words, so that memory depends on the longest text and not on the batch.
    """
    longs = [pc.fill_null(pc.list_value_length(side), 0).to_numpy().astype(np.int64) for side in (left, right)]
    upto = np.cumsum(longs[0] + longs[1])
    out, first = np.zeros(len(left), dtype=np.int64), 0
    while first < len(left):
        most = COUNTED + (upto[first - 1] if first else 0)
        last = max(first + 1, int(np.searchsorted(upto, most, side="right")))
        words = [pc.list_flatten(side.slice(first, last - first)) for side in (left, right)]
        known = pa.concat_arrays(words).dictionary_encode(null_encoding="encode")
        row = np.concatenate([np.repeat(np.arange(last - first), n[first:last]) for n in longs])
        cell = row * max(1, len(known.dictionary)) + known.indices.to_numpy()
        (a, times), (b, others) = (np.unique(side, return_counts=True) for side in np.split(cell, [len(words[0])]))
        met, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        np.add.at(out, first + met // max(1, len(known.dictionary)), np.minimum(times[at], others[to]))
        first = last
    return out


def word_recall(pairs: DataFrame, key: str, reference: str, extracted: str) -> DataFrame:
    """Token-multiset recall of ``extracted`` against ``reference`` (arrays of tokens) per row; an empty reference scores 1.

    Equal sides score 1 and stay where they are; the others are counted in bulk, and no row waits for its count.
    """
    same = F.coalesce(F.col(reference) == F.col(extracted), F.lit(False))
    sides = [F.when(~same, F.col(c)).alias(name) for c, name in ((reference, "_a"), (extracted, "_b"))]
    sent = pairs.select(key, F.when(F.size(reference) > 0, F.size(reference)).otherwise(0).alias("_n"), same.alias("_same"), *sides)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("_n").to_numpy()
            full = np.where(batch.column("_same").to_numpy(zero_copy_only=False), n, counted_overlap(batch.column("_a"), batch.column("_b")))
            recall = np.divide(full, n, out=np.ones(len(n)), where=n > 0)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(recall)], [key, "word_recall"])

    return sent.mapInArrow(counted, pairs.select(key).schema.add("word_recall", "double"))
