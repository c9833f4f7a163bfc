"""An index for one search holds the lists of its terms only and ranks as the whole index does."""

from pyspark.sql import functions as F

from corvane.operators.lexical import PostingsIndex, analyzer_of


def test_index_of_asked_terms_ranks_as_the_whole_one(spark, tmp_path):
    texts = ["red foxes run", "a red fox and more words here", "blue whales", "walking fox", "", None]
    docs = spark.createDataFrame([(i, t, c) for c in ("docs_en", "docs_de") for i, t in enumerate(texts)], "doc_id long, text string, corpus string")
    asked = spark.createDataFrame([(1, "red fox"), (2, "whale"), (3, "the")], "qid long, text string")
    made = {}
    for name, only in (("whole", None), ("asked", asked)):
        index = PostingsIndex(spark, f"{tmp_path}/{name}").build(docs, ["doc_id"], corpus=F.col("corpus"), language=analyzer_of(F.col("corpus")), asked=only)
        found = sorted(tuple(r) for r in index.search(asked, 5).collect())
        made[name] = found, {(r["corpus"], r["term"]) for r in index.statistics().collect()}
    assert made["whole"][0] == made["asked"][0] and made["whole"][0]
    assert made["asked"][1] < made["whole"][1] and ("docs_en", "blue") not in made["asked"][1]
