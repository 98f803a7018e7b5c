"""The best documents of a query set in one scan: as the joins give them, on odd texts and empty tables."""

from pyspark.sql import functions as F

from lumigrid.operators import bm25, lexical, similarity as S


def test_signals_and_holders(spark):
    texts = ["a red fox runs", "the red dog", None, "", "fox fox fox ran", "ΟΔΟΣ red", "xred foxy", "a red fox", "a red fox"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "red fox"), (2, "fox fox dog"), (3, "ΔΟΣ"), (4, ""), (5, None), (6, "zebra")], "item_id bigint, text string")
    a, b = lexical.signals(docs, items, (3, 2))
    want = S.top(bm25.scores(docs, items).withColumn("score", F.round("score", 6)), "qid", "score", "doc_id", 3)
    ranked = lambda df: {(r.qid, r.doc_id, r.score) for r in df.select("qid", "doc_id", "score").collect()}
    assert ranked(S.top(a, "qid", "score", "doc_id", 3)) == ranked(want)
    assert {(r.qid, r.doc_id) for r in S.top(b, "qid", "score", "doc_id", 2).collect() if r.qid == 1} == {(1, 0), (1, 7)}
    assert "mapInArrow" not in a._jdf.queryExecution().optimizedPlan().toString()  # read many times, scanned once
    joined = docs.select("doc_id", F.col("text").alias("body")).join(items, F.contains("body", "text")).select("item_id", "doc_id")
    assert sorted(map(tuple, lexical.holders(docs, items).collect())) == sorted(map(tuple, joined.collect()))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "red fox")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "red")], "item_id bigint, text string")
    for d, q in ((docs.where("false"), items), (docs, items.where("false"))):
        assert [x.count() for x in lexical.signals(d, q, (3, 3))] == [0, 0]
        assert lexical.holders(d, q).count() == 0
