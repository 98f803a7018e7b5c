"""Pairs of a query set and a table: by brute force, with ties, repeated cells and values that are no numbers; no pair is shuffled."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumigrid.functions import text as T
from lumigrid.operators import pairs, rerank, similarity as S, stats


def _prints(spark, rows):
    return spark.createDataFrame(rows, "id string, cell bigint, val double")


def test_spearman_of_constant_sides(spark):
    rows = [(1, i, 2.0, float(i)) for i in range(4)] + [(2, i, float(i), float(i * i)) for i in range(4)] + [(3, 0, 1.0, 2.0)] + [(4, i, 1.0, 1.0) for i in range(5)]
    both = spark.createDataFrame(rows, "qid int, doc_id int, a double, b double")
    assert {r.qid: r.rho for r in stats.spearman(both).collect()} == {1: None, 2: pytest.approx(1.0), 3: None, 4: None}


def test_negation_reads_edges_as_sql(spark):
    texts = ["le noël", "no vacío", "ano no\x0bway", "all except cats\n", "not this?\nnor that"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.negation(F.col("t")).alias("n")).select("i", "n.*")
    got = {r.i: (r.kind, r.cues, r.negated) for r in rows.collect()}
    assert got[0] == ("negated_concept", ["no"], [])
    assert got[1] == ("negated_concept", ["no"], ["vacío"])
    assert got[2] == ("negated_concept", ["no"], [])
    assert got[3] == ("negated_concept", ["except"], ["cats"])  # as in SQL, . stops at the line's end and $ is the text's
    assert got[4][1] == ["not", "nor"]


def test_ranking_by_rounded_scores(spark):
    docs = _prints(spark, [("b", 1, 1.0), ("a", 1, 0.9999999), ("c", 1, 0.5)])
    q = _prints(spark, [("q", 1, 1.0)])
    assert [(r.doc_id, r.score, r["rank"]) for r in S.ranked(q, docs, digits=6, fill=False).orderBy("rank").collect()] == [("a", 1.0, 1), ("b", 1.0, 2), ("c", 0.5, 3)]
    assert S.ranked(q, _prints(spark, [("z", 2, 1.0)]), digits=6, fill=False).count() == 0


def test_rounding_of_halves():
    import numpy as np

    assert pairs.half_up(np.array([0.5000005, 1.0000005, -0.5000005, 0.1234564]), 6).tolist() == [500001, 1000001, -500001, 123456]


def test_pairs_by_brute_force(spark, monkeypatch):
    random.seed(3)
    values = [0.25, 0.5, 1.0, 2.0]
    rows = [(f"d{i:03d}", random.choice([0, 1, 2, 3, 17, 40]) if i % 5 else random.randrange(64), random.choice(values)) for i in range(90) for _ in range(random.randrange(5))]
    rows += [("d000", 1, math.nan), ("d001", 1, math.nan), ("d002", 1, 0.5), ("d002", 1, 0.5)]
    docs = _prints(spark, rows)
    q = docs.where("id < 'd012'")
    x, y = q.select(F.col("id").alias("qid"), "cell", F.col("val").alias("u")), docs.select(F.col("id").alias("doc_id"), "cell", F.col("val").alias("v"))
    want = x.join(y, "cell").groupBy("qid", "doc_id").agg(F.count("*").alias("both"), F.sum(F.col("u") * F.col("v")).alias("dot"), F.sum(F.least("u", "v")).alias("least"), F.count_if(F.col("u") == F.col("v")).alias("same"), F.count_if(F.floor(F.col("cell") / 16) == 1).alias("b1"))
    names = ["qid", "doc_id", "both", "dot", "least", "same", "b1"]
    plain = lambda df: sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.select(*names).collect())
    assert plain(pairs.pairs(q, docs, compare=True, block=16, blocks=4)) == plain(want)
    clean = docs.where("not isnan(val)").groupBy("id", "cell").agg(F.max("val").alias("val"))
    x, y = clean.where("id < 'd012'").select(F.col("id").alias("qid"), "cell", F.col("val").alias("u")), clean.select(F.col("id").alias("doc_id"), "cell", F.col("val").alias("v"))
    want = x.join(y, "cell").groupBy("qid", "doc_id").agg(F.count("*").alias("both"), F.sum(F.col("u") * F.col("v")).alias("dot"), F.sum(F.least("u", "v")).alias("least"), F.count_if(F.col("u") == F.col("v")).alias("same"), F.count_if(F.floor(F.col("cell") / 16) == 1).alias("b1"))
    assert plain(pairs.pairs(clean.where("id < 'd012'"), clean, compare=True, block=16, blocks=4)) == plain(want)


def test_no_pair_is_shuffled(spark):
    docs = _prints(spark, [(f"d{i}", i % 7, 1.0) for i in range(40)])
    q = docs.where("id = 'd1'")
    for df in (S.set_metrics(q, docs), S.distances(q, docs, 8), rerank.pair_features(q, docs, 64, 16, 4), S.spatial_jaccard(q, docs, 8), S.idf_intersection(q, docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan.split("MapInArrow")[0] and "hashpartitioning(qid" not in plan
    v = spark.createDataFrame([(i, [float(i % 3)] * 64) for i in range(30)], "id bigint, vector array<double>")
    for df in (S.block_attention(v.where("id = 1"), v, 8), S.nearest(v.where("id = 1"), v)):
        assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in S.nearest(v.where("id = 1"), v, 3).orderBy("rank").collect()] == [2, 4, 5]
