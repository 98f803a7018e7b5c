"""The ranker learned block by block: against the trainer on single pairs, and with no pair as a row."""

import random

import numpy as np
from pyspark.sql import functions as F

from lumigrid.operators import learned, rerank, similarity as S


def _tables(spark, n=120):
    random.seed(5)
    rows = [(i, c, random.choice([0.25, 0.5, 1.0])) for i in range(n) for c in random.sample(range(64), random.randrange(0, 40))]
    labels = [(i, (i * 7) % 3) for i in range(n)] + [(1, 2), (4, None), (200, 1)]
    return spark.createDataFrame(rows, "id bigint, cell bigint, val double"), spark.createDataFrame(labels, "id bigint, label int")


def _old(cells, labels):
    """Each pair a row: what the query did before."""
    features = rerank.pair_features(cells.where("id % 10 = 0"), cells, 64, 16, 4).where("qid != doc_id")
    gold = labels.where("id % 10 = 0").withColumnRenamed("id", "qid").join(labels.withColumnRenamed("id", "doc_id"), "label").select("qid", "doc_id")
    return rerank.training_set(features, gold, 3)


def test_as_the_trainer_of_single_pairs(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    cells, labels = _tables(spark)
    ready = VectorAssembler(inputCols=learned.names(4), outputCol="features").transform(_old(cells, labels)).persist()
    # In later trees splits of equal gain may be taken from another feature.
    model = GBTRegressor(featuresCol="features", labelCol="label", maxIter=2, maxDepth=4, seed=42).fit(ready.where("not held_out"))
    want = {(r.qid, r.doc_id): r.prediction for r in model.transform(ready.where("held_out")).collect()}
    table = learned.packed(cells, labels)
    asked = table.where("id % 10 = 0").withColumn("held_out", rerank.held_out("id", 3))
    rows, bins = learned.kept(asked.where("not held_out").drop("held_out"), table, 64, 16, 4)
    forest = learned.trained(rows, 8, 2)
    best = learned.best(asked.where("held_out").drop("held_out"), table, forest, bins, 64, 16, 4, 1000).collect()
    assert {(r.qid, r.doc_id) for r in best} == set(want)
    assert np.mean([abs(r.score - want[r.qid, r.doc_id]) > 1e-4 for r in best]) < 0.02
    monkeypatch.setattr(learned, "RENEW", 1)
    assert learned.trained(rows.repartition(3), 8, 2) == forest
    few = learned.best(asked.where("held_out").drop("held_out"), table, forest, bins, 64, 16, 4, 5)
    assert {(r.qid, r.doc_id) for r in S.top(few, "qid", "score", "doc_id", 5).collect()} == {(r.qid, r.doc_id) for r in S.top(spark.createDataFrame(best), "qid", "score", "doc_id", 5).collect()}


def test_blocks_hold_every_training_pair_once(spark):
    cells, labels = _tables(spark)
    want = _old(cells, labels).where("not held_out")
    table = learned.packed(cells, labels)
    asked = table.where("id % 10 = 0").where(~rerank.held_out("id", 3))
    rows, bins = learned.kept(asked, table, 64, 16, 4)
    found = [learned._block(x, 8) for x in rows.toArrow()["pairs"]]
    assert sum(len(y) for _, y in found) == want.count()
    assert sum(int(y.astype(float).sum()) for _, y in found) / learned.GRAIN == want.agg(F.sum("label")).first()[0]
    assert all(b.max() < 32 for b in bins)


def test_splits_and_thresholds():
    n, rest = np.array([[2, 0, 2], [1, 2, 1]]), np.array([[0, 0, 8], [4, 0, 4]])
    assert learned.split(n, rest) == (0, 0, (0.0, 4.0))
    assert learned.split(n, n * 3) is None
    assert learned.thresholds(np.array([1, 0, 1, 1])).tolist() == [1.0, 2.5]
    assert len(learned.thresholds(np.ones(1000))) == 31
    tree = (0, 1, (5.0,), (1, 0, (6.0,), (7.0,)))
    assert learned.predicted([tree, (1.0,)], np.array([[0, 2, 2], [9, 0, 1]], np.uint8)).tolist() == [6.0, 7.0, 8.0]


def test_empty_sides(spark):
    cells, labels = _tables(spark)
    top = learned.ranked(cells, labels, lambda t: t.where("id < 0"), 64, 16, 4, 3)
    assert top.count() == 0
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
