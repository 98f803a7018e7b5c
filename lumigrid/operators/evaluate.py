"""Retrieval metrics of rankings (qid, doc_id, rank) against gold (qid, doc_id), as joins and windows per query."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F


def per_query(ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5, 10)) -> DataFrame:
    """One row per query with gold: found_at, mrr, ap, p@k, r@k, ndcg@k (log2) and ndcg_ref@k (bit lengths).

    Average precision divides by all gold documents and precision by k. ndcg_ref discounts rank r by
    bit_length(r + 1) and the ideal by bit_length(i + 1) from i = 0, so that a perfect list of one has 0.5.
    """
    g = gold.select("qid", "doc_id").distinct()
    counts = g.groupBy("qid").agg(F.count("*").alias("n_gold"))
    hits = ranking.select("qid", "doc_id", "rank").join(g, ["qid", "doc_id"])
    numbered = hits.withColumn("hit", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    r, bits = F.col("rank"), lambda c: F.length(F.bin(c))
    aggs = [F.min("rank").alias("found_at"), F.sum(F.col("hit") / r).alias("ap_sum")]
    for k in ks:
        inside = r <= k
        aggs += [F.count_if(inside).alias(f"hits_{k}"), F.sum(F.when(inside, 1 / F.log2(r + 1)).otherwise(0.0)).alias(f"dcg_{k}"), F.sum(F.when(inside, 1 / bits(r + 1)).otherwise(0.0)).alias(f"dcgref_{k}")]
    out = counts.join(numbered.groupBy("qid").agg(*aggs), "qid", "left")
    cols = ["qid", "n_gold", F.col("found_at"), F.coalesce(1 / F.col("found_at"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("ap_sum") / F.col("n_gold"), F.lit(0.0)).alias("ap")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        ideal_ref = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / bits(i))
        cols += [
            F.coalesce(F.col(f"hits_{k}") / k, F.lit(0.0)).alias(f"p_{k}"), F.coalesce(F.col(f"hits_{k}") / F.col("n_gold"), F.lit(0.0)).alias(f"r_{k}"),
            F.coalesce(F.col(f"dcg_{k}") / ideal, F.lit(0.0)).alias(f"ndcg_{k}"), F.coalesce(F.col(f"dcgref_{k}") / (ideal_ref * 1.0), F.lit(0.0)).alias(f"ndcg_ref_{k}"),
        ]
    return out.select(*cols)


def sweep(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """The parameter sweep's metrics at 5: AP / min(gold, 5), MRR@5, nDCG with discount 1 / (i + 2), P@5, R@5."""
    g = gold.select("qid", "doc_id").distinct()
    counts = g.groupBy("qid").agg(F.count("*").alias("n_gold"))
    hits = ranking.where("rank <= 5").join(g, ["qid", "doc_id"]).withColumn("hit", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    agg = hits.groupBy("qid").agg(F.sum(F.col("hit") / F.col("rank")).alias("ap"), F.min("rank").alias("first"), F.count("*").alias("hits"), F.sum(1 / (F.col("rank") + 1)).alias("dcg"))
    cap = F.least(F.col("n_gold"), F.lit(5)).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), cap), F.lit(0.0), lambda s, i: s + 1 / (i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return counts.join(agg, "qid", "left").select("qid", zero(F.col("ap") / cap).alias("ap_5"), zero(1 / F.col("first")).alias("mrr_5"), zero(F.col("dcg") / ideal).alias("ndcg_5"), zero(F.col("hits") / 5).alias("p_5"), zero(F.col("hits") / F.col("n_gold")).alias("r_5"))


def within(ranking: DataFrame, candidates: DataFrame) -> DataFrame:
    """The ranking restricted to each query's candidates, ranked anew; queries without candidates are unrestricted."""
    listed = candidates.select("qid").distinct()
    kept = ranking.join(candidates.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi").unionByName(ranking.join(listed, "qid", "left_anti").select(ranking.columns))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))


def summary(metrics: DataFrame, by: str, names: tuple[str, ...] = ("mrr", "ap")) -> DataFrame:
    """Mean, least and most of metrics by operator, and whether its mean MRR is the best."""
    out = metrics.groupBy(by).agg(F.count("*").alias("n"), *[f(n).alias(f"{label}_{n}") for n in names for label, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    best = out.agg(F.max_by(by, F.struct(F.round("mean_mrr", 9), F.col(by))).alias("best"))
    return out.crossJoin(best).withColumn("is_best", F.col(by) == F.col("best")).drop("best")


def distribution(metrics: DataFrame, name: str = "mrr") -> DataFrame:
    """One row: mean, upper median, least, most, deviation, zeros, perfect ones, good ones, not found."""
    v = F.col(name)
    upper = F.element_at(F.sort_array(F.collect_list(v)), (F.floor(F.count("*") / 2) + 1).cast("int"))
    return metrics.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), upper.alias("median"), F.min(v).alias("least"), F.max(v).alias("most"), F.stddev_pop(v).alias("sd"), F.count_if(v == 0).alias("n_zero"), F.count_if(v == 1).alias("n_perfect"), F.count_if(v >= 0.9).alias("n_top"), F.count_if(F.col("found_at") == 1).alias("n_first"), F.count_if(F.col("found_at") <= 2).alias("n_first_two"))


def bootstrap(metrics: DataFrame, by: str, name: str = "mrr", resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean by group, from seeded resamples; fewer than two values give zeros."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(rows[name].to_numpy(float))
        if len(v) < 2:
            return pd.DataFrame({by: [key[0]], "n": [len(v)], "mean": [0.0], "low": [0.0], "high": [0.0]})
        random = np.random.RandomState(seed)
        means = np.sort([v[random.randint(0, len(v), len(v))].mean() for _ in range(resamples)])
        return pd.DataFrame({by: [key[0]], "n": [len(v)], "mean": [v.mean()], "low": [means[int(0.025 * resamples)]], "high": [means[min(resamples - 1, int(0.975 * resamples))]]})

    # One value per query: a group is as large as the query set.
    return metrics.groupBy(by).applyInPandas(one, f"{by} {dict(metrics.dtypes)[by]}, n bigint, mean double, low double, high double")


def combined_corpus(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corpus, gold) of entries (id, paragraphs): distinct (title, text) numbered in order of first sight as doc_%06d.

    The number is a range-partitioned rank of the first position, not one task's.
    """
    flat = entries.select("id", F.posexplode("paragraphs").alias("pos", "p")).select("id", "pos", F.col("p.title").alias("title"), F.col("p.paragraph_text").alias("text"), F.col("p.is_supporting").alias("gold"))
    first = flat.groupBy("title", "text").agg(F.min(F.struct("id", "pos")).alias("first"))
    numbered = numbered_by(first, "first").withColumn("doc_id", F.format_string("doc_%06d", F.col("number"))).select("doc_id", "title", "text")
    gold = flat.join(numbered, (flat["title"].eqNullSafe(numbered["title"])) & (flat["text"].eqNullSafe(numbered["text"]))).select(F.col("id").alias("qid"), "doc_id", "gold").distinct()
    return numbered, gold


def numbered_by(rows: DataFrame, order: str) -> DataFrame:
    """rows with `number`, 0 for the first by an order without ties: ranks within ranges plus the ranges' starts."""
    ranged = rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()).persist()
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).select("_part", F.coalesce("_start", F.lit(0)).alias("_start"))
    within_ = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return ranged.withColumn("_at", within_).join(starts, "_part").withColumn("number", F.col("_at") + F.col("_start")).drop("_part", "_at", "_start")


def deep_pool(queries: DataFrame, candidates: DataFrame, documents: DataFrame, size: int = 20, shares: int = 8) -> DataFrame:
    """(qid, doc_id, padded): each query's candidates, padded to `size` with other documents in the order of a hash.

    Documents are dealt into shares by hash and a query draws from its own, so no query meets all documents.
    """
    low = lambda c: F.conv(F.right(F.md5(c), F.lit(8)), 16, 10).cast("bigint")
    doc, qid = F.col("doc_id").cast("string"), F.col("qid").cast("string")
    dealt = documents.select("doc_id", F.pmod(low(doc), F.lit(shares)).alias("share"))
    asked = queries.select("qid", F.pmod(low(qid), F.lit(shares)).alias("share"))
    own = candidates.select("qid", "doc_id").distinct()
    have = own.groupBy("qid").agg(F.count("*").alias("n"))
    others = asked.join(dealt, "share").join(own, ["qid", "doc_id"], "left_anti").join(have, "qid", "left")
    order = F.row_number().over(Window.partitionBy("qid").orderBy(F.md5(F.concat_ws("|", qid, doc)), "doc_id"))
    padding = others.withColumn("r", order).where(F.col("r") <= size - F.coalesce("n", F.lit(0))).select("qid", "doc_id", F.lit(True).alias("padded"))
    return own.withColumn("padded", F.lit(False)).unionByName(padding)


def agreement(lists: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """One row per query of (op, qid, doc_id, rank): documents in all and in any operator's top k, their ratio, the best and worst gold rank."""
    ops = lists.select(F.count_distinct("op").alias("n_ops"))
    top = lists.where(F.col("rank") <= k).groupBy("qid", "doc_id").agg(F.count_distinct("op").alias("in_ops")).crossJoin(ops)
    shared = top.groupBy("qid").agg(F.count_if(F.col("in_ops") == F.col("n_ops")).alias("n_all"), F.count("*").alias("n_any"))
    ranks = lists.join(gold.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi").groupBy("qid", "op").agg(F.min("rank").alias("first")).groupBy("qid").agg(F.min("first").alias("best"), F.max("first").alias("worst"))
    return shared.join(ranks, "qid", "left").select("qid", "n_all", "n_any", (F.col("n_all") / F.col("n_any")).alias("ratio"), "best", "worst", F.coalesce(F.col("best") != F.col("worst"), F.lit(False)).alias("differs"))
