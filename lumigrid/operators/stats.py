"""Statistics of score lists: rank correlations, AUC, transforms, margins, multiple tests. Pairs stay within a query's list."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def _q() -> WindowSpec:
    """The rows of a query."""
    return Window.partitionBy("qid")


def side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """(qid, doc_id, a, b) of the documents in both lists."""
    return a.select("qid", "doc_id", F.col("score").alias("a")).join(b.select("qid", "doc_id", F.col("score").alias("b")), ["qid", "doc_id"])


def kendall(both: DataFrame) -> DataFrame:
    """tau = (c - d) / (c + d) without ties, concordance c / (c + d + t) and agreement of signs, for each query's list."""
    x, y = both.alias("x"), both.alias("y")
    pairs = x.join(y, (F.col("x.qid") == F.col("y.qid")) & (F.col("x.doc_id") < F.col("y.doc_id"))).select(F.col("x.qid").alias("qid"), F.signum(F.col("x.a") - F.col("y.a")).alias("sa"), F.signum(F.col("x.b") - F.col("y.b")).alias("sb"))
    s = F.col("sa") * F.col("sb")
    agg = pairs.groupBy("qid").agg(F.count_if(s > 0).alias("c"), F.count_if(s < 0).alias("d"), F.count_if(s == 0).alias("t"), F.count_if(F.col("sa") == F.col("sb")).alias("same"))
    return agg.select("qid", "c", "d", "t", F.when(F.col("c") + F.col("d") > 0, (F.col("c") - F.col("d")) / (F.col("c") + F.col("d"))).otherwise(1.0).alias("tau"), (F.col("c") / (F.col("c") + F.col("d") + F.col("t"))).alias("concordance"), (F.col("same") / (F.col("c") + F.col("d") + F.col("t"))).alias("sign_agreement"))


def average_rank(c: str) -> Column:
    """Ranks with ties averaged, in ascending order."""
    w = _q().orderBy(c)
    ties = F.count("*").over(Window.partitionBy("qid", c))
    return F.rank().over(w) + (ties - 1) / 2.0


def spearman(both: DataFrame) -> DataFrame:
    """Spearman's rho of each query's list, with average ranks; null below three and where a side's ranks are all equal.

    Twice a rank is a whole number, so the sums are exact and a constant side has a spread of exactly 0; corr divides by
    it, which is an error in ANSI mode.
    """
    r = both.select("qid", (2 * average_rank("a")).cast("decimal(38, 0)").alias("ra"), (2 * average_rank("b")).cast("decimal(38, 0)").alias("rb"))
    a, b, n = F.col("ra"), F.col("rb"), F.col("n")
    s = r.groupBy("qid").agg(F.count("*").alias("n"), F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(a * a).alias("saa"), F.sum(b * b).alias("sbb"), F.sum(a * b).alias("sab"))
    spread = lambda x, y: (n * F.col(f"s{x}{y}") - F.col(f"s{x}") * F.col(f"s{y}")).cast("double")
    rho = F.try_divide(spread("a", "b"), F.sqrt(spread("a", "a")) * F.sqrt(spread("b", "b")))
    return s.select("qid", "n", F.when(n >= 3, rho).alias("rho"))


def auc(scored: DataFrame, by: str | None = None) -> DataFrame:
    """AUC of (score, label): pairs won by positives, with ties lost (auc_ref) and halved (auc), from ranks, not pairs."""
    keys = [by] if by else []
    w = Window.partitionBy(*keys).orderBy("score")
    # Negatives below each positive: a running count over distinct scores.
    levels = scored.groupBy(*keys, "score").agg(F.count_if(F.col("label") == 0).alias("neg"), F.count_if(F.col("label") == 1).alias("pos"))
    below = levels.withColumn("below", F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    agg = below.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * F.col("below")).alias("wins"), F.sum(F.col("pos") * F.col("neg")).alias("ties"))
    total = F.col("n_pos") * F.col("n_neg")
    return agg.select(*keys, "n_pos", "n_neg", F.when(total > 0, F.col("wins") / total).alias("auc_ref"), F.when(total > 0, (F.col("wins") + 0.5 * F.col("ties")) / total).alias("auc"))


def transforms(signal: DataFrame) -> DataFrame:
    """(transform, qid, doc_id, score): the rank-preserving score transforms."""
    s = F.col("score")
    n = F.count("*").over(_q())
    dense = F.dense_rank().over(_q().orderBy(s)) - 1
    row = F.row_number().over(_q().orderBy(F.desc("score"), "doc_id"))
    made = {"orig": s, "x2": 2 * s, "log1p": F.log1p(F.greatest(s, F.lit(0.0))), "sqrt": F.sqrt(F.greatest(s, F.lit(0.0))), "rpr": (n - row + 1).cast("double"), "compress": F.when(n > 1, 1 + 0.001 * dense / (n - 1)).otherwise(1.0), "amplify": F.pow(s, 4), "rank_norm": F.when(n > 1, (n - row) / (n - 1)).otherwise(1.0)}
    return signal.select("qid", "doc_id", *[v.alias(k) for k, v in made.items()]).select("qid", "doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("transform"), F.col(k).alias("score")) for k in made])).alias("x")).select("x.transform", "qid", "doc_id", "x.score")


def inverse_normal(p: Column) -> Column:
    """The normal quantile by Acklam's rational approximation (fixed coefficients), in the JVM."""
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)

    def poly(k: tuple, x: Column) -> Column:
        out = F.lit(k[0])
        for v in k[1:]:
            out = out * x + v
        return out

    q, r = p - 0.5, (p - 0.5) * (p - 0.5)
    tail = lambda u: poly(c, F.sqrt(-2 * F.log(u))) / poly((*d, 1.0), F.sqrt(-2 * F.log(u)))
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(poly(a, r) * q / poly((*b, 1.0), r))


def calibrated(signal: DataFrame) -> DataFrame:
    """(method, qid, doc_id, score): raw, minmax, zscore, l2, rank_gauss, sigmoid, quantile and softmax scores of each list."""
    s, n = F.col("score"), F.count("*").over(_q())
    low, high, mean, sd = F.min(s).over(_q()), F.max(s).over(_q()), F.avg(s).over(_q()), F.stddev_pop(s).over(_q())
    row = F.row_number().over(_q().orderBy("score", F.desc("doc_id"))) - 1
    quart = lambda p: F.percentile(s, p).over(_q())
    wide = signal.select(
        "qid", "doc_id", s.alias("raw"), F.when(high > low, (s - low) / (high - low)).otherwise(0.0).alias("minmax"), F.when(sd > 0, (s - mean) / sd).otherwise(0.0).alias("zscore"),
        F.coalesce(F.try_divide(s, F.sqrt(F.sum(s * s).over(_q()))), F.lit(0.0)).alias("l2"), ((row + 0.5) / n).alias("quantile"), (1 / (1 + F.exp(-(s - quart(0.5)) / F.greatest(quart(0.75) - quart(0.25), F.lit(1e-9))))).alias("sigmoid"), F.exp((s - high) / F.greatest(sd, F.lit(1e-9))).alias("e"),
    )
    wide = wide.withColumn("softmax", F.col("e") / F.sum("e").over(_q())).withColumn("rank_gauss", inverse_normal(F.col("quantile")))
    names = ("raw", "minmax", "zscore", "l2", "quantile", "sigmoid", "softmax", "rank_gauss")
    return wide.select("qid", "doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("method"), F.col(k).alias("score")) for k in names])).alias("x")).select("x.method", "qid", "doc_id", "x.score")


def margins(signal: DataFrame, gold: DataFrame) -> DataFrame:
    """Best gold less best other score over the largest absolute one, with its bin, for each query that has both."""
    labelled = signal.join(gold.select("qid", "doc_id").distinct().withColumn("g", F.lit(1)), ["qid", "doc_id"], "left")
    agg = labelled.groupBy("qid").agg(F.max(F.when(F.col("g") == 1, F.col("score"))).alias("best_gold"), F.max(F.when(F.col("g").isNull(), F.col("score"))).alias("best_other"), F.max(F.abs("score")).alias("most"))
    m = (F.col("best_gold") - F.col("best_other")) / F.col("most")
    return agg.where("best_gold is not null and best_other is not null and most > 0").select("qid", m.alias("margin"), F.when(m < 0, "lost").when(m < 0.05, "narrow").when(m < 0.2, "clear").otherwise("wide").alias("bin"))


def win_loss(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """One row: wins, ties and losses of operator a against b on (op, qid, mrr, found_at), effect size and queries for power 0.8."""
    x, y = (metrics.where(F.col("op") == o).select("qid", F.col("mrr").alias(f"m{i}"), F.col("found_at").alias(f"f{i}")) for i, o in ((1, a), (2, b)))
    d = F.col("m1") - F.col("m2")
    agg = x.join(y, "qid").agg(F.count("*").alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), F.count_if((F.coalesce("f1", F.lit(0)) == 1) != (F.coalesce("f2", F.lit(0)) == 1)).alias("first_changed"), F.try_divide(F.avg(d), F.stddev_samp(d)).alias("dz"))
    return agg.withColumn("n_for_power", F.when(F.col("dz") != 0, F.ceil(F.pow(F.try_divide(F.lit(2.8), F.col("dz")), 2))))


def holm(tests: DataFrame, by: str, p: str = "p") -> DataFrame:
    """Holm's step-down adjusted p values of (by, name, p)."""
    w = Window.partitionBy(by).orderBy(p, "name")
    raised = tests.withColumn("step", F.least(F.lit(1.0), F.col(p) * (F.count("*").over(Window.partitionBy(by)) - F.row_number().over(w) + 1)))
    return raised.withColumn("adjusted", F.max("step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def set_differences(lists: DataFrame, a: str, b: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: the share of queries whose top-k sets differ between two operators of (op, qid, doc_id, rank)."""
    tops = [F.array_sort(F.collect_list(F.when((F.col("op") == o) & (F.col("rank") <= k), F.col("doc_id")))).alias(f"{o}_{k}") for o in (a, b) for k in ks]
    per = lists.where(F.col("op").isin(a, b)).groupBy("qid").agg(*tops)
    return per.agg(F.count("*").alias("n"), *[F.avg((F.col(f"{a}_{k}") != F.col(f"{b}_{k}")).cast("double")).alias(f"differ_{k}") for k in ks])


def rank_gaps(signal: DataFrame, gold: DataFrame) -> DataFrame:
    """Mean gold and other score by bucket of rank."""
    r = signal.withColumn("rank", F.row_number().over(_q().orderBy(F.desc("score"), "doc_id"))).where("rank <= 10")
    bucket = F.when(F.col("rank") == 1, "1").when(F.col("rank") <= 3, "2-3").when(F.col("rank") <= 5, "4-5").otherwise("6-10")
    labelled = r.join(gold.select("qid", "doc_id").distinct().withColumn("g", F.lit(1)), ["qid", "doc_id"], "left")
    return labelled.groupBy(bucket.alias("bucket")).agg(F.count_if(F.col("g") == 1).alias("n_gold"), F.count_if(F.col("g").isNull()).alias("n_other"), F.avg(F.when(F.col("g") == 1, F.col("score"))).alias("gold_mean"), F.avg(F.when(F.col("g").isNull(), F.col("score"))).alias("other_mean"))


def rank_lags(signal: DataFrame) -> DataFrame:
    """Rank, percent rank and the margin to the rank before, for each document of each list."""
    w = _q().orderBy(F.desc("score"), "doc_id")
    return signal.select("qid", "doc_id", F.row_number().over(w).alias("rank"), F.percent_rank().over(_q().orderBy(F.desc("score"))).alias("pct"), (F.lag("score").over(w) - F.col("score")).alias("lag_margin"))


def concentration(deltas: DataFrame) -> DataFrame:
    """One row: the share of the absolute change that the top tenth and fifth of queries (qid, delta) hold."""
    w = Window.orderBy(F.desc(F.abs("delta")), "qid")
    whole = Window.partitionBy()
    r = deltas.withColumn("at", F.row_number().over(w)).withColumn("n", F.count("*").over(whole))
    size = F.abs("delta")
    part = lambda p: F.try_divide(F.sum(F.when(F.col("at") <= F.ceil(F.col("n") * p), size).otherwise(0.0)), F.sum(size))
    return r.agg(F.max("n").alias("n"), part(0.1).alias("top_10"), part(0.2).alias("top_20"))


def geometry(signal: DataFrame) -> DataFrame:
    """Gaps and spread of each query's list: first to second, first to fifth, deviation, list length."""
    w = _q().orderBy(F.desc("score"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return signal.select("qid", F.nth_value("score", 1).over(w).alias("s1"), F.nth_value("score", 2).over(w).alias("s2"), F.nth_value("score", 5).over(w).alias("s5"), "score").groupBy("qid").agg((F.max("s1") - F.max("s2")).alias("d12"), (F.max("s1") - F.max("s5")).alias("d15"), F.stddev_pop("score").alias("sd"), F.count("*").alias("n"))


def _described(signal: DataFrame, gold: DataFrame, name: str) -> DataFrame:
    """Of each query's list: its top scores, spread, sum, and the score and rank of its gold document (the least id)."""
    one = gold.groupBy("qid").agg(F.min("doc_id").alias("g"))
    ranked = signal.withColumn("rank", F.row_number().over(_q().orderBy(F.desc("score"), "doc_id"))).join(one, "qid", "left")
    top = lambda k: F.max(F.when(F.col("rank") == k, F.col("score")))
    own = F.col("doc_id") == F.col("g")
    agg = {
        "n": F.count("*"), "s1": top(1), "s2": top(2), "s3": top(3), "s5": top(5), "sigma": F.stddev_pop("score"), "total": F.sum("score"), "most": F.max(F.abs("score")),
        "gold": F.max(F.when(own, F.col("score"))), "gold_rank": F.max(F.when(own, F.col("rank"))), "other": F.max(F.when(~own, F.col("score"))),
    }
    return ranked.groupBy("qid").agg(*[v.alias(f"{name}_{k}") for k, v in agg.items()])


def pair_geometry(a: DataFrame, b: DataFrame, gold: DataFrame) -> DataFrame:
    """The 16 geometry features of each query's two lists: gaps, deviations, their tau, top mass, and the gold document's ranks and margins.

    Features of a document that a list lacks are 0, its ranks null.
    """
    both = _described(a, gold, "a").join(_described(b, gold, "b"), "qid").join(kendall(side_by_side(a, b)).select("qid", "tau"), "qid", "left")
    zero = F.lit(0.0)
    gap = lambda s, x, y: F.coalesce(F.col(f"{s}_{x}") - F.col(f"{s}_{y}"), zero)
    held = F.col("a_gold").isNotNull() & F.col("b_gold").isNotNull()
    joint = lambda s: F.coalesce((F.col(f"{s}_gold") - F.coalesce(F.col(f"{s}_other"), zero)) / F.when(F.col(f"{s}_most") > 0, F.col(f"{s}_most")).otherwise(1.0), zero)
    total = F.col("a_total") + F.col("b_total")
    out = {
        **{f"{s}_d12": gap(s, "s1", "s2") for s in "ab"}, **{f"{s}_d15": gap(s, "s1", "s5") for s in "ab"}, **{f"{s}_sigma": F.col(f"{s}_sigma") for s in "ab"},
        "tau": F.coalesce("tau", F.lit(1.0)), "kappa": F.when(total > 0, (F.col("a_s1") + F.col("b_s1")) / total).otherwise(0.0), "cross_gold_margin": F.when(held, F.col("a_gold") - F.col("b_gold")).otherwise(0.0),
        **{f"gold_rank_{s}": F.when(held, F.col(f"{s}_gold_rank")) for s in "ab"}, **{f"gold_d1{k}_{s}": gap(s, "gold", f"s{k}") for s in "ab" for k in (3, 5)}, "joint_margin": 0.5 * (joint("a") + joint("b")),
    }
    return both.select("qid", *[v.alias(k) for k, v in out.items()])


def complementarity(a: DataFrame, b: DataFrame, gold: DataFrame, depth: int = 60, missing: int = 999) -> DataFrame:
    """Per query: tau-b of both ranks over the union of their top documents (a document that a list lacks has the rank `missing`), both MRRs, top-3 overlap, whether the first documents differ, and the gap of the gold document's ranks."""
    rank = lambda s, n: s.select("qid", "doc_id", F.row_number().over(_q().orderBy(F.desc("score"), "doc_id")).alias(n))
    joined = rank(a, "ra").join(rank(b, "rb"), ["qid", "doc_id"], "full")
    known = joined.where(f"ra <= {depth} or rb <= {depth}").select("qid", "doc_id", F.coalesce("ra", F.lit(missing)).alias("ra"), F.coalesce("rb", F.lit(missing)).alias("rb"))
    x, y = known.alias("x"), known.alias("y")
    sides = x.join(y, (F.col("x.qid") == F.col("y.qid")) & (F.col("x.doc_id") < F.col("y.doc_id"))).select(F.col("x.qid").alias("qid"), F.signum(F.col("x.ra") - F.col("y.ra")).alias("u"), F.signum(F.col("x.rb") - F.col("y.rb")).alias("v"))
    tau = sides.groupBy("qid").agg((F.sum(F.col("u") * F.col("v")) / F.nullif(F.sqrt(F.count_if(F.col("u") != 0) * F.count_if(F.col("v") != 0)), F.lit(0.0))).alias("tau"))
    gold_one = gold.groupBy("qid").agg(F.min("doc_id").alias("g"))
    marked = joined.join(gold.select("qid", "doc_id").distinct().withColumn("hit", F.lit(1)), ["qid", "doc_id"], "left").join(gold_one, "qid")
    of = lambda r: F.coalesce(1.0 / F.min(F.when(F.col("hit") == 1, F.col(r))), F.lit(0.0))
    first = lambda r: F.max(F.when(F.col(r) == 1, F.col("doc_id")))
    place = lambda r: F.coalesce(F.max(F.when(F.col("doc_id") == F.col("g"), F.col(r))), F.lit(missing))
    per = marked.groupBy("qid").agg(of("ra").alias("mrr_a"), of("rb").alias("mrr_b"), (F.count_if((F.col("ra") <= 3) & (F.col("rb") <= 3)) / 3).alias("top3_overlap"), F.coalesce(first("ra") != first("rb"), F.lit(False)).alias("first_differs"), F.abs(place("ra") - place("rb")).alias("gold_rank_gap"))
    return per.join(tau, "qid", "left")


def fusion_gain(metrics: DataFrame, singles: DataFrame) -> DataFrame:
    """(op, qid, gain): an operator's MRR (op, qid, mrr) less the better one of the two lists' (qid, mrr_a, mrr_b)."""
    return metrics.join(singles.select("qid", F.greatest("mrr_a", "mrr_b").alias("best")), "qid").select("op", "qid", (F.col("mrr") - F.col("best")).alias("gain"))


def wilcoxon(deltas: DataFrame, by: str) -> DataFrame:
    """Wilcoxon's signed ranks of (by, delta): the non-zero changes, their average ranks' sums by sign, and z with correction for ties.

    Ranks come from counts of equal sizes, so no group of rows is in one place.
    """
    sizes = deltas.where("delta != 0").groupBy(by, F.abs("delta").alias("size")).agg(F.count("*").alias("m"), F.count_if(F.col("delta") > 0).alias("up"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy(by).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("rank", before + (F.col("m") + 1) / 2.0)
    agg = ranked.groupBy(by).agg(F.sum("m").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("m") - F.col("up"))).alias("w_minus"), F.sum(F.pow("m", 3) - F.col("m")).alias("ties"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0)
    return agg.select(by, "n", "w_plus", "w_minus", ((F.least("w_plus", "w_minus") - n * (n + 1) / 4.0) / F.nullif(sd, F.lit(0.0))).alias("z"))


def query_type(rank_sum: Column, rank_rrf: Column) -> Column:
    """A: both first; B: only the sum; C: only rank fusion; D: neither."""
    return F.when((rank_sum == 1) & (rank_rrf == 1), "A").when(rank_sum == 1, "B").when(rank_rrf == 1, "C").otherwise("D")


def ols(rows: DataFrame, target: str, names: list[str]):
    """Least squares by normal equations that are summed in one pass; (coefficients with intercept first, R squared, t values)."""
    xs = [F.lit(1.0), *[F.col(n).cast("double") for n in names]]
    k, y = len(xs), F.col(target).cast("double")
    sums = rows.agg(F.count("*"), F.sum(y), F.sum(y * y), *[F.sum(xs[i] * xs[j]) for i in range(k) for j in range(i, k)], *[F.sum(x * y) for x in xs]).first()
    n, sy, syy = sums[0], sums[1], sums[2]
    xtx, it = np.zeros((k, k)), iter(sums[3:])
    for i in range(k):
        for j in range(i, k):
            xtx[i, j] = xtx[j, i] = next(it)
    xty = np.array([next(it) for _ in range(k)])
    inverse = np.linalg.pinv(xtx)
    beta = inverse @ xty
    rest = max(0.0, syy - beta @ xty)
    total = syy - sy * sy / n
    t = beta / np.sqrt(np.maximum(np.diag(inverse) * rest / max(1, n - k), 1e-300))
    return beta.tolist(), 1 - rest / total if total > 0 else 0.0, t.tolist()


def sign_flip(deltas: DataFrame, by: str, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """Two-sided sign-flip permutation p value, bootstrap interval and Cohen's d of (by, delta)."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d = np.sort(rows["delta"].to_numpy(float))
        random = np.random.RandomState(seed)
        flips = (random.randint(0, 2, (resamples, len(d))) * 2 - 1) @ d / len(d)
        p = (np.count_nonzero(np.abs(flips) >= abs(d.mean()) - 1e-12) + 1) / (resamples + 1)
        boots = np.sort(d[random.randint(0, len(d), (resamples, len(d)))].mean(axis=1))
        sd = d.std(ddof=1) if len(d) > 1 else 0.0
        return pd.DataFrame({by: [key[0]], "n": [len(d)], "mean": [d.mean()], "p": [p], "low": [boots[int(0.025 * resamples)]], "high": [boots[int(0.975 * resamples)]], "dz": [d.mean() / sd if sd > 0 else 0.0]})

    # One delta per query: a group is as large as the query set.
    return deltas.groupBy(by).applyInPandas(one, f"{by} {dict(deltas.dtypes)[by]}, n bigint, mean double, p double, low double, high double, dz double")
