"""Rank and score fusion of two signals (qid, doc_id, score): windows per query and one full outer join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def _q() -> WindowSpec:
    """The rows of a query."""
    return Window.partitionBy("qid")


def ranks(signal: DataFrame) -> DataFrame:
    """The signal with its rank (by score, then doc_id) and the length of its list."""
    return signal.withColumn("rank", F.row_number().over(_q().orderBy(F.desc("score"), "doc_id"))).withColumn("n", F.count("*").over(_q()))


def normaliser(how: str) -> Column:
    """A score normalised within its query's list: none, max (min-max, constant lists 1), minmax (constant lists 0), zscore, l2."""
    s = F.col("score")
    low, high = F.min(s).over(_q()), F.max(s).over(_q())
    if how == "none":
        return s
    if how in ("max", "minmax"):
        return F.when(high == low, 1.0 if how == "max" else 0.0).otherwise((s - low) / (high - low))
    if how == "zscore":
        sd = F.stddev_pop(s).over(_q())
        return F.when(sd > 0, (s - F.avg(s).over(_q())) / sd).otherwise(0.0)
    if how == "l2":
        norm = F.sqrt(F.sum(s * s).over(_q()))
        return F.when(norm > 0, s / norm).otherwise(0.0)
    raise ValueError(f"unknown normalisation {how}")


def _joined(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both lists of each query side by side, with ranks, lengths and normalised scores; a missing rank is length + 1."""
    sides = []
    for name, signal in (("a", a), ("b", b)):
        whole = ranks(signal)
        for how in ("max", "minmax", "zscore", "l2"):
            whole = whole.withColumn(how, normaliser(how))
        sides.append(whole.select("qid", "doc_id", *[F.col(c).alias(f"{name}_{c}") for c in ("score", "rank", "n", "max", "minmax", "zscore", "l2")]))
    out = sides[0].join(sides[1], ["qid", "doc_id"], "full")
    for s in "ab":
        out = out.withColumn(f"{s}_n", F.coalesce(F.max(f"{s}_n").over(_q()), F.lit(0))).withColumn(f"{s}_rank", F.coalesce(f"{s}_rank", F.col(f"{s}_n") + 1))
    return out


def _score(side: str, how: str) -> Column:
    return F.coalesce(F.col(f"{side}_{how}"), F.lit(0.0))


def rrf(k: int = 60) -> Column:
    """Reciprocal-rank fusion."""
    return 1.0 / (k + F.col("a_rank")) + 1.0 / (k + F.col("b_rank"))


def borda() -> Column:
    """Borda counts over the longer list's length."""
    n = F.greatest("a_n", "b_n")
    points = lambda s: F.when(F.col(f"{s}_score").isNull(), 0).otherwise(n - F.col(f"{s}_rank") + 1)
    return (points("a") + points("b")).cast("double")


def combsum() -> Column:
    """Sum of scores."""
    return _score("a", "score") + _score("b", "score")


def combmnz() -> Column:
    """Sum of scores times the number of lists."""
    return combsum() * (F.col("a_score").isNotNull().cast("int") + F.col("b_score").isNotNull().cast("int"))


def weighted(how: str, alpha: float = 0.3) -> Column:
    """alpha of the first and 1 - alpha of the second normalised score."""
    return alpha * _score("a", how) + (1 - alpha) * _score("b", how)


OPERATORS: dict[str, Callable[[], Column]] = {
    "rrf": rrf, "borda": borda, "combsum": combsum, "combmnz": combmnz,
    "linear": lambda: weighted("max"), "minmax": lambda: weighted("minmax"), "zscore": lambda: weighted("zscore"), "l2": lambda: weighted("l2"),
}


def operator(name: str) -> Column:
    """The column of a fusion operator; an unknown name is an error."""
    if name not in OPERATORS:
        raise ValueError(f"unknown fusion operator {name}; known: {sorted(OPERATORS)}")
    return OPERATORS[name]()


def fused(a: DataFrame, b: DataFrame, name: str = "rrf", most: int | None = None) -> DataFrame:
    """(qid, doc_id, score, rank) of two signals; the `most` best of each query if asked for."""
    out = _joined(a, b).select("qid", "doc_id", operator(name).alias("score"))
    out = out.withColumn("rank", F.row_number().over(_q().orderBy(F.desc(F.round("score", 9)), "doc_id")))
    return out.where(F.col("rank") <= most) if most else out


def all_fused(a: DataFrame, b: DataFrame, names: tuple[str, ...] = tuple(OPERATORS)) -> DataFrame:
    """(op, qid, doc_id, score) of several operators from one join."""
    joined = _joined(a, b)
    return joined.select("qid", "doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("op"), operator(n).alias("score")) for n in names])).alias("x")).select("x.op", "qid", "doc_id", "x.score")


def multi_rrf(lists: DataFrame, k: int = 60) -> DataFrame:
    """(qid, doc_id, score) of the lists (qid, list, doc_id, score) of each query; absence adds nothing."""
    rank = F.row_number().over(Window.partitionBy("qid", "list").orderBy(F.desc("score"), "doc_id"))
    return lists.withColumn("rank", rank).groupBy("qid", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
