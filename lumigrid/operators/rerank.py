"""Re-ranking: negation, TF-IDF mixing, pair features, learning to rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as T
from . import pairs, similarity

BLOCKS, BLOCK = 16, 256


def negation_factor(text: Column, negated: Column, cues: Column, penalty: float = 0.5, boost: float = 0.3, reach: int = 50) -> Column:
    """The factor of a document's score for the negated words and cues (arrays) of a question (`text.negation`).

    Of words that the text has, one counts as negated there if a cue begins up to `reach` characters before the
    word's first place: then the score is boosted, and cut if a word is only present. No words or no text: 1.
    """
    low = F.lower(text)

    def denied(word: Column) -> Column:
        at = F.instr(low, word)
        start = F.greatest(at - reach, F.lit(1))
        return F.exists(cues, lambda cue: F.substring(low, start, at - start + F.length(cue) - 1).contains(cue))

    here = F.filter(negated, lambda w: (w != "") & (F.instr(low, w) > 0))
    return F.when(low.isNull() | (F.size(here) <= 0), 1.0).when(F.exists(here, denied), 1 + boost).otherwise(1 - penalty)


def tfidf_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tfidf): the sum over a document's own terms of tf * (ln((N + 1) / (df + 1)) + 1)."""
    tf = documents.select(F.col(id_col).alias("doc_id"), F.explode(T.space_tokens(F.col(text_col))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = documents.agg(F.count("*").alias("n"))
    return tf.join(df, "term").crossJoin(n).groupBy("doc_id").agg(F.sum(F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("tfidf"))


def tfidf_mixed(ranking: DataFrame, tfidf: DataFrame, alpha: float = 0.3) -> DataFrame:
    """(qid, doc_id, score): alpha * score / max + (1 - alpha) * tfidf / max within each query."""
    q = Window.partitionBy("qid")
    joined = ranking.join(tfidf, "doc_id", "left").withColumn("tfidf", F.coalesce("tfidf", F.lit(0.0)))
    share = lambda c: F.when(F.max(c).over(q) > 0, F.col(c) / F.max(c).over(q)).otherwise(0.0)
    return joined.select("qid", "doc_id", (alpha * share("score") + (1 - alpha) * share("tfidf")).alias("score"))


def pair_features(queries: DataFrame, documents: DataFrame, cells: int, block: int = BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """Set features of pairs that share an active cell: 17 scalars and the Jaccard of each of the first blocks of cells."""
    joined = pairs.pairs(queries, documents, block=block, blocks=blocks)
    i, qn, dn = F.col("both"), F.col("qn"), F.col("dn")
    union = qn + dn - i
    per_block = [F.when(F.col(f"qb{b}") + F.col(f"db{b}") - F.col(f"b{b}") > 0, F.col(f"b{b}") / (F.col(f"qb{b}") + F.col(f"db{b}") - F.col(f"b{b}"))).otherwise(0.0).alias(f"block_{b}") for b in range(blocks)]
    return joined.select(
        "qid", "doc_id", (i / union).alias("jaccard"), (2 * i / (qn + dn)).alias("dice"), (i / F.least(qn, dn)).alias("overlap"), (1 - (union - i) / cells).alias("hamming_norm"), (F.col("dot") / F.sqrt(F.col("qss") * F.col("dss"))).alias("cosine"),
        (i / qn).alias("containment"), (i / dn).alias("coverage"), qn.alias("popcount_q"), dn.alias("popcount_d"), (qn / cells).alias("density_q"), (dn / cells).alias("density_d"), i.alias("n_and"), union.alias("n_or"), (qn - i).alias("n_q_only"), (dn - i).alias("n_d_only"), *per_block,
    )


def with_text_features(features: DataFrame, idf: DataFrame, bm25: DataFrame, queries: DataFrame, documents: DataFrame) -> DataFrame:
    """pair_features with idf_weighted (containment where unknown), bm25, query_len and doc_len."""
    lengths = lambda t, i, c: t.select(F.col(t.columns[0]).alias(i), F.size(T.tokens(F.col(t.columns[1]))).alias(c))
    out = features.join(idf.select("qid", "doc_id", F.col("score").alias("idf")), ["qid", "doc_id"], "left").join(bm25.select("qid", "doc_id", F.col("score").alias("bm25")), ["qid", "doc_id"], "left")
    out = out.join(lengths(queries, "qid", "query_len"), "qid", "left").join(lengths(documents, "doc_id", "doc_len"), "doc_id", "left")
    return out.withColumn("idf_weighted", F.coalesce("idf", "containment")).withColumn("bm25", F.coalesce("bm25", F.lit(0.0))).drop("idf")


def held_out(qid: str, shares: int) -> Column:
    """One in `shares` queries, by its id."""
    return F.pmod(F.crc32(F.col(qid).cast("string").cast("binary")), F.lit(shares)) == 0


def training_set(features: DataFrame, gold: DataFrame, shares: int = 5) -> DataFrame:
    """Features with label (in gold) and a split by query: one in `shares` queries is held out."""
    labelled = features.join(gold.select("qid", "doc_id").distinct().withColumn("label", F.lit(1)), ["qid", "doc_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    return labelled.withColumn("held_out", held_out("qid", shares))


def train_ranker(rows: DataFrame, names: list[str], seed: int = 42):
    """A pointwise gradient-boosted ranker of the training rows (a stand-in for a listwise one)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    return GBTRegressor(featuresCol="features", labelCol="label", maxIter=20, maxDepth=4, seed=seed).fit(ready)


def rerank(model, rows: DataFrame, names: list[str], most: int = 10) -> DataFrame:
    """(qid, doc_id, score, rerank_rank) by a ranker's prediction."""
    from pyspark.ml.feature import VectorAssembler

    scored = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rows)).select("qid", "doc_id", F.col("prediction").alias("score"))
    return similarity.top(scored, "qid", "score", "doc_id", most).withColumnRenamed("rank", "rerank_rank")
