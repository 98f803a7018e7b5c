"""BM25 over a whole set of queries in one plan: an inverted-index join on the terms the queries have."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

K1, B = 1.2, 0.75


def _texts(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return T.spread(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))


def term_counts(documents: DataFrame, id_col: str, text_col: str, long_only: bool = False) -> DataFrame:
    """(doc_id, term, tf)."""
    words = (T.long_tokens if long_only else T.tokens)(F.col("text"))
    return T.unfolded(_texts(documents, id_col, text_col), words, "term", "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def query_terms(documents: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", query_text: str = "text", long_only: bool = False) -> DataFrame:
    """(doc_id, len, term, tf) of the terms that some query has; len counts all words of the document.

    Rows are dealt out by document in a fixed number of partitions: what joins them with queries has many more rows than
    they, so they must not be merged into few tasks for their size, and sums by document need no second exchange.
    """
    words = T.long_tokens if long_only else T.tokens
    asked = queries.select(F.explode(words(F.col(query_text))).alias("term")).distinct()
    tokened = _texts(documents, id_col, text_col).select("doc_id", words(F.col("text")).alias("words")).select("doc_id", "words", F.size("words").alias("len"))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = T.unfolded(tokened, F.col("words"), "term", "doc_id", "len").join(asked, "term", "left_semi")
    return found.repartition(parts, "doc_id").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))


def scores(documents: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", distinct_terms: bool = False, long_only: bool = False, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc_id, score) of the documents that share a term with a query.

    Repeated query terms count as often as they occur, unless distinct_terms. Only terms of the queries are exploded
    into the join; their counts and the lengths of all documents each read the documents once.
    """
    words = T.long_tokens if long_only else T.tokens
    q = queries.select(F.col(query_id).alias("qid"), F.explode(words(F.col(query_text))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qn"))
    corpus = _texts(documents, id_col, text_col).agg(F.count("*").alias("n"), F.avg(F.greatest(F.size(words(F.col("text"))), F.lit(0))).alias("avg_len"))
    tf = query_terms(documents, queries, id_col=id_col, text_col=text_col, query_text=query_text, long_only=long_only)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weighed = q.join(df, "term").crossJoin(corpus).select("qid", "term", "avg_len", ((F.lit(1) if distinct_terms else F.col("qn")) * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return tf.join(T.held(weighed, queries), "term").groupBy("qid", "doc_id").agg(F.sum(part).alias("score"))
