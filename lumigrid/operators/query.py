"""The query side: pseudo-fingerprints, out-of-vocabulary expansion, query fingerprints, glossaries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import grid, text as T
from . import fingerprints as fp, pairs, similarity


def char_ngrams(word: Column, high: int = 3) -> Column:
    """Character n-grams of 1 to high."""

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))
        return F.when(F.length(word) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(1, high + 1)])


def hash_cell(prefix: str, gram: Column, cells: int) -> Column:
    """md5 of prefix and gram modulo a power of two, from its low hexadecimal digits."""
    return F.pmod(F.conv(F.right(F.md5(F.concat(F.lit(prefix), gram)), F.lit(8)), 16, 10).cast("bigint"), F.lit(cells))


def pseudo_fingerprints(words: DataFrame, size: int) -> DataFrame:
    """(id = word, cell, val): each character n-gram adds one at two hashed cells."""
    cells = grid.check_size(size) ** 2
    grams = words.select(F.col("word").alias("id"), F.explode(char_ngrams(F.col("word"))).alias("g"))
    placed = grams.select("id", F.explode(F.array(hash_cell("A", F.col("g"), cells), hash_cell("B", F.col("g"), cells))).alias("cell"))
    return placed.groupBy("id", "cell").agg(F.count("*").cast("double").alias("val"))


def expanded(terms: DataFrame, phrase_fps: DataFrame, size: int, most: int = 5, least: float = 0.2, known: DataFrame | None = None) -> DataFrame:
    """(term, phrase, similarity): vocabulary phrases near each out-of-vocabulary term.

    A term's anchor is the sum of the fingerprints of its words in the vocabulary (at least one, or half of several),
    else its pseudo-fingerprint. The terms are a stated set: their anchors are held against the phrases block by block.
    A term's own words are not its expansion. phrase_fps is (id, cell, val), or packed as (id, cells, vals); `known` is the
    prints of the terms' words as (id, cell, val), if they are at hand.
    """
    words = terms.select("term", F.split("term", " ").alias("w"))
    parts = words.select("term", F.size("w").alias("n"), F.explode("w").alias("id"))
    if known is None:
        long = phrase_fps.select("id", F.explode(F.arrays_zip("cells", "vals")).alias("f")).select("id", F.col("f.cells").alias("cell"), F.col("f.vals").alias("val")) if "cells" in phrase_fps.columns else phrase_fps
        known = long.join(parts.select("id").distinct(), "id", "left_semi")
    found = parts.join(known.select("id").distinct(), "id", "left_semi")
    enough = found.groupBy("term", "n").agg(F.count_distinct("id").alias("k")).where(F.col("k") >= F.when(F.col("n") == 1, 1).otherwise(F.greatest(F.lit(2), F.floor(F.col("n") / 2))))
    anchored = found.join(enough.select("term"), "term", "left_semi").join(known, "id").groupBy(F.col("term").alias("id"), "cell").agg(F.sum("val").alias("val"))
    rest = terms.join(enough.select("term"), "term", "left_anti").select(F.col("term").alias("word"))
    anchors = anchored.unionByName(pseudo_fingerprints(rest, size))

    def cosines(d: pairs.Side, q: pairs.Side, dots: np.ndarray) -> np.ndarray:
        norm = np.sqrt(d.sums(d.val * d.val))[:, None] * np.sqrt(q.sums(q.val * q.val))[None, :]
        return np.divide(dots, norm, out=np.full(dots.shape, -np.inf), where=norm > 0)

    # A term's own phrases are left out behind the search, so that many more are kept.
    own = parts.select("term", F.col("id").alias("phrase")).union(terms.select("term", F.col("term").alias("phrase"))).distinct()
    spare = own.groupBy("term").count().agg(F.max("count")).first()[0] or 0
    scored = pairs.best(anchors, phrase_fps, most + spare, cosines, 9, least=least - 1e-8).select(F.col("qid").alias("term"), F.col("doc_id").alias("phrase"), F.round("score", 9).alias("similarity"))
    kept = scored.where(F.col("similarity") >= least).join(own, ["term", "phrase"], "left_anti")
    return similarity.top(kept, "term", "similarity", "phrase", most).drop("rank")


def merged_weights(direct: DataFrame, expansions: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """(qid, phrase, weight): direct phrases weigh their idf, expansions idf * similarity ** 2 * 0.6; the larger wins."""
    every = direct.select("qid", "phrase", F.lit(1.0).alias("s")).unionByName(expansions.select("qid", "phrase", (F.pow("similarity", 2) * 0.6).alias("s")))
    if idf is not None:
        every = every.join(idf.select("phrase", "idf"), "phrase", "left").withColumn("s", F.col("s") * F.coalesce("idf", F.lit(1.0)))
    return every.groupBy("qid", "phrase").agg(F.greatest(F.max("s"), F.lit(0.0)).alias("weight"))


def query_fingerprints(query_phrases: DataFrame, phrase_fps: DataFrame, idf: DataFrame | None = None, how: str = "uniform", normalisation: str = "l2") -> DataFrame:
    """(id = qid, cell, val) of (qid, phrase, downweight) rows: uniform, frequency or idf weights."""
    counted = query_phrases.groupBy("qid", "phrase").agg(F.count("*").alias("tf"), F.min("downweight").alias("down"))
    weight = {"uniform": F.lit(1.0), "frequency": F.col("tf").cast("double"), "idf": F.col("tf") * F.coalesce("idf", F.lit(1.0))}[how]
    counted = counted.join(idf.select("phrase", "idf"), "phrase", "left") if idf is not None else counted.withColumn("idf", F.lit(1.0))
    summed = counted.withColumn("w", weight * F.col("down")).join(phrase_fps.withColumnRenamed("id", "phrase"), "phrase").groupBy(F.col("qid").alias("id"), "cell").agg(F.sum(F.col("w") * F.col("val")).alias("val"))
    return summed if normalisation == "none" else fp.normalised(summed, normalisation)


def spreading_steps(words: Column, steps: Column) -> Column:
    """Adaptive spreading: at most 5 words at least 3 steps, 10 at least 2, 20 at most 2, longer at most 1."""
    return F.when(words <= 5, F.greatest(steps, F.lit(3))).when(words <= 10, F.greatest(steps, F.lit(2))).when(words <= 20, F.least(steps, F.lit(2))).otherwise(F.least(steps, F.lit(1)))


def glossary_expanded(queries: DataFrame, glossary: DataFrame, most: int = 3) -> DataFrame:
    """(qid, text, expanded, added): up to `most` synonyms of the canonical terms that a query has, appended.

    glossary is (canonical, synonym); it is held against the stated query set.
    """
    found = queries.join(glossary.select("canonical").distinct(), T.has_phrase(F.col("text"), F.col("canonical"))).join(glossary, "canonical")
    fresh = found.where(~T.has_phrase(F.col("text"), F.col("synonym"))).select("qid", "canonical", "synonym").distinct()
    ranked = fresh.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("canonical", "synonym"))).where(F.col("r") <= most)
    added = ranked.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "synonym"))), lambda x: x["synonym"]).alias("added"))
    return queries.join(added, "qid", "left").select("qid", "text", F.concat_ws(" ", "text", F.array_join("added", " ")).alias("joined"), "added").select("qid", "text", F.trim("joined").alias("expanded"), F.coalesce("added", F.array().cast("array<string>")).alias("added"))


def canonical(words: DataFrame, glossary: DataFrame) -> DataFrame:
    """(word, canonical, weight): synonyms by their canonical term and weight; canonical terms stay, others weigh 1."""
    own = glossary.select("canonical").distinct().withColumnRenamed("canonical", "word").withColumn("is_canonical", F.lit(True))
    of = glossary.groupBy(F.col("synonym").alias("word")).agg(F.max(F.struct("canonical", "weight")).alias("x"))
    joined = words.join(own, "word", "left").join(of, "word", "left")
    plain = F.col("is_canonical").isNotNull() | F.col("x").isNull()
    return joined.select("word", F.when(plain, F.col("word")).otherwise(F.col("x.canonical")).alias("canonical"), F.when(plain, 1.0).otherwise(F.col("x.weight")).alias("weight"))


def tree_related(terms: DataFrame, edges: DataFrame, depth: int = 2, most: int = 2) -> DataFrame:
    """(term, related, distance): up to `most` descendants in a (parent, child) tree, the nearest first."""
    level = terms.select("term", F.col("term").alias("at"))
    found = None
    for d in range(1, depth + 1):
        level = level.join(edges, F.col("at") == F.col("parent")).select("term", F.col("child").alias("at")).distinct()
        rows = level.select("term", F.col("at").alias("related"), F.lit(d).alias("distance"))
        found = rows if found is None else found.unionByName(rows)
    nearest = found.groupBy("term", "related").agg(F.min("distance").alias("distance")).join(terms.select(F.col("term").alias("related")), "related", "left_anti")
    ranked = nearest.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy("distance", "related")))
    return ranked.where(F.col("r") <= most).select("term", "related", "distance")
