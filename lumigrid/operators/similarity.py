"""Similarities of sparse fingerprints and dense vectors. Pairs with a query set are made block by block (`pairs`)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import grid
from . import fingerprints as fp, pairs


def dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 if one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def overlaps(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, doc_id, both, dot) of the pairs that share a cell; both tables are (id, cell, val)."""
    q, d = queries.select(F.col("id").alias("qid"), "cell", F.col("val").alias("qv")), documents.select(F.col("id").alias("doc_id"), "cell", F.col("val").alias("dv"))
    return q.join(d, "cell").groupBy("qid", "doc_id").agg(F.count("*").alias("both"), F.sum(F.col("qv") * F.col("dv")).alias("dot"))


def ranked(queries: DataFrame, documents: DataFrame, norm: str = "sqrt_nnz", least: float = 0.0, most: int = 10, digits: int | None = None, fill: bool = True) -> DataFrame:
    """The asymmetric cosine ranking (qid, doc_id, score, rank): documents without a shared cell score 0, or are left out without `fill`.

    With `digits` scores are rounded before they are ranked, so that equal rounded scores go by their document.

    Zero scores can only fill a query's list when it has fewer than `most` overlapping documents, so only the
    first `most` ids are candidates for that, not all pairs.
    """

    def cosines(d: pairs.Side, q: pairs.Side, dots: np.ndarray) -> np.ndarray:
        square = d.sums(d.val * d.val)
        top_ = np.full(d.n, -np.inf)
        np.maximum.at(top_, d.owner, d.val)
        sizes = {"sqrt_nnz": np.sqrt(d.sums(np.ones(len(d.val)))), "l2": np.sqrt(square), "l1": d.sums(np.abs(d.val)), "max": top_}[norm]
        length = np.sqrt(q.sums(q.val * q.val))
        whole = ~(length <= 0)[None, :] & ~(sizes <= 1e-10)[:, None]
        return np.where(whole, dots / np.where(whole, length[None, :] * sizes[:, None], 1.0), -np.inf)

    if norm not in ("sqrt_nnz", "l2", "l1", "max"):
        raise ValueError(f"unknown norm {norm}")
    filled = fill and least <= 0
    scored = pairs.best(queries, documents, most, cosines, digits, least=-np.inf if filled else least)
    if filled:
        qn, dn = fp.norms(queries).select(F.col("id").alias("qid"), "l2"), documents.select(F.col("id").alias("doc_id")).distinct()
        found = scored.groupBy("qid").agg(F.count("*").alias("n"))
        short = qn.where("l2 > 0").join(found, "qid", "left").where(F.coalesce("n", F.lit(0)) < most).select("qid")
        rest = short.crossJoin(dn.orderBy("doc_id").limit(2 * most)).join(scored, ["qid", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
        scored = scored.unionByName(rest)
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    return top(scored.where(F.col("score") >= least), "qid", "score", "doc_id", most)


def top(scored: DataFrame, group: str, score: str, item: str, most: int) -> DataFrame:
    """The `most` best of each group, ties by the least item, with their rank."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.col(item))))
    return out.where(F.col("rank") <= most)


def set_metrics(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """dice, overlap, jaccard, containment and coverage of the active cells of the pairs that share one."""
    i, q, d = F.col("both"), F.col("qn"), F.col("dn")
    joined = pairs.pairs(queries, documents)
    return joined.select("qid", "doc_id", "both", (2 * i / (q + d)).alias("dice"), (i / F.least(q, d)).alias("overlap"), (i / (q + d - i)).alias("jaccard"), (i / q).alias("containment"), (i / d).alias("coverage"))


def idf_intersection(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """Share of the query's idf weight, ln(N / df), that the document's cells cover."""
    n = documents.select(F.count_distinct("id").alias("n"))
    idf = documents.groupBy("cell").agg(F.count_distinct("id").alias("df")).crossJoin(n).select("cell", F.log(F.col("n") / F.col("df")).alias("val"))
    q = queries.select("id", "cell").join(idf, "cell")
    own = pairs.pairs(q, documents.select("id", "cell", F.lit(1.0).alias("val")))
    return own.select("qid", "doc_id", F.when(F.col("qs") > 0, F.col("dot") / F.col("qs")).otherwise(0.0).alias("score"))


def spatial_jaccard(queries: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """Shared cells weighted by exp(-L1 distance from the grid's centre / (0.3 size)), over the union's count."""
    centre = size / 2
    weight = F.exp(-(F.abs(grid.morton_x(F.col("cell")) - centre) + F.abs(grid.morton_y(F.col("cell")) - centre)) / (0.3 * size))
    both = pairs.pairs(queries.select("id", "cell", weight.alias("val")), documents.select("id", "cell", F.lit(1.0).alias("val")))
    return both.select("qid", "doc_id", (F.col("dot") / (F.col("qn") + F.col("dn") - F.col("both"))).alias("score"))


def distances(queries: DataFrame, documents: DataFrame, size: int) -> DataFrame:
    """Euclidean distance, Hamming similarity and weighted Jaccard (sum of minima over sum of maxima) of sharing pairs.

    Only shared cells are compared; what one side has alone follows from the sums of each side.
    """
    joined = pairs.pairs(queries, documents, compare=True)
    union = F.col("qn") + F.col("dn") - F.col("both")
    return joined.select(
        "qid", "doc_id", F.sqrt(F.greatest(F.col("qss") + F.col("dss") - 2 * F.col("dot"), F.lit(0.0))).alias("euclidean"), ((size * size - union + F.col("same")) / (size * size)).alias("hamming"), (F.col("least") / (F.col("qs") + F.col("ds") - F.col("least"))).alias("ruzicka")
    )


def block_attention(queries: DataFrame, documents: DataFrame, size: int, block: int = 4, temperature: float = 1.0) -> DataFrame:
    """Mean over block pairs of softmax(QK' / sqrt(D) / T) times block cosine, cells read row by row.

    queries and documents are (id, vector) with size * size values; the score of others is null.
    """
    n, d = size // block, block * block
    places = np.array([[((b // n) * block + k // block) * size + (b % n) * block + k % block for k in range(d)] for b in range(n * n)])

    def cut(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = matrix[:, places] if matrix.shape[1] == size * size else np.zeros((len(matrix), *places.shape))
        return parts, np.sqrt((parts * parts).sum(axis=2))

    def scored(asked: tuple, parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        q_ids, q, q_whole = asked
        for d_ids, x, whole in parts:
            k, k_length = cut(x)
            for s in range(0, len(q_ids), pairs.SLICE):
                own, length = cut(q[s : s + pairs.SLICE])
                score = np.zeros((len(k), len(own)))
                for b in range(n * n):
                    dots = np.stack([k[:, c] @ own[:, b].T for c in range(n * n)])
                    norms_ = k_length.T[:, :, None] * length[:, b][None, None, :]
                    logits = dots / (d**0.5) / temperature
                    weight = np.exp(logits - logits.max(axis=0))
                    score += (weight * np.divide(dots, norms_, out=np.zeros_like(dots), where=norms_ > 0)).sum(axis=0) / weight.sum(axis=0)
                missing = ~(whole[:, None] & q_whole[None, s : s + pairs.SLICE] & (x.shape[1] == size * size))
                rows, columns = np.divmod(np.arange(score.size), len(own))
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(s + columns)), d_ids.take(pa.array(rows)), pa.array(score.ravel() / n**4, mask=missing.ravel())], ["qid", "doc_id", "score"])

    # The stated query set against all rows.
    return pairs.vector_blocks(queries, documents, "score double", scored)


def nearest(queries: DataFrame, documents: DataFrame, most: int = 10) -> DataFrame:
    """The `most` rows of least cosine distance for each query; (id, vector) tables; a query is not its own neighbour."""

    def scored(asked: tuple, parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        q_ids, q, _ = asked
        starts = range(0, len(q_ids), pairs.SLICE)
        names, lengths = q_ids.to_numpy(zero_copy_only=False), np.sqrt((q * q).sum(axis=1))
        found = [pairs.Best(min(pairs.SLICE, len(q_ids) - s), most, 6) for s in starts]
        for d_ids, x, _ in parts:
            ids, length = d_ids.to_numpy(zero_copy_only=False), np.sqrt((x * x).sum(axis=1))
            for s, best in zip(starts, found):
                part = slice(s, s + pairs.SLICE)
                norm = length[:, None] * lengths[None, part]
                near = np.divide(x @ q[part].T, norm, out=np.zeros(norm.shape), where=norm > 0) - 1
                best.add(near, ids, ids[:, None] != names[None, part])
        for s, best in zip(starts, found):
            if best.id is not None and len(best.id):
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(s + best.query)), pa.array(best.id), pa.array(-best.score)], ["qid", "doc_id", "distance"])

    rows = pairs.vector_blocks(queries, documents, "distance double", scored).withColumn("distance", F.round("distance", 6))
    ranked_ = rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "doc_id")))
    return ranked_.where(F.col("rank") <= most)


def shared_terms(matrix: DataFrame, pairs: DataFrame) -> DataFrame:
    """Terms of both contexts of each pair (a, b) of a (phrase, doc_id, weight) matrix, with the smaller weight."""
    left, right = matrix.select("phrase", F.col("doc_id").alias("a"), F.col("weight").alias("wa")), matrix.select("phrase", F.col("doc_id").alias("b"), F.col("weight").alias("wb"))
    return pairs.join(left, "a").join(right, ["b", "phrase"]).where("wa > 0 and wb > 0").select("a", "b", "phrase", F.least("wa", "wb").alias("weight"))


def snippet_pool(documents: DataFrame, snippets: DataFrame, weight: float = 0.3) -> DataFrame:
    """(qid, doc_id, score): document scores mixed with the best snippet's, which is at least 0; others unchanged."""
    best = snippets.groupBy("qid", "doc_id").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("best"))
    return documents.join(best, ["qid", "doc_id"], "left").select("qid", "doc_id", F.when(F.col("best").isNull(), F.col("score")).otherwise((1 - weight) * F.col("score") + weight * F.col("best")).alias("score"))


def label_separation(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(same_label, n, mean_cosine) of all ordered pairs of different ids of (id, label); same_label is null where a label is.

    vectors are (id, cell, val); an id without cells has cosine 0 to all. No pairs are made: the cosines of a set's pairs
    add up to the squared length of the sum of its unit vectors, less one for each of them.
    """
    length = vectors.groupBy("id").agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("length")).where("length > 0")
    unit = vectors.join(length, "id").join(labels.select("id", "label"), "id")
    sums = unit.groupBy("label", "cell").agg(F.sum(F.col("val") / F.col("length")).alias("s"))
    known = lambda c: F.when(F.col("label").isNotNull(), F.col(c))
    within = sums.agg(F.coalesce(F.sum(known("s") * known("s")), F.lit(0.0)).alias("same"))
    total = sums.groupBy("cell").agg(F.sum("s").alias("s"), F.coalesce(F.sum(known("s")), F.lit(0.0)).alias("k")).agg(F.coalesce(F.sum(F.col("s") * F.col("s")), F.lit(0.0)).alias("all"), F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0)).alias("known"))
    sizes = labels.select("id", "label").join(length, "id", "left").groupBy("label").agg(F.count("*").alias("n"), F.count("length").alias("m"))
    add = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)
    pairs = F.col("n") * (F.col("n") - 1)
    counts = sizes.withColumn("pairs", pairs).agg(add(F.col("n"), "n"), add(known("n"), "n_known"), add(known("pairs"), "n_same"), add(F.col("m"), "m"), add(known("m"), "m_known"))
    one = within.crossJoin(total).crossJoin(counts).select("n_same", (F.col("same") - F.col("m_known")).alias("same"), (F.col("n_known") * (F.col("n_known") - 1)).alias("n_known"), (F.col("known") - F.col("m_known")).alias("known"), pairs.alias("n"), (F.col("all") - F.col("m")).alias("all"))
    row = lambda same, n, c: F.struct(F.lit(same).cast("boolean").alias("same_label"), n.alias("n"), (c / F.when(n > 0, n)).alias("mean_cosine"))
    rows = F.array(row(True, F.col("n_same"), F.col("same")), row(False, F.col("n_known") - F.col("n_same"), F.col("known") - F.col("same")), row(None, F.col("n") - F.col("n_known"), F.col("all") - F.col("known")))
    return one.select(F.explode(rows).alias("x")).select("x.*").where("n > 0")
