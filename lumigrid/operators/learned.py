"""A ranker learned on all pairs of a query set and a table, and applied to them, block by block: no pair is a row.

Boosted trees read of a pair only the bins of its features. The bins are taken from the features' counts over all
training pairs; then a pair is kept as a byte for each feature and what the trees leave of its label, in blocks that
stay where they were made. A level of a tree is one pass over the blocks: tasks return sums by node, feature and bin.
Sums are of whole numbers, so that the trees do not depend on how the rows are dealt out. Held-out queries keep their
best documents task by task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from . import pairs, rerank, similarity
from .pairs import BLOCK, Best, Side, Slice

#: A feature is read to 1 / UNIT from -1 to 1; what is no number is above all.
UNIT = 1 << 15
LEVELS = 2 * UNIT + 2
#: The boosting of `rerank.train_ranker`: bins of a feature, trees, their depth, and the step of all trees but the first.
BINS, TREES, DEPTH, STEP = 32, 20, 4, 0.1
#: Predictions are whole multiples of 1 / GRAIN. Of PART pairs the number and the sum of what is left lie in one exact float, the number above NUMBER.
GRAIN, PART, NUMBER = float(1 << 20), 1 << 14, float(1 << 37)

#: After so many trees the blocks are written anew with what is left of the labels; the trees since are predicted in each pass.
RENEW = 4

#: A tree: (feature, greatest bin of the left side, left, right), or (value,).
Tree = tuple


def names(blocks: int) -> list[str]:
    return ["jaccard", "cosine", "overlap", "hamming_norm", *[f"block_{b}" for b in range(blocks)]]


def packed(fingerprints: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, cells, vals, classes) of (id, cell, val) and (id, label), dealt out by id; an id may have several labels."""
    cells = fingerprints.where("id is not null and cell is not null").select("id", F.struct("cell", F.coalesce(F.col("val").cast("double"), F.lit(0.0)).alias("val")).alias("f"), F.lit(None).cast(labels.schema["label"].dataType).alias("label"))
    classes = labels.where("id is not null and label is not null").select("id", F.lit(None).cast(cells.schema["f"].dataType).alias("f"), "label")
    rows = pairs.dealt(cells.unionByName(classes)).groupBy("id").agg(F.collect_list("f").alias("f"), F.collect_set("label").alias("classes"))
    return rows.where(F.size("f") > 0).select("id", F.col("f.cell").alias("cells"), F.col("f.val").alias("vals"), "classes")


def _sides(batch: pa.RecordBatch | pa.Table) -> tuple[Side, Side]:
    """A batch's fingerprints and classes."""
    batch = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
    classes = batch["classes"].combine_chunks()
    ones = pa.ListArray.from_arrays(classes.offsets, pa.array(np.ones(len(classes.values)))) if classes.offset == 0 else pa.array([[1.0] * len(c) for c in classes.to_pylist()], pa.list_(pa.float64()))
    return pairs._table(batch.select(["id", "cells", "vals"])), Side(batch["id"].combine_chunks(), classes, ones)


def levels(s: Slice, d: Side, both: np.ndarray, dot: np.ndarray, cells: int, block: int, blocks: int) -> Iterator[np.ndarray]:
    """Each of `names` as the levels of a (documents, queries) matrix, by the formulas of `rerank.pair_features`."""

    def level(x: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x), LEVELS - 1, np.rint(np.clip(x, -1, 1) * UNIT) + UNIT).astype(np.int32)

    q = s.side
    qn, dn = np.diff(q.starts).astype(float), np.diff(d.starts).astype(float)[:, None]
    union = qn + dn - both
    yield level(both / union)
    length = np.sqrt(q.sums(q.val * q.val) * d.sums(d.val * d.val)[:, None])
    yield level(np.divide(dot, length, out=np.zeros_like(dot), where=length != 0))
    yield level(both / np.minimum(qn, dn))
    yield level(1 - (union - both) / cells)
    for shared, x, y in zip(s.blocks_shared(d, block, blocks), q.blocks(block, blocks), d.blocks(block, blocks)):
        total = x + y[:, None] - shared
        yield level(np.divide(shared, total, out=np.zeros_like(shared), where=total > 0))


def _blocks(asked: pa.Table, batches: Iterator[pa.RecordBatch], cells: int, block: int, blocks: int) -> Iterator[tuple]:
    """(number of the slice, slice, documents, whether a pair counts, labels, levels) of all blocks of pairs; a query does not meet its own id."""
    if not asked.num_rows:
        return
    whole, kinds = _sides(asked)
    cuts = [(s, min(whole.n, s + pairs.SLICE)) for s in range(0, whole.n, pairs.SLICE)]
    slices = [(Slice(whole.part(*c)), Slice(kinds.part(*c)), whole.ids[c[0] : c[1]].to_numpy(zero_copy_only=False)) for c in cuts]
    for batch in batches:
        table, classes = _sides(batch)
        for start in range(0, table.n, BLOCK):
            d, c = table.part(start, min(table.n, start + BLOCK)), classes.part(start, min(table.n, start + BLOCK))
            own = d.ids.to_numpy(zero_copy_only=False)[:, None]
            for k, (s, kind, ids) in enumerate(slices):
                both, dot = s.products(d)
                yield k, s, d, (both > 0.5) & (own != ids), lambda c=c, kind=kind: kind.products(c)[0] > 0.5, levels(s, d, both, dot, cells, block, blocks)


def thresholds(counts: np.ndarray, most: int = BINS - 1) -> np.ndarray:
    """At most `most` cuts between levels that give parts of about equal counts, as the trainer takes them from a feature's values."""
    at = np.flatnonzero(counts)
    if len(at) - 1 <= most:
        return (at[:-1] + at[1:]) / 2
    sums, cuts = np.cumsum(counts[at]), []
    stride = target = sums[-1] / (most + 1)
    for i in range(1, len(at)):
        if abs(sums[i - 1] - target) < abs(sums[i] - target):
            cuts.append((at[i - 1] + at[i]) / 2)
            target += stride
    return np.array(cuts)


def kept(asked: DataFrame, table: DataFrame, cells: int, block: int, blocks: int) -> tuple[DataFrame, list[np.ndarray]]:
    """(pairs): blocks of pairs, a byte for the bin of each feature and the label in units of 1 / GRAIN (`_block`); and the bin of each feature's levels."""
    names_ = names(blocks)
    queries = asked.sparkSession.sparkContext.broadcast(asked.toArrow())

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names_), LEVELS), np.int64)
        for _, _, _, valid, _, values in _blocks(queries.value, batches, cells, block, blocks):
            for f, x in enumerate(values):
                total[f] += np.bincount(x[valid], minlength=LEVELS)
        f, x = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(x), pa.array(total[f, x])], ["f", "x", "n"])

    at = table.mapInArrow(seen, "f bigint, x bigint, n bigint").groupBy("f", "x").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(names_), LEVELS), np.int64)
    total[at["f"].to_numpy(), at["x"].to_numpy()] = at["n"].to_numpy()
    bins = [np.searchsorted(thresholds(t), np.arange(LEVELS)).astype(np.uint8) for t in total]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, valid, labels, values in _blocks(queries.value, batches, cells, block, blocks):
            if valid.any():
                rows = np.stack([b[x[valid]] for b, x in zip(bins, values)])
                yield pa.RecordBatch.from_arrays([pa.array([rows.tobytes() + (labels()[valid] * GRAIN).astype(np.int32).tobytes()], pa.binary())], ["pairs"])

    return table.mapInArrow(held, "pairs binary"), bins


def _block(x: pa.Scalar, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, pair) matrix of bins, and what is left of the labels."""
    n = len(x.as_buffer()) // (features + 4)
    return np.frombuffer(x.as_buffer(), np.uint8, features * n).reshape(features, n), np.frombuffer(x.as_buffer(), np.int32, n, features * n)


def reached(tree: Tree, values: np.ndarray | list[np.ndarray]) -> tuple[np.ndarray, list[float]]:
    """The number of the leaf that each pair's bins reach, and the leaves' values."""
    leaves: list[float] = []

    def leaf(node: Tree) -> np.ndarray | np.uint8:
        if len(node) == 1:
            leaves.append(node[0])
            return np.uint8(len(leaves) - 1)
        low, high = leaf(node[2]), leaf(node[3])
        return (-(values[node[0]] > node[1]).view(np.uint8) & (low ^ high)) ^ low

    return np.broadcast_to(leaf(tree), values[0].shape), leaves


def predicted(forest: list[Tree], values: np.ndarray | list[np.ndarray]) -> np.ndarray:
    """The sum of the trees' values, in units of 1 / GRAIN."""
    total = np.zeros(values[0].shape)
    for tree in forest:
        at, leaves = reached(tree, values)
        total += np.array(leaves).take(at, mode="clip")
    return total


def _left(rows: DataFrame, forest: list[Tree], features: int) -> DataFrame:
    """The blocks with what these trees, too, leave of the labels."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                bins, rest = _block(x, features)
                now = (rest - predicted(forest, bins)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([bins.tobytes() + now.tobytes()], pa.binary())], ["pairs"])

    return rows.mapInArrow(held, "pairs binary")


def _sums(rows: DataFrame, forest: list[Tree], tree: Tree, leaves: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, feature, bin) arrays over all pairs: how many, and the sum of what these trees leave of what is left of their labels."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, features, leaves * BINS), np.int64)
        for batch in batches:
            for x in batch.column(0):
                bins, rest = _block(x, features)
                for start in range(0, len(rest), PART):
                    part = bins[:, start : start + PART]
                    weight = rest[start : start + PART] - predicted(forest, part) + NUMBER
                    node = reached(tree, part)[0].astype(np.intp) * BINS
                    for f in range(features):
                        both = np.bincount(node + part[f], weight, leaves * BINS)
                        n = np.rint(both / NUMBER)
                        total[0, f] += n.astype(np.int64)
                        total[1, f] += (both - n * NUMBER).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    # A task for each core: a pass over small blocks costs little more than its tasks' start.
    made = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism).mapInArrow(held, "sums binary").toArrow()
    total = sum((np.frombuffer(x.as_buffer(), np.int64) for x in made["sums"]), np.zeros(2 * features * leaves * BINS, np.int64)).reshape(2, features, leaves, BINS)
    return total[0].transpose(1, 0, 2), total[1].transpose(1, 0, 2)


def split(n: np.ndarray, rest: np.ndarray) -> tuple[int, int, tuple[float, float]] | None:
    """(feature, greatest bin of the left side, (mean left, mean right)) of the split that leaves the least squared error, if one leaves less.

    n and rest are (feature, bin) arrays; of equal splits the first feature's lowest.
    """
    left_n, left = np.cumsum(n, 1)[:, :-1], np.cumsum(rest, 1)[:, :-1].astype(float)
    all_n, whole = n.sum(1, keepdims=True), rest.sum(1, keepdims=True).astype(float)
    right_n, right = all_n - left_n, whole - left
    both = (left_n > 0) & (right_n > 0)
    if not both.any():
        return None
    left_n, right_n = np.maximum(left_n, 1), np.maximum(right_n, 1)
    gain = np.where(both, (left / left_n) ** 2 * left_n + (right / right_n) ** 2 * right_n - whole**2 / np.maximum(all_n, 1), -np.inf)
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(f), int(b), (left[f, b] / left_n[f, b], right[f, b] / right_n[f, b])) if gain[f, b] > 0 else None


def _grown(tree: Tree, splits: Iterator, scale: float) -> tuple[Tree, list[bool]]:
    """The tree with its leaves split, and which of the new leaves may be split again; splits are (split or None, mean) by leaf."""
    if len(tree) > 1:
        low, a = _grown(tree[2], splits, scale)
        high, b = _grown(tree[3], splits, scale)
        return (*tree[:2], low, high), a + b
    value = lambda mean: (float(np.rint(scale * mean)),)
    best_, mean = next(splits)
    return (value(mean), [False]) if best_ is None else ((*best_[:2], *map(value, best_[2])), [True, True])


def trained(rows: DataFrame, features: int, trees: int = TREES, depth: int = DEPTH) -> list[Tree]:
    """Boosted trees of blocks of pairs, by the rules of `rerank.train_ranker`: the first of the labels, each other of twice what is left of them."""
    forest: list[Tree] = []
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    since, former = [], None
    for t in range(trees):
        if len(since) == RENEW:
            former, rows, since = rows, _left(rows, since, features).persist(StorageLevel.MEMORY_AND_DISK), []
        tree, open_ = (0.0,), [True]
        for _ in range(depth):
            if any(open_):
                n, rest = _sums(rows, since, tree, len(open_), features)
                splits = ((split(n[k], rest[k]) if more else None, rest[k, 0].sum() / max(n[k, 0].sum(), 1)) for k, more in enumerate(open_))
                tree, open_ = _grown(tree, splits, 2 * STEP if t else 1.0)
            if former is not None:
                former.unpersist()
                former = None
        forest.append(tree)
        since = [*since, tree]
    rows.unpersist()
    return forest


def best(asked: DataFrame, table: DataFrame, forest: list[Tree], bins: list[np.ndarray], cells: int, block: int, blocks: int, most: int) -> DataFrame:
    """(qid, doc_id, score): a few rows for each query, among them the `most` best by the ranker's prediction."""
    queries = asked.sparkSession.sparkContext.broadcast(asked.toArrow())

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[Slice, Best]] = {}
        for k, s, d, valid, _, values in _blocks(queries.value, batches, cells, block, blocks):
            score = predicted(forest, [b[x] for b, x in zip(bins, values)]) / GRAIN
            found.setdefault(k, (s, Best(s.side.n, most, None)))[1].add(score, d.ids.to_numpy(zero_copy_only=False), valid)
        for s, top in found.values():
            if top.id is not None and len(top.id):
                yield pa.RecordBatch.from_arrays([s.side.ids.take(pa.array(top.query)), pa.array(top.id), pa.array(top.score)], ["qid", "doc_id", "score"])

    kind = dict(table.dtypes)["id"]
    return table.mapInArrow(held, f"qid {kind}, doc_id {kind}, score double")


def ranked(fingerprints: DataFrame, labels: DataFrame, asked: Callable[[DataFrame], DataFrame], cells: int, block: int, blocks: int, shares: int = 5, most: int = 10) -> DataFrame:
    """(qid, doc_id, score, rerank_rank) of held-out queries, by a ranker trained on all pairs of the other queries.

    fingerprints are (id, cell, val), labels (id, label); `asked` chooses the queries among them. A pair is right if both
    ids have a label in common. One in `shares` queries is held out.
    """
    table = packed(fingerprints, labels)
    queries = asked(table).withColumn("held_out", rerank.held_out("id", shares))
    rows, bins = kept(queries.where("not held_out").drop("held_out"), table, cells, block, blocks)
    forest = trained(rows, len(bins))
    scored = best(queries.where("held_out").drop("held_out"), table, forest, bins, cells, block, blocks, most)
    return similarity.top(scored, "qid", "score", "doc_id", most).withColumnRenamed("rank", "rerank_rank")
