"""All pairs of a query set and a table of fingerprints, block by block in the tasks of the table: no pair is shuffled.

The query set is collected and broadcast: it is the smaller side, of a stated size. The table is dealt out by id; each
task holds a batch of it against slices of the query set, as matrices of at most BLOCK by SLICE pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

BLOCK, SLICE = 256, 512
#: Cells that this share of a slice's queries have are columns of a matrix; the others are looked up.
HEAVY = 0.1


def dealt(rows: DataFrame) -> DataFrame:
    """rows dealt out by id in a fixed number of partitions: the work grows with the pairs, not with the rows' few bytes."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism), "id")


def _packed(fingerprints: DataFrame, deal: bool) -> DataFrame:
    """(id, cells, vals) of (id, cell, val), or of itself; rows that are packed lie with their documents and stay where they are."""
    if "cells" in fingerprints.columns:
        return fingerprints.select("id", "cells", "vals")
    rows = fingerprints.where("id is not null and cell is not null").select("id", "cell", F.coalesce(F.col("val").cast("double"), F.lit(0.0)).alias("val"))
    both = (dealt(rows) if deal else rows).groupBy("id").agg(F.collect_list(F.struct("cell", "val")).alias("f"))
    return both.select("id", F.col("f.cell").alias("cells"), F.col("f.val").alias("vals"))


class Side:
    """Entries (owner, cell, value) of a batch of packed fingerprints, by owner."""

    def __init__(self, ids: pa.Array, cells: pa.ListArray, vals: pa.ListArray):
        self.ids, self.n = ids, len(ids)
        self.starts = np.concatenate([[0], np.cumsum(pc.list_value_length(cells).to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.owner = np.repeat(np.arange(self.n), np.diff(self.starts))
        self.cell, self.val = cells.flatten(), vals.flatten().to_numpy(zero_copy_only=False)

    def part(self, start: int, end: int) -> Side:
        """The owners from start to end."""
        a, b = self.starts[start], self.starts[end]
        out = object.__new__(Side)
        out.ids, out.n, out.starts = self.ids[start:end], end - start, self.starts[start : end + 1] - a
        out.owner, out.cell, out.val = self.owner[a:b] - start, self.cell[a:b], self.val[a:b]
        return out

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, values, self.n)

    def blocks(self, block: int, blocks: int) -> np.ndarray:
        """How many cells each owner has in each of the first blocks of cells."""
        at = self.cell.to_numpy(zero_copy_only=False) // block
        return np.stack([np.bincount(self.owner[at == b], minlength=self.n) for b in range(blocks)])


def _table(batch: pa.RecordBatch | pa.Table) -> Side:
    whole = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in batch.columns]
    return Side(*[c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in whole])


class Slice:
    """A slice of the queries, ready to be held against many blocks of documents."""

    def __init__(self, side: Side):
        self.side = side
        self.known = pc.unique(side.cell)
        self.code = pc.index_in(side.cell, value_set=self.known).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = np.bincount(self.code, minlength=len(self.known))
        self.column = np.full(len(self.known), -1)
        heavy = np.flatnonzero(sizes > HEAVY * side.n)
        self.column[heavy] = np.arange(len(heavy))
        self.order, self.sizes = np.argsort(self.code, kind="stable"), sizes
        self.first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.values, self.ones = self._dense(side.owner, self.code, side.val, side.n), self._dense(side.owner, self.code, np.ones(len(side.val)), side.n)
        self.plain = bool(np.isfinite(side.val).all())
        self.single = len(np.unique(side.owner * len(self.known) + self.code)) == len(side.val)

    def _dense(self, owner: np.ndarray, code: np.ndarray, val: np.ndarray, n: int) -> np.ndarray:
        """(owner, heavy cell) matrix."""
        width = int(self.column.max(initial=-1)) + 1
        at = self.column[code]
        return np.bincount(owner[at >= 0] * width + at[at >= 0], val[at >= 0], n * width).reshape(n, width) if width else np.zeros((n, 0))

    def met(self, docs: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, code, value) of the entries of documents whose cell some query of the slice has."""
        code = pc.index_in(docs.cell, value_set=self.known)
        here = code.is_valid().to_numpy(zero_copy_only=False)
        return docs.owner[here], code.drop_null().to_numpy(zero_copy_only=False).astype(np.int64), docs.val[here]

    def _links(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (of a document's entry, of a query's entry) that have the same cell."""
        sizes = self.sizes[code]
        entry = np.repeat(np.arange(len(code)), sizes)
        within = np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return entry, self.order[np.repeat(self.first[code], sizes) + within]

    def products(self, docs: Side) -> tuple[np.ndarray, np.ndarray]:
        """(documents, queries) matrices: how many cells both have, and the sum of their values' products."""
        owner, code, val = self.met(docs)
        light = np.ones(len(code), bool) if not (self.plain and np.isfinite(val).all()) else self.column[code] < 0
        both, dot = np.zeros((docs.n, self.side.n)), np.zeros((docs.n, self.side.n))
        if not light.all():
            o, c, v = owner[~light], code[~light], val[~light]
            both, dot = self._dense(o, c, np.ones(len(v)), docs.n) @ self.ones.T, self._dense(o, c, v, docs.n) @ self.values.T
        if light.any():
            entry, query = self._links(code[light])
            pair = owner[light][entry] * self.side.n + self.side.owner[query]
            both += np.bincount(pair, minlength=both.size).reshape(both.shape)
            dot += np.bincount(pair, val[light][entry] * self.side.val[query], both.size).reshape(both.shape)
        return both, dot

    def compared(self, docs: Side) -> tuple[np.ndarray, np.ndarray]:
        """(documents, queries) matrices over shared cells: the sum of the smaller values, and how many values are equal."""
        owner, code, val = self.met(docs)
        least, same = np.zeros((docs.n, self.side.n)), np.zeros((docs.n, self.side.n))
        heavy = int((self.column >= 0).sum()) == len(self.known)
        if heavy and self.single and self.plain and np.isfinite(val).all() and len(np.unique(owner * len(self.known) + code)) == len(val):
            d, q = np.full((docs.n, len(self.known)), np.nan), np.where(self.ones > 0, self.values, np.nan)
            d[owner, self.column[code]] = val
            for k in range(len(self.known)):
                here, there = np.flatnonzero(~np.isnan(d[:, k])), q[:, k]
                x = d[here, k][:, None]
                lower = np.minimum(x, there)
                np.nan_to_num(lower, copy=False)
                least[here] += lower
                same[here] += x == there
            return least, same
        entry, query = self._links(code)
        pair, x, y = owner[entry] * self.side.n + self.side.owner[query], val[entry], self.side.val[query]
        equal = (x == y) | (np.isnan(x) & np.isnan(y))
        return np.bincount(pair, np.fmin(x, y), least.size).reshape(least.shape), np.bincount(pair, equal, least.size).reshape(least.shape)

    def blocks_shared(self, docs: Side, block: int, blocks: int) -> list[np.ndarray]:
        """For each of the first blocks of cells, how many of them both have."""
        at = self.known.to_numpy(zero_copy_only=False) // block
        owner, code, val = self.met(docs)
        out = []
        for b in range(blocks):
            here = at[code] == b
            shared = np.zeros((docs.n, self.side.n))
            heavy = here & (self.column[code] >= 0)
            if heavy.any():
                shared = self._dense(owner[heavy], code[heavy], np.ones(int(heavy.sum())), docs.n) @ self.ones.T
            if (here & ~heavy).any():
                entry, query = self._links(code[here & ~heavy])
                shared += np.bincount(owner[here & ~heavy][entry] * self.side.n + self.side.owner[query], minlength=shared.size).reshape(shared.shape)
            out.append(shared)
        return out


def _slices(table: pa.Table) -> Iterator[Slice]:
    if table.num_rows:
        side = _table(table)
        for s in range(0, side.n, SLICE):
            yield Slice(side.part(s, min(side.n, s + SLICE)))


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x).astype(np.int64)


def pairs(queries: DataFrame, documents: DataFrame, *, compare: bool = False, block: int = 0, blocks: int = 0, keep: tuple[str, ...] | None = None) -> DataFrame:
    """(qid, doc_id, both, dot, ...) of the pairs that share a cell; both tables are (id, cell, val), or packed as (id, cells, vals).

    qn, qs, qss and dn, ds, dss are a side's entries, their values' sum and sum of squares. With `compare` follow least
    and same, the smaller values' sum and the number of equal values of shared cells; with blocks b0.., qb0.. and db0..,
    the cells that both, the query and the document have in each of the first blocks of cells. `keep` names the columns to return.
    """
    asked = queries.sparkSession.sparkContext.broadcast(_packed(queries, False).toArrow())
    names = ["both", "dot", "qn", "qs", "qss", "dn", "ds", "dss", *(["least", "same"] if compare else []), *[f"{s}b{b}" for b in range(blocks) for s in ("", "q", "d")]]
    real = {"dot", "qs", "qss", "ds", "dss", "least"}
    names = [n for n in names if keep is None or n in keep]
    schema = f"qid {dict(queries.dtypes)['id']}, doc_id {dict(documents.dtypes)['id']}, " + ", ".join(f"{n} {'double' if n in real else 'bigint'}" for n in names)

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = _table(batch)
            for s in _slices(asked.value):
                q = s.side
                for start in range(0, docs.n, BLOCK):
                    d = docs.part(start, min(docs.n, start + BLOCK))
                    both, dot = s.products(d)
                    di, qi = np.nonzero(both > 0.5)
                    if not len(di):
                        continue
                    at = di, qi
                    out = {"both": _whole(both[at]), "dot": dot[at]}
                    for p, side, i in (("q", q, qi), ("d", d, di)) if keep is None else ():
                        out |= {f"{p}n": _whole(side.sums(np.ones(len(side.val))))[i], f"{p}s": side.sums(side.val)[i], f"{p}ss": side.sums(side.val * side.val)[i]}
                        if blocks:
                            out |= {f"{p}b{b}": n[i] for b, n in enumerate(side.blocks(block, blocks))}
                    if compare:
                        least, same = s.compared(d)
                        out |= {"least": least[at], "same": _whole(same[at])}
                    if blocks:
                        out |= {f"b{b}": _whole(n[at]) for b, n in enumerate(s.blocks_shared(d, block, blocks))}
                    yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(qi)), d.ids.take(pa.array(di)), *[pa.array(out[n]) for n in names]], ["qid", "doc_id", *names])

    return _packed(documents, True).mapInArrow(held, schema)


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """x rounded as SQL rounds a double: halves of its shortest decimal away from zero; in units of the last digit."""
    scaled = x * 10.0**digits
    out = np.rint(scaled)
    for i in np.flatnonzero(np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-5):
        out[i] = float(Decimal(repr(float(x[i]))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return out


class Best:
    """The `most` best of (score, id) for each query of a slice, found block by block; scores by their rounded value, ties by the least id."""

    def __init__(self, n: int, most: int, digits: int | None):
        self.n, self.most, self.digits = n, most, digits
        self.query, self.key, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0), None
        self.least = np.full(n, -np.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray, valid: np.ndarray) -> None:
        """scores and valid are (documents, queries) matrices."""
        # Half a unit below the last kept one a score may still round to it.
        bound = self.least if self.digits is None else (self.least - 0.6) / 10.0**self.digits
        d, q = np.nonzero(valid & ((scores >= bound) | np.isnan(scores)))
        if not len(d):
            return
        score = scores[d, q]
        key = score if self.digits is None else half_up(score, self.digits)
        query, key, score = np.concatenate([self.query, q]), np.concatenate([self.key, key]), np.concatenate([self.score, score])
        found = ids[d] if self.id is None else np.concatenate([self.id, ids[d]])
        # Not a number is the greatest value, as in SQL.
        order = np.lexsort((found, -np.where(np.isnan(key), np.inf, key), ~np.isnan(key), query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < self.most]
        self.query, self.key, self.score, self.id = query[place < self.most], key[kept], score[kept], found[kept]
        full = place == self.most - 1
        self.least[query[full]] = np.where(np.isnan(key[order[full]]), np.inf, key[order[full]])


def best(queries: DataFrame, documents: DataFrame, most: int, score: Callable[[Side, Side, np.ndarray], np.ndarray], digits: int | None = None, other: bool = False, least: float = -np.inf) -> DataFrame:
    """(qid, doc_id, score): a few rows for each query, among them the `most` best of the pairs that share a cell.

    score is of (documents, queries, dot products): a matrix; minus infinity leaves a pair out, and so does a score below
    `least`. With `other` a query does not meet its own id. Each task keeps `most` by the score of `digits`, ties by id.
    """
    asked = queries.sparkSession.sparkContext.broadcast(_packed(queries, False).toArrow())

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = list(_slices(asked.value))
        found = [Best(s.side.n, most, digits) for s in slices]
        own = [s.side.ids.to_numpy(zero_copy_only=False) for s in slices]
        for batch in batches:
            docs = _table(batch)
            for s, top, names in zip(slices, found, own):
                for start in range(0, docs.n, BLOCK):
                    d = docs.part(start, min(docs.n, start + BLOCK))
                    both, dot = s.products(d)
                    values = score(d, s.side, dot)
                    ids = d.ids.to_numpy(zero_copy_only=False)
                    valid = (both > 0.5) & ~(values < least) & (values != -np.inf)
                    top.add(values, ids, valid & (ids[:, None] != names) if other else valid)
        for top, s in zip(found, slices):
            if top.id is not None and len(top.id):
                yield pa.RecordBatch.from_arrays([s.side.ids.take(pa.array(top.query)), pa.array(top.id), pa.array(top.score)], ["qid", "doc_id", "score"])

    return _packed(documents, True).mapInArrow(held, f"qid {dict(queries.dtypes)['id']}, doc_id {dict(documents.dtypes)['id']}, score double")


def _vectors(table: pa.RecordBatch | pa.Table, width: int | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(ids, matrix, whether whole) of (id, vector); a row that is null, holds a null or has another width is zero and not whole."""
    ids, vectors = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    width = max(int(sizes.max(initial=0)), 0) if width is None else width
    flat = vectors.flatten()
    holes = np.bincount(np.repeat(np.arange(len(ids)), np.maximum(sizes, 0))[flat.is_null().to_numpy(zero_copy_only=False)], minlength=len(ids)) > 0 if flat.null_count else np.zeros(len(ids), bool)
    whole = (sizes == width) & ~holes
    matrix = np.zeros((len(ids), width))
    matrix[whole] = flat.to_numpy(zero_copy_only=False).astype(float)[np.repeat(whole, np.maximum(sizes, 0))].reshape(-1, width)
    return ids, matrix, whole


def vector_blocks(queries: DataFrame, documents: DataFrame, schema: str, held: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    """What `held` makes of (query ids, matrix, whole) and an iterator of the same of blocks of documents; tables are (id, vector)."""
    asked = queries.sparkSession.sparkContext.broadcast(queries.select("id", F.col("vector").cast("array<double>").alias("vector")).toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not asked.value.num_rows:
            return
        ids, q, whole = _vectors(asked.value)

        def parts() -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
            for batch in batches:
                d_ids, d, d_whole = _vectors(batch, q.shape[1])
                for s in range(0, len(d_ids), BLOCK):
                    yield d_ids[s : s + BLOCK], d[s : s + BLOCK], d_whole[s : s + BLOCK]

        yield from held((ids, q, whole), parts())

    typed = f"qid {dict(queries.dtypes)['id']}, doc_id {dict(documents.dtypes)['id']}, {schema}"
    return dealt(documents.select("id", F.col("vector").cast("array<double>").alias("vector"))).mapInArrow(run, typed)
