"""Near-duplicate documents by b-bit MinHash.

1. Each document's set of word shingles gets `PERMUTATIONS` minima. Of each minimum only the lowest `BITS`
   bits are retained, packed into a signature; bands of whole minima give candidate keys.
2. Documents of equal sets are one class, which its least id stands for.
3. Candidates meet by band key. Their similarity is estimated from the signatures by bit counts, corrected
   for chance collisions of b bits (Li and Koenig, 2010): J = (matches / k - 2**-b) / (1 - 2**-b). Pairs far
   below the threshold (by `SIGMAS` standard deviations) go; the rest are confirmed on the full sets.
4. First each class is held against the most central class of each of its buckets; that joins most groups of
   copies into a component, which is contracted: a pair within one component decides nothing more. Then, band by
   band, the members of a bucket that still holds several components meet the members of its other components, in
   blocks of bounded size. One pass with signatures alone leaves the members that have a likely partner; a second
   one with full sets confirms pairs in place. A link contracts its components within the block at once, so of all
   links between two components one leaves it: no block emits its pairs.

At 32 bands of 4 rows a pair of similarity 0.85 is missed with probability 6e-11, one of 0.8 with 5e-8.

Edge cases: null and empty texts have the empty set, which links with nothing; fewer words than a shingle are
one shingle; a very long text is worked on alone; equal sets link whatever their order; of equally central classes
(ties) the least id is the pivot; repeated rows get the same component; rows that share an id and differ are one
document with the sets of both; rows without an id are not linked; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._flat import BLOCK, LOWER, SPACED, U, blocks, flat, mix, ranges, word_hashes, word_spans
from ._shared import cut, drop, parts, small_batches, table
from .components import components

PERMUTATIONS, BITS, BANDS = 128, 4, 32
ROWS = PERMUTATIONS // BANDS
SIGMAS = 6
#: Members of a bucket that meet in one task are at most about twice this many.
MEMBERS = 256

_RANDOM = np.random.RandomState(20240607)
_FACTORS = (_RANDOM.randint(0, 1 << 62, PERMUTATIONS).astype(U) << U(1)) | U(1)
_TERMS = _RANDOM.randint(0, 1 << 62, PERMUTATIONS).astype(U)
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], U)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each document's distinct shingles, sorted."""
    starts, ends, words_of = word_spans(data, offsets, SPACED)
    words = word_hashes(data, starts, ends)
    n = np.diff(words_of)
    counts = np.maximum(n - size + 1, (n > 0).astype(np.int64))
    first = ranges(words_of[:-1], counts)
    hashes = np.zeros(len(first), U)
    doc = np.repeat(np.arange(len(n)), counts)
    stop = words_of[doc + 1]
    for j in range(size):
        at = first + j
        inside = at < stop
        hashes[inside] += words[at[inside]] * _PLACES[j]
    mix(hashes)
    order = np.lexsort((hashes, doc))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    kept = np.concatenate(([0], np.cumsum(new)))
    return hashes[new], kept[np.concatenate(([0], np.cumsum(counts)))]


def minima(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, permutations) minima of non-empty sets as uint32, zero for empty ones."""
    docs = len(offsets) - 1
    out = np.zeros((PERMUTATIONS, docs), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        heads = offsets[:-1][full]
        # Some sets at a time, so that one permutation of them stays in cache.
        cutoff = [0]
        for i in range(len(full)):
            if offsets[full[i] + 1] - heads[cutoff[-1]] > 1 << 15 and i > cutoff[-1]:
                cutoff.append(i)
        for a, b in zip(cutoff, [*cutoff[1:], len(full)], strict=True):
            own = hashes[heads[a] : offsets[full[b - 1] + 1]]
            at = heads[a:b] - heads[a]
            for k in range(PERMUTATIONS):
                out[k, full[a:b]] = np.minimum.reduceat(((own * _FACTORS[k] + _TERMS[k]) >> U(32)).astype(np.uint32), at)
    return out.T


def pack_bits(low: np.ndarray) -> np.ndarray:
    """(documents, words) of 64 bits that hold BITS bits of each minimum."""
    per = 64 // BITS
    fields = (low & ((1 << BITS) - 1)).astype(U).reshape(len(low), -1, per)
    return np.bitwise_or.reduce(fields << (np.arange(per, dtype=U) * U(BITS)), axis=2)


_LOWEST = U(sum(1 << (BITS * i) for i in range(64 // BITS)))


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures, by bit counts."""
    differ = x ^ y
    folded = differ.copy()
    for i in range(1, BITS):
        folded |= differ >> U(i)
    apart = np.bitwise_count(folded & _LOWEST).sum(axis=-1, dtype=np.int64)
    chance = 2.0**-BITS
    return ((PERMUTATIONS - apart) / PERMUTATIONS - chance) / (1 - chance)


def cutoff(percent: int) -> float:
    """The estimate below which a pair cannot reach the threshold but by an accident of SIGMAS deviations."""
    chance = 2.0**-BITS
    same = percent / 100 + (1 - percent / 100) * chance
    return percent / 100 - SIGMAS * (same * (1 - same) / PERMUTATIONS) ** 0.5 / (1 - chance)


def signatures(documents: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, bits, bands) of documents (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bits", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in blocks(offsets, BLOCK):
                hashes, sets = shingle_sets(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], shingle)
                least = minima(hashes, sets)
                bits = pack_bits(least)
                bands = np.zeros((b - a, BANDS), U)
                for r in range(ROWS):
                    bands += least[:, r::ROWS].astype(U) * _PLACES[r]
                bands += np.arange(BANDS, dtype=U) * _PLACES[7]
                bands = mix(bands)
                sums = [np.concatenate((np.zeros(1, U), np.cumsum(x))) for x in (mix(hashes ^ _PLACES[5]), mix(hashes + _PLACES[6]))]
                set_a, set_b = (s[sets[1:]] - s[sets[:-1]] for s in sums)
                flat_bands = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(sets)), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)), pa.array([x.tobytes() for x in bits], pa.binary()), flat_bands], schema=schema)

    return documents.mapInArrow(work, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bits binary, bands array<bigint>")


def shingles(documents: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles): each set as its sorted 64-bit hashes."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in blocks(offsets, BLOCK):
                hashes, sets = shingle_sets(LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([hashes[x:y].tobytes() for x, y in zip(sets[:-1], sets[1:], strict=True)], pa.binary())], schema=schema)

    return documents.mapInArrow(work, "doc_id bigint, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, with their intersection and union."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("either", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, either = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                joined = np.sort(np.concatenate((x, y)))
                both[i] = np.count_nonzero(joined[1:] == joined[:-1])
                either[i] = len(joined) - both[i]
            keep = 100 * both >= percent * either
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)), pa.array(both[keep]), pa.array(either[keep])], schema=schema)

    left, right = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(work, "a bigint, b bigint, both bigint, either bigint")


def _likely(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is not far below the threshold."""
    least = cutoff(percent)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), U).reshape(batch.num_rows, -1) for c in (2, 3))
            keep = pa.array(estimate(x, y) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=schema)

    left, right = (bits.select(F.col("doc_id").alias(x), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "bits_a", "bits_b").mapInArrow(work, "a bigint, b bigint")


def _dealt(members: DataFrame, *carried: str) -> DataFrame:
    """Members (key, doc_id, component, ..) of buckets of several components in blocks (key, kind, i, j, side, ..).

    The largest component of a bucket is one side of blocks of kind 0 and all others are the other side; kind 1
    holds the others against each other. Blocks have about MEMBERS members a side; of a component that fills a
    bucket each member is in one block for each MEMBERS others.
    """
    counted = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    whole = counted.groupBy("key").agg(F.count("*").alias("several"), F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("top")).where("several > 1")
    sized = cut(whole.select("key", F.col("top.component").alias("top"), F.ceil(F.col("top.n") / MEMBERS).cast("int").alias("large"), F.ceil((F.col("all") - F.col("top.n")) / MEMBERS).cast("int").alias("rest")))
    placed = members.join(sized, "key").withColumn("first", F.col("component") == F.col("top")).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.when(F.col("first"), F.col("large")).otherwise(F.col("rest"))).cast("int"))
    block = "named_struct('kind', {}, 'i', {}, 'j', {})"
    with_first = f"transform(sequence(0, large - 1), x -> {block.format(0, 'x', 'own')})"
    with_rest = f"transform(sequence(0, rest - 1), x -> {block.format(1, 'least(own, x)', 'greatest(own, x)')})"
    blocks_of = F.expr(f"case when first then transform(sequence(0, rest - 1), x -> {block.format(0, 'own', 'x')}) else concat({with_first}, {with_rest}) end")
    side = F.when((F.col("block.kind") == 0) & F.col("first"), -1).otherwise(F.col("own"))
    spread = placed.withColumn("block", F.explode(blocks_of)).select("key", "block.kind", "block.i", "block.j", side.alias("side"), "doc_id", "component", *carried)
    return spread.repartition(parts(members.sparkSession), "key", "kind", "i", "j").sortWithinPartitions("key", "kind", "i", "j")


def _sides(kind: int, i: int, j: int, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    left = np.flatnonzero(side == (-1 if kind == 0 else i))
    return left, np.flatnonzero(side == j) if kind == 0 or i != j else left


def _each_block(batches: Iterator[pa.RecordBatch], done: Callable[[tuple, list[tuple]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    now = None
    for batch in batches:
        for key, kind, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, kind, i, j) != now and held:
                yield done(now, held)
                held = []
            now = key, kind, i, j
            held.append(tuple(rest))
    if held:
        yield done(now, held)


def _plausible(members: DataFrame, percent: int) -> DataFrame:
    """(key, doc_id) of the members (key, doc_id, component, bits, bands) that have a likely partner of another component in their bucket.

    A pair counts in the first band that both share, so that it is confirmed once.
    """
    least = cutoff(percent)
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64())])

    def done(block: tuple, held: list[tuple]) -> pa.RecordBatch:
        side, ids, component = (np.array([h[c] for h in held]) for c in (0, 1, 2))
        bits = np.frombuffer(b"".join(h[3] for h in held), U).reshape(len(held), -1)
        bands = np.array([h[4] for h in held])
        left, right = _sides(*block[1:], side)
        likely = np.zeros(len(held), bool)
        for a in left:
            others = right[component[right] != component[a]]
            others = others[estimate(bits[a][None], bits[others]) >= least]
            others = others[bands[a][(bands[others] == bands[a]).argmax(axis=1)] == block[0]]
            likely[others] = True
            likely[a] |= len(others) > 0
        return pa.RecordBatch.from_arrays([pa.array(np.full(likely.sum(), block[0])), pa.array(ids[likely])], schema=schema)

    return _dealt(members, "bits", "bands").mapInArrow(lambda batches: _each_block(batches, done), "key bigint, doc_id bigint").distinct()


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components among the members (key, doc_id, component, bits, shingles) of buckets."""
    least = cutoff(percent)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def done(block: tuple, held: list[tuple]) -> pa.RecordBatch:
        side, ids, component = (np.array([h[c] for h in held]) for c in (0, 1, 2))
        bits = np.frombuffer(b"".join(h[3] for h in held), U).reshape(len(held), -1)
        sets = [np.frombuffer(h[4], U) for h in held]
        left, right = _sides(*block[1:], side)
        sizes = np.array([len(x) for x in sets])
        known, tokens = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        mark = np.zeros(len(known), bool)
        found: list[tuple[int, int]] = []
        for a in left:
            others = right[component[right] != component[a]]
            others = others[estimate(bits[a][None], bits[others]) >= least]
            if not len(others):
                continue
            own = tokens[ends[a] - sizes[a] : ends[a]]
            mark[own] = True
            their = ranges(ends[others] - sizes[others], sizes[others])
            both = np.add.reduceat(mark[tokens[their]].astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
            mark[own] = False
            for b in others[100 * both >= percent * (sizes[a] + sizes[others] - both)]:
                if component[a] != component[b]:
                    found.append((ids[a], ids[b]))
                    component[component == component[b]] = component[a]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    return _dealt(members, "bits", "shingles").mapInArrow(lambda batches: _each_block(batches, done), "a bigint, b bigint")


def groups(documents: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of word shingles; a
    component is what links reach, and its least id is kept.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = table(signatures(docs, shingle), "signatures")
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    # Classes of equal sets; few rows a copy group after map-side combination.
    classes = table(linkable.groupBy("set_a", "set_b", "n_shingles").agg(F.min(F.struct("doc_id", "bits", "bands")).alias("first")).select("set_a", "set_b", "n_shingles", "first.*"), "classes")
    bits = classes.select("doc_id", "bits")
    buckets = classes.select(F.explode("bands").alias("key"), "doc_id")
    sizes = table(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = table(buckets.join(sizes, "key"), "members")
    # The original of many copies is in the largest buckets of most bands; it is held against the others first.
    central = shared.groupBy("doc_id").agg(F.round(F.sum(F.log2("n")), 3).alias("central"))
    ranked = shared.select("key", "doc_id").join(central, "doc_id")
    first = table(ranked.groupBy("key").agg(F.max(F.struct("central", (-F.col("doc_id")).alias("least"))).alias("top")).select("key", (-F.col("top.least")).alias("first")), "pivots")
    pivoted = shared.join(first, "key")
    sets = table(shingles(docs.join(shared.select("doc_id").distinct(), "doc_id", "left_semi"), shingle), "sets")
    stars = pivoted.where("first != doc_id").select(F.least("first", "doc_id").alias("a"), F.greatest("first", "doc_id").alias("b")).distinct()
    links = table(confirmed(_likely(stars, bits, percent), sets, percent), "links")
    joined = components(links)
    labelled = shared.select("key", "doc_id").join(joined.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    labelled = table(labelled, "labelled")
    mixed = cut(labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key"))
    open_ = table(labelled.join(mixed, "key"), "open")
    likely = table(_plausible(open_.join(classes.select("doc_id", "bits", "bands"), "doc_id"), percent), "likely")
    some = open_.join(likely, ["key", "doc_id"], "left_semi").join(bits, "doc_id").join(sets, "doc_id")
    more = table(_across(some, percent), "links")
    # Components of the first round are contracted: their links are one link of each member to its component.
    whole = components(joined.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more.select("a", "b")))
    of_class = classes.select("set_a", "set_b", "n_shingles", F.col("doc_id").alias("id")).join(whole, "id", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    placed = table(of_class, "components")
    drop(classes, sizes, shared, first, sets, links, labelled, open_, likely, more)
    return (
        signed.select("doc_id", "n_shingles", "set_a", "set_b").join(placed, ["set_a", "set_b", "n_shingles"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    )
