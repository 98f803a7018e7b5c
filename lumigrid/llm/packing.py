"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Documents are tokenised once (token counts and checksums only are kept), cut where they exceed the capacity,
and packed by their sizes. Items of one size are interchangeable, so the instance is a histogram of at most
`capacity` counts, whatever the corpus: the packing itself is solved on that histogram, in bulk, on the driver.

1. Reduction (Martello and Toth's dominance of feasible sets, for sets of up to three items). For the largest
   remaining size j, let k be the largest size that fits beside it. {j} is fixed if nothing fits. {j, k} is
   fixed if it fills the sequence, or if no two further items fit beside j together, or if the two largest
   that do fit together are no larger than k: then {j, k} dominates every other set with j. Fixed sets
   leave the instance for good, and the reduction goes on with what is left.
2. What is left goes in decreasing size into the open sequence with the least sufficient room (best fit).

Each step handles all items of a size at once and emits a *run*: sequences that have the same pattern of
sizes. Runs number at most a few thousand; documents look their place up by their rank within their size.
Pieces that fill a sequence alone are fixed where they lie, without a shuffle. A size's other pieces are
ranked in shares of about `SHARE`, so a size that a third of all documents have is as many tasks as it needs.

Edge cases: null and empty texts are documents of the end token alone; a very long text is cut into pieces;
repeated rows are packed as often as they occur; pieces of one size (ties) are ranked by their rows; null ids
stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import small_batches, table

CAPACITY = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k"
#: The added tokens of the `tokenizers` file.
SPECIAL = {"<|endoftext|>": 50256}
#: Items of one size that are ranked together, about; a size with more of them has more shares.
SHARE = 20_000

PIECES = "row bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Byte-level BPE ids; equal to those of the `tokenizers` file of the same vocabulary.

    The vocabulary's ranks are read by tiktoken, which is several times faster at the same ids. As the file has
    it, the added tokens' strings in a text are these tokens.
    """

    def __init__(self, folder: str | None = None):
        import public_tokenizers
        import tiktoken

        path = f"{folder}/{VOCABULARY}.tiktoken" if folder else public_tokenizers.path(f"{VOCABULARY}.tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def ids(self, text: str | None) -> np.ndarray:
        """Token ids of a text, then the end id, as little-endian uint32."""
        own = self.encoding.encode_to_numpy(text, allowed_special="all") if text else np.zeros(0, np.uint32)
        return np.append(own, END_ID).astype("<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, the first being what is left over."""
    first = n % capacity
    starts = list(range(first, n, capacity))
    return ([(0, first)] if first else []) + [(s, capacity) for s in starts]


def pieces(documents: DataFrame, *, capacity: int = CAPACITY, tokenizers: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: row (a number of the document's row), doc_id, piece, start, length, ids_crc32."""
    small_batches(documents.sparkSession)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizers)
        for batch in batches:
            out: list[tuple] = []
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = encoder.ids(text.as_py())
                raw = memoryview(ids).cast("B")
                out += [(row, doc_id, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, PIECES)


Run = tuple[tuple[int, ...], int]


def _best_pair(sizes: list[int], counts: dict[int, int], room: int) -> int:
    """The largest sum of two remaining items that is at most room; 0 if no two fit."""
    best, low, high = 0, 0, bisect_left(sizes, room + 1) - 1
    while low <= high:
        total = sizes[low] + sizes[high]
        if low == high and counts[sizes[low]] < 2:
            break
        if total > room:
            high -= 1
        else:
            best = max(best, total)
            low += 1
    return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[Run], dict[int, int]]:
    """(fixed runs, remaining counts): every fixed set dominates all other feasible sets with its largest item.

    The dominance of {j, k} over triples is decided exactly; sets of four or more need three items beside j,
    so they are ruled out only where the three smallest remaining items do not fit beside j.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[Run] = []

    def take(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            del left[size]
            sizes.pop(bisect_left(sizes, size))

    tried: set[int] = set()
    for j in sorted(counts, reverse=True):
        while j in left and j not in tried:
            room = capacity - j
            others = sizes[: bisect_left(sizes, room + 1)]
            fit = [s for s in others[-2:] if s != j or left[j] > 1]
            if not fit:
                # Nothing fits beside j: every such item has its own sequence (one at a time if j alone remains).
                n = left[j] if 2 * j > capacity or j not in others else 1
                fixed.append(((j,), n))
                take(j, n)
                continue
            k = fit[-1]
            smallest = []
            for s in others:
                smallest += [s] * min(3 - len(smallest), left[s] - (s == j))
                if len(smallest) == 3:
                    break
            own = left[j]
            left[j] = own - 1  # j itself cannot stand beside itself
            if not left[j]:
                pair = _best_pair([s for s in others if s != j], left, room)
            else:
                pair = _best_pair(others, left, room)
            left[j] = own
            triple_fits = len(smallest) == 3 and sum(smallest) <= room
            if j + k == capacity or (pair <= k and not triple_fits):
                n = left[j] // 2 if k == j else min(left[j], left[k])
                if j + k != capacity and k != j and n > 1:
                    # Later pairs see the same k while it lasts, so the whole bulk satisfies the same test.
                    n = min(n, left[k])
                fixed.append(((j, k), n))
                if k == j:
                    take(j, 2 * n)
                else:
                    take(j, n)
                    take(k, n)
                continue
            tried.add(j)
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best fit in decreasing size, all items of a size at once; runs of sequences of one pattern."""
    open_: dict[int, list[Run]] = {}
    rooms: list[int] = []

    def add(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((pattern, n))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                if n >= per:
                    add((size,) * per, n // per)
                    n %= per
                if n:
                    add((size,) * n, 1)
                break
            room = rooms[at]
            pattern, have = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            fits = room // size
            full = min(have, n // fits)
            if full:
                add(pattern + (size,) * fits, full)
                n -= full * fits
                have -= full
            if n and have:
                if n < fits:
                    add(pattern + (size,) * n, 1)
                    n, have = 0, have - 1
            if have:
                add(pattern, have)
    return [run for room in rooms for run in open_[room]]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs (pattern of sizes, number of sequences) that hold every item once."""
    fixed, left = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(left, capacity)


def slots(runs_: list[Run]) -> dict[int, np.ndarray]:
    """By size, rows (first rank, first sequence, items of the size per sequence, offset of the first) in rank order.

    The items of a size in one pattern stand side by side, so item q of a sequence lies at offset + q * size.
    """
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in runs_:
        offset = 0
        for size in sorted(set(pattern), reverse=True):
            per = pattern.count(size)
            out.setdefault(size, []).append((used.get(size, 0), sequence, per, offset))
            used[size] = used.get(size, 0) + per * n
            offset += per * size
        sequence += n
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def pack(documents: DataFrame, *, capacity: int = CAPACITY, tokenizers: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence_id and offset; sequences are gapless from offset 0."""
    spark: SparkSession = documents.sparkSession
    own = table(pieces(documents, capacity=capacity, tokenizers=tokenizers, id_col=id_col, text_col=text_col), "pieces")
    # A piece of the whole capacity is a fixed set by itself; its sequence is its place in the table, below 0.
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    whole = own.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = own.where(F.col("length") < capacity)
    # One row for each size, so at most the capacity.
    sizes = {r.length: r["count"] for r in rest.groupBy("length").count().collect()}
    if not sizes:
        return whole
    shares = spark.createDataFrame([(s, -(-n // SHARE)) for s, n in sizes.items()], "length bigint, shares bigint")
    shared = rest.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("row", "piece"), F.col("shares"))).select("row", *columns, "share")
    # One count for each share, of SHARE items; their sums place the shares within their size.
    per_share = {s: np.zeros(-(-n // SHARE), np.int64) for s, n in sizes.items()}
    for length, at, n in shared.groupBy("length", "share").agg(F.count("*").alias("n")).toLocalIterator():
        per_share[length][at] = n
    places = slots(solve(sizes, capacity))
    firsts = {length: np.cumsum(n) - n for length, n in per_share.items()}
    shipped = spark.sparkContext.broadcast((places, firsts))
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, firsts = shipped.value
        now, before = None, 0
        for batch in batches:
            length, at = batch.column("length").to_numpy(), batch.column("share").to_numpy()
            heads = np.flatnonzero(np.append(True, (length[1:] != length[:-1]) | (at[1:] != at[:-1]))[: len(length)])
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for a, b in zip(heads, np.append(heads[1:], len(length)), strict=True):
                size, s = int(length[a]), int(at[a])
                if (size, s) != now:
                    now, before = (size, s), 0
                rank = firsts[size][s] + before + np.arange(b - a)
                before += b - a
                run = places[size][np.searchsorted(places[size][:, 0], rank, "right") - 1]
                within = rank - run[:, 0]
                sequence[a:b] = run[:, 1] + within // run[:, 2]
                offset[a:b] = run[:, 3] + within % run[:, 2] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], schema=schema)

    # All pieces of one share and size in one partition, in one order however often the stage runs.
    dealt = shared.repartition("length", "share").sortWithinPartitions("length", "share", "row", "piece")
    return whole.union(dealt.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"))
