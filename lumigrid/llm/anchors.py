"""Substring dedup by fixed-block anchors.

A repeat of `window` words holds a whole aligned block of `window // 2` words of the document it repeats,
wherever it lies there. So the aligned, non-overlapping blocks of every document are the index, and every
rolling window of that length of every document probes it:

1. Anchors: blocks and probes meet by hash in buckets. A probe is a hit if a document with a smaller id has
   the block; then block and probes are anchors of a repeat that may be long enough.
2. Extension: around its anchors each document forms the full windows that contain one, and windows meet by
   their hash. A window repeats if its smallest document id is not its own; the union of the repeating
   windows is the document's maximal exact repeats.
3. Removal: words in these repeats go.

No pairs of documents are formed: each step keeps, for each hash, only the smallest id (and whether a larger
one exists). Tasks decide what they can among their own postings, so a passage in a third of all documents sends
a bucket a few postings a task and not one for each document. Hashes of windows
have 64 bits; anchors have fewer, which can only add work.

Edge cases: null and empty texts have no words; very long texts are worked on alone; an empty table gives an empty
result; exact copies keep the smallest id; rows that repeat an id are
one document and do not remove each other (if their texts differ, repeats found in one are cut at the same
places in the other); rows without an id count as the largest id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._flat import BLOCK, SPACED, blocks, flat, ranges, window_hashes, word_hashes, word_spans
from ._postings import NO_ID, PACKED_DDL, Gather, bucket_count, by_bucket, unpack_lists, with_lists
from ._shared import small_batches

WINDOW = 50


def _inside(offsets: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows that lie within one document."""
    counts = np.maximum(np.diff(offsets) - size + 1, 0)
    return ranges(offsets[:-1], counts)


def is_anchor(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, block: int) -> np.ndarray:
    """Mask of the postings of a hash that a block has in one document and a posting in one of a larger id."""
    return anchored_here(hashes, docs, places, block)[0]


def anchored_here(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchors among these postings, postings that others need): of an anchor's hash the least block and the largest posting."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((docs, hashes))
    own, doc, aligned = hashes[order], docs[order], places[order] % block == 0
    heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    sizes = np.diff(np.append(heads, len(own)))
    largest = doc[heads + sizes - 1]
    first = np.minimum.reduceat(np.where(aligned, np.arange(len(own)), len(own)), heads)
    found = first < len(own)
    found[found] = doc[first[found]] < largest[found]
    anchor, sent = np.empty(len(own), bool), np.empty(len(own), bool)
    anchor[order] = np.repeat(found, sizes)
    kept = np.repeat(~found, sizes)
    kept[first[found]] = kept[(heads + sizes - 1)[found]] = True
    sent[order] = kept
    return anchor, sent


def is_repeat(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Mask of the postings whose hash a smaller document id has."""
    if not len(hashes):
        return np.zeros(0, bool)
    order = np.argsort(hashes)
    ordered = hashes[order]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    smallest = np.minimum.reduceat(docs[order], heads)
    keep = np.empty(len(hashes), bool)
    keep[order] = np.repeat(smallest, np.diff(np.append(heads, len(ordered)))) < docs[order]
    return keep


def repeated_here(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeats among these postings, postings that others need): the others are each hash's least document's."""
    repeat = is_repeat(hashes, docs, places)
    return repeat, ~repeat


def probes(documents: DataFrame, block: int, buckets: int) -> DataFrame:
    """Packed postings of every rolling window of `block` words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(buckets, np.uint32, lambda h, d, p: anchored_here(h, d, p, block))
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            data, offsets = flat(batch.column("text"))
            for a, b in blocks(offsets, BLOCK):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, words_of = word_spans(part, own, SPACED)
                at = _inside(words_of, block)
                yield from gather.add(window_hashes(word_hashes(part, starts, ends), block)[at] if len(at) else np.zeros(0, np.uint64), at, ids[a:b], np.diff(words_of))
        yield from gather.out()

    return documents.mapInArrow(work, PACKED_DDL)


def candidates(anchored: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed postings of the windows that hold an anchor."""
    block = window // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(buckets, np.uint64, repeated_here)
        for batch in batches:
            ids, lists = batch.column("doc_id").to_numpy(), batch.column("lists").to_pylist()
            data, offsets = flat(batch.column("text"))
            for a, b in blocks(offsets, BLOCK):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, words_of = word_spans(part, own, SPACED)
                hashes = window_hashes(word_hashes(part, starts, ends), window)
                wanted = np.zeros(len(starts) + 1, np.int64)
                for d in range(a, b):
                    if lists[d]:
                        p = np.unique(unpack_lists(lists[d]))
                        low = words_of[d - a] + np.maximum(p - (window - block), 0)
                        high = words_of[d - a] + np.minimum(p, words_of[d - a + 1] - words_of[d - a] - window) + 1
                        go = low < high
                        np.add.at(wanted, low[go], 1)
                        np.add.at(wanted, high[go], -1)
                at = np.flatnonzero(np.cumsum(wanted[:-1]))
                yield from gather.add(hashes[at], at, ids[a:b], np.diff(words_of))
        yield from gather.out()

    return anchored.where("lists is not null").mapInArrow(work, PACKED_DDL)


def removal(documents: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for)."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets, block = bucket_count(documents, spark), window // 2
    anchored = with_lists(docs, by_bucket(probes(docs, block, buckets), lambda h, d, p: is_anchor(h, d, p, block), np.uint32))
    repeats = by_bucket(candidates(anchored, window, buckets), is_repeat, np.uint64)
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * keep_text

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("doc_id").to_pylist(), batch.column("lists").to_pylist()
            data, offsets = flat(batch.column("text"))
            for a, b in blocks(offsets, BLOCK):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, words_of = word_spans(part, own, SPACED)
                gone = np.zeros(len(starts) + 1, np.int64)
                for d in range(a, b):
                    if lists[d]:
                        p = np.unique(unpack_lists(lists[d])) + words_of[d - a]
                        p = p[p + window <= words_of[d - a + 1]]
                        np.add.at(gone, p, 1)
                        np.add.at(gone, p + window, -1)
                kept = np.cumsum(gone[:-1]) == 0
                texts = _joined(part, starts, ends, words_of, kept)
                n = np.diff(words_of)
                sums = np.concatenate(([0], np.cumsum(~kept)))
                columns = [[None if i == NO_ID else i for i in ids[a:b]], n, sums[words_of[1:]] - sums[words_of[:-1]], [hashlib.sha256(t).hexdigest() for t in texts]] + [[t.decode() for t in texts]] * keep_text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    return with_lists(docs, repeats).mapInArrow(work, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * keep_text)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words_of: np.ndarray, kept: np.ndarray) -> list[bytes]:
    """The kept words of each document joined by one space."""
    starts, lengths = starts[kept], (ends - starts)[kept]
    counts = np.concatenate(([0], np.cumsum(kept)))[words_of]
    to = np.cumsum(lengths + 1)
    out = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    out[ranges(to - lengths - 1, lengths)] = data[ranges(starts, lengths)]
    edge = np.concatenate(([0], to))[counts]
    return [out[x : max(x, y - 1)].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
