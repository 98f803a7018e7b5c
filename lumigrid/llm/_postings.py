"""Hash postings that cross a shuffle packed by bucket, and position lists that come back by document.

A posting is (hash, document, position). One row holds all postings of one bucket from some MB of text:
hashes as they are, positions as small differences, and the ids and lengths of the documents. A bucket gets
the hashes of one residue, so one frequent passage spreads over as many buckets as it has windows.

What the postings that a task gathers decide among themselves does not travel by hash: the decided positions go
to their documents, and of a frequent hash only its deciding postings reach the bucket, so a passage in a third of
all documents costs a bucket a few postings for each gathered `GATHER`, not one for each document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._flat import U, mix
from ._shared import parts

#: Bytes of input (as its files have them) for one bucket at most.
BUCKET_BYTES = 16_000_000
NO_ID = (1 << 63) - 1
#: Postings that are gathered before they are sent by bucket.
GATHER = 2_000_000
#: First number of a packed row that holds decided values and no postings.
DECIDED = -1
PACKED = pa.schema([("bucket", pa.int64()), ("postings", pa.binary())])
PACKED_DDL = "bucket bigint, postings binary"
LISTS = pa.schema([("doc_id", pa.int64()), ("spans", pa.binary())])
LISTS_DDL = "doc_id bigint, spans binary"


def bucket_count(documents: DataFrame, spark: SparkSession) -> int:
    """Buckets that follow the input's size: one a partition at least, each of bounded bytes.

    The size is that of the tables which the plan reads, as the estimate of a join may be a product.
    """
    leaves = documents._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [n for i in range(leaves.size()) if (n := int(str(leaves.apply(i).stats().sizeInBytes()))) < 1 << 60]
    return max(parts(spark), sum(known) // BUCKET_BYTES)


def pack_postings(hashes: np.ndarray, positions: np.ndarray, ids: np.ndarray, sizes: np.ndarray, buckets: int, width: type) -> Iterator[tuple[int, bytes]]:
    """(bucket, packed postings): positions count through the documents, whose ids and sizes are given."""
    bucket = (hashes % U(buckets)).astype(np.int64)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    rest = (hashes // U(buckets)).astype(width)[order]
    positions = positions[order]
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(heads, np.append(heads[1:], len(bucket)), strict=True):
        steps = np.diff(positions[a:b], prepend=0).astype(np.uint32)
        starts = np.cumsum(sizes) - sizes
        used = np.unique(np.searchsorted(starts, positions[a:b], "right") - 1)
        # Only documents with postings here are named, by their starts.
        head = np.array([b - a, len(used)], np.int64).tobytes()
        small = pa.compress(np.concatenate([steps.view(np.uint8).reshape(-1, 4).T.ravel(), ids[used].astype(np.int64).view(np.uint8).reshape(-1, 8).T.ravel(), np.diff(starts[used], prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.ravel()]).tobytes(), codec="zstd", asbytes=True)
        yield int(bucket[a]), head + rest[a:b].tobytes() + small


def unpack_postings(raw: bytes, width: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, document ids, positions in the document)."""
    n, docs = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    at = 16 + n * np.dtype(width).itemsize
    rest = np.frombuffer(raw, width, n, 16)
    small = np.frombuffer(pa.decompress(raw[at:], decompressed_size=4 * n + 12 * docs, codec="zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(small[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    ids = np.ascontiguousarray(small[4 * n : 4 * n + 8 * docs].reshape(8, docs).T).view(np.int64).ravel()
    starts = np.cumsum(np.ascontiguousarray(small[4 * n + 8 * docs :].reshape(4, docs).T).view(np.uint32).ravel().astype(np.int64))
    place = np.cumsum(steps.astype(np.int64))
    doc = np.searchsorted(starts, place, "right") - 1
    return rest, ids[doc], place - starts[doc]


def unpack_lists(raw: bytes | None, width: int = 1) -> np.ndarray:
    """A document's values, `width` a row."""
    out = np.frombuffer(raw or b"", np.uint32).astype(np.int64)
    return out if width == 1 else out.reshape(-1, width)


def pack_values(docs: np.ndarray, values: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket of documents, packed documents and values): one a bucket, however many documents it has."""
    if not len(docs):
        return
    values = values.reshape(len(docs), -1).astype(np.uint32)
    to = (mix(docs.astype(U)) % U(buckets)).astype(np.int64)
    order = np.lexsort((values[:, 0], docs, to))
    docs, values, to = docs[order], values[order], to[order]
    heads = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
    rows = []
    for a, b in zip(heads, np.append(heads[1:], len(to)), strict=True):
        body = docs[a:b].astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes() + values[a:b].ravel().view(np.uint8).reshape(-1, 4).T.tobytes()
        rows.append((int(to[a]), np.array([b - a, values.shape[1]], np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True)))
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + 64]], pa.int64()), pa.array([r for _, r in rows[i : i + 64]], pa.binary())], schema=PACKED)


def _unpack_values(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    body = np.frombuffer(pa.decompress(raw[16:], decompressed_size=n * (8 + 4 * width), codec="zstd", asbytes=True), np.uint8)
    docs = np.ascontiguousarray(body[: 8 * n].reshape(8, n).T).view(np.int64).ravel()
    return docs, np.ascontiguousarray(body[8 * n :].reshape(4, n * width).T).view(np.uint32).reshape(n, width)


def _as_decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mark = np.array([DECIDED], np.int64).tobytes()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([mark + raw for raw in batch.column(1).to_pylist()], pa.binary())], schema=PACKED)


def decided(docs: np.ndarray, values: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Values that need no bucket, packed for `split_decided`."""
    yield from _as_decided(pack_values(docs, values, buckets))


def split_decided(held: list[bytes]) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """(packed rows that a bucket has to judge, decided documents and values) of its rows."""
    is_decided = [int.from_bytes(raw[:8], "little", signed=True) == DECIDED for raw in held]
    return [raw for raw, d in zip(held, is_decided, strict=True) if not d], [_unpack_values(raw[8:]) for raw, d in zip(held, is_decided, strict=True) if d]


class Gather:
    """Collects postings of successive blocks of documents, decides what they decide among themselves, and packs the others by bucket.

    local() gets hashes, documents and positions and returns masks of those that are decided to be kept and of those
    that the bucket needs.
    """

    def __init__(self, buckets: int, width: type, local: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]):
        self.buckets, self.width, self.local = buckets, width, local
        self.clear()

    def clear(self) -> None:
        self.hashes, self.places, self.ids, self.sizes, self.at, self.n = [], [], [], [], 0, 0

    def add(self, hashes: np.ndarray, places: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.hashes.append(hashes)
        self.places.append(places + self.at)
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.at += int(sizes.sum())
        self.n += len(hashes)
        if self.n >= GATHER:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            hashes, places, ids, sizes = (np.concatenate(x) for x in (self.hashes, self.places, self.ids, self.sizes))
            self.clear()
            starts = np.cumsum(sizes) - sizes
            doc = np.searchsorted(starts, places, "right") - 1
            within = places - starts[doc]
            kept, sent = self.local(hashes, ids[doc], within)
            yield from decided(ids[doc[kept]].astype(np.int64), within[kept], self.buckets)
            rows = list(pack_postings(hashes[sent], places[sent], ids, sizes, self.buckets, self.width))
            for i in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows[i : i + 64]], pa.int64()), pa.array([r for _, r in rows[i : i + 64]], pa.binary())], schema=PACKED)


def dealt(packed: DataFrame) -> DataFrame:
    """Packed rows with each bucket in one partition, in order; buckets are dealt out evenly."""
    n = parts(packed.sparkSession)
    return packed.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket")


def each_bucket(batches: Iterator[pa.RecordBatch], done: Callable[[list[bytes]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """done() of the packed rows of each bucket of a partition that is sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if bucket != now and held:
                yield from done(held)
                held = []
            now = bucket
            held.append(raw.as_py())
    if held:
        yield from done(held)


def by_document(packed: DataFrame) -> DataFrame:
    """(doc_id, spans): one row for each document of packed values, its values as uint32."""

    def done(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        docs, values = (np.concatenate(c) for c in zip(*map(_unpack_values, held), strict=True))
        order = np.argsort(docs, kind="stable")
        docs, values = docs[order], values[order]
        heads = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
        ends = np.append(heads[1:], len(docs))
        for at in range(0, len(heads), 5000):
            rows = [values[a:b].tobytes() for a, b in zip(heads[at : at + 5000], ends[at : at + 5000], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs[heads[at : at + 5000]]), pa.array(rows, pa.binary())], schema=LISTS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each_bucket(batches, done)

    return dealt(packed).mapInArrow(work, LISTS_DDL)


class Found:
    """Gathers (document, values) of a partition's buckets and packs them by document when they are many."""

    def __init__(self, buckets: int, most: int = 2_000_000):
        self.buckets, self.most, self.docs, self.values, self.n = buckets, most, [], [], 0

    def add(self, docs: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.docs.append(docs)
        self.values.append(values)
        self.n += len(docs)
        if self.n >= self.most:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            docs, values = np.concatenate(self.docs), np.concatenate(self.values)
            self.docs, self.values, self.n = [], [], 0
            yield from pack_values(docs, values, self.buckets)


def by_bucket(packed: DataFrame, judge: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], width: type) -> DataFrame:
    """(doc_id, spans): for each document the positions whose postings a bucket's judge keeps.

    judge gets a bucket's hashes, documents and positions and returns a mask.
    """
    return by_document(_judged(packed, judge, width, parts(packed.sparkSession)))


def _judged(packed: DataFrame, judge: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], width: type, buckets: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(buckets)

        def done(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            open_, known = split_decided(held)
            for docs, values in known:
                yield from found.add(docs, values[:, 0])
            if open_:
                h, d, p = (np.concatenate(c) for c in zip(*(unpack_postings(raw, width) for raw in open_), strict=True))
                keep = judge(h, d, p)
                yield from found.add(d[keep], p[keep])

        yield from each_bucket(batches, done)
        yield from found.out()

    return dealt(packed).mapInArrow(work, PACKED_DDL)


def with_lists(documents: DataFrame, lists: DataFrame) -> DataFrame:
    """Documents (doc_id, text) with the packed values of their id, null if there are none."""
    return documents.join(lists.withColumnRenamed("spans", "lists"), "doc_id", "left").select("doc_id", "text", "lists")
