"""Repeated byte strings by merging shard Burrows-Wheeler transforms.

A repeat of `length` bytes is content-addressed by its minimizer, the `gram` bytes within it of least hash:
equal strings have equal minimizers, so

1. minimizers are sent as postings, and those of one document only are dropped (they cannot repeat);
2. around the others each document cuts segments: the stretches of consecutive windows that share a minimizer.
   Segments go to the bucket of their minimizer, so all places of a repeat meet in one bucket;
3. `settle` decides the segments of a bucket (those of frequent minimizers first among what a task has gathered).
   Windows whose hash no other document has are left out. The rest is dealt into shards, each shard's
   Burrows-Wheeler transform is built, and the transforms are merged by interleave refinement (Holt and McMillan,
   2014): the interleave, at first shard after shard, is re-sorted stably by the symbols that it reads, once per
   symbol of depth. Places where neighbours come to differ give the common prefixes; what is still together after
   `length` rounds is a repeated interval. No suffix is sorted again. Its least document keeps the string, the
   others lose it. Where the segments of one minimizer fill several merges, what these leave is merged again, in
   larger and larger ones, until all of it was in one;
4. documents drop the union of their repeated windows.

So minimizers and hashes route and prune, and a merged transform decides each removal, on the bytes themselves.
Nothing is formed per pair of documents, and of a string in a third of all documents a bucket gets at most `HOT`
places for each `SEGMENTS` bytes that a task gathered: frequent ones are settled there first.

Edge cases: null and empty texts have no bytes; very long texts are worked on alone; an empty table gives an empty
result; exact copies keep the least id; rows that repeat an id are one document and do not remove each other (if
their texts differ, repeats found in one are cut at the same places in the other); rows without an id count as the
largest id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._flat import BLOCK, U, blocks, flat, ranges, runs, window_hashes
from ._postings import NO_ID, PACKED, PACKED_DDL, Found, Gather, bucket_count, by_bucket, by_document, dealt, decided, each_bucket, split_decided, unpack_lists, with_lists
from ._shared import parts, small_batches

LENGTH, GRAM = 50, 16
#: Bytes of segments that are gathered before they are sent, and of one shard; shards of a merge; windows pruned at once.
SEGMENTS, SHARD, SHARDS, PRUNED = 8_000_000, 15_000, 4, 100_000
#: Segments of one minimizer that a task sends of those it has gathered, about.
HOT = 32


def slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or largest of every `width` consecutive values."""
    op = np.minimum if least else np.maximum
    size = 1
    while 2 * size <= width and len(x) > size:
        x = op(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return op(x[:-rest], x[rest:]) if rest and len(x) > rest else x[: len(x) - rest] if rest else x


def minimizers(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, least of each window's, windows that lie in one document); windows start at each byte."""
    hashes = window_hashes(data.astype(U) + U(1), gram)
    width = length - gram + 1
    n = max(0, len(hashes) - width + 1)
    least = slide(hashes, width, True)[:n] if n else np.zeros(0, U)
    inside = np.zeros(n, bool)
    inside[ranges(offsets[:-1], np.maximum(np.diff(offsets) - length + 1, 0))] = True
    return hashes, least, inside


def chosen(hashes: np.ndarray, least: np.ndarray, inside: np.ndarray, width: int) -> np.ndarray:
    """Places of grams that are the least of some window."""
    if not len(least):
        return np.zeros(0, np.int64)
    most = slide(np.concatenate((np.zeros(width - 1, U), np.where(inside, least, U(0)), np.zeros(width - 1, U))), width, False)
    return np.flatnonzero(most[: len(hashes)] == hashes)


def in_two(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Mask of the postings whose hash several documents have."""
    if not len(hashes):
        return np.zeros(0, bool)
    order = np.argsort(hashes)
    ordered, doc = hashes[order], docs[order]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    several = np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)
    keep = np.empty(len(hashes), bool)
    keep[order] = np.repeat(several, np.diff(np.append(heads, len(ordered))))
    return keep


def in_two_here(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(postings whose hash several of these documents have, postings that others need): two documents' of such a hash."""
    several = in_two(hashes, docs, places)
    sent = ~several
    at = np.flatnonzero(several)
    order = at[np.lexsort((docs[at], hashes[at]))]
    new = np.append(True, hashes[order[1:]] != hashes[order[:-1]])[: len(order)]
    sent[order[new]] = sent[order[np.append(new[1:], True)[: len(order)]]] = True
    return several, sent


def postings(documents: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """Packed postings of the minimizers of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gather = Gather(buckets, np.uint32, in_two_here)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            data, offsets = flat(batch.column("text"))
            for a, b in blocks(offsets, BLOCK):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, least, inside = minimizers(part, own, length, gram)
                at = chosen(hashes, least, inside, length - gram + 1)
                yield from gather.add(hashes[at], at, ids[a:b], np.diff(own))
        yield from gather.out()

    return documents.mapInArrow(work, PACKED_DDL)


def _pack_segments(key: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray, text: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    bucket = (key % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    starts = np.cumsum(size) - size
    bucket = bucket[order]
    heads = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(heads, np.append(heads[1:], len(bucket)), strict=True):
        who = order[a:b]
        body = b"".join((key[who].tobytes(), doc[who].astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), place[who].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), size[who].astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), text[ranges(starts[who], size[who])].tobytes()))
        yield int(bucket[a]), np.array([b - a, len(body)], np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unpack_segments(raw: bytes) -> tuple[np.ndarray, ...]:
    """(key, document, place, size, text) of packed segments."""
    n, total = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    body = np.frombuffer(pa.decompress(raw[16:], decompressed_size=total, codec="zstd", asbytes=True), np.uint8)
    plane = lambda at, width, kind: np.ascontiguousarray(body[at : at + width * n].reshape(width, n).T).view(kind).ravel()
    return body[: 8 * n].view(U), plane(8 * n, 8, np.int64), plane(16 * n, 4, np.uint32).astype(np.int64), plane(20 * n, 4, np.uint32).astype(np.int64), body[24 * n :]


def _taken(columns: list[np.ndarray], mask: np.ndarray) -> list[np.ndarray]:
    """The segments (key, document, place, size, text) of a mask."""
    size = columns[3]
    return [*(c[mask] for c in columns[:4]), columns[4][np.repeat(mask, size)]]


def segments(anchored: DataFrame, length: int, gram: int, shard: int, buckets: int) -> DataFrame:
    """Packed segments around the minimizers that several documents have, without the windows that a task decides itself."""
    width = length - gram + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                held.clear()
                # Frequent minimizers are settled here, so that their bucket gets what is left of them.
                _, of_key, counts = np.unique(columns[0], return_inverse=True, return_counts=True)
                hot = counts[of_key] > HOT
                rows = list(_pack_segments(*_taken(columns, ~hot), buckets))
                if hot.any():
                    (doc, first, count), left = settle(*_taken(columns, hot), length, shard)
                    yield from decided(doc, np.stack((first, count), axis=1), buckets)
                    rows += _pack_segments(*left, buckets)
                for i in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + 64]], pa.int64()), pa.array([r for _, r in rows[i : i + 64]], pa.binary())], schema=PACKED)

        size_held = 0
        for batch in batches:
            ids, lists = batch.column("doc_id").to_numpy(), batch.column("lists").to_pylist()
            data, offsets = flat(batch.column("text"))
            for a, b in blocks(offsets, BLOCK):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                hashes, least, inside = minimizers(part, own, length, gram)
                if not len(least):
                    continue
                at = np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(x, np.uint32) + own[d] for d, x in enumerate(lists[a:b]) if x])
                at = at[at < len(hashes)]
                # Windows whose least hash is that of a wanted gram in them.
                of_wanted = np.full(len(hashes), ~U(0))
                of_wanted[at] = hashes[at]
                wanted = slide(of_wanted, width, True)[: len(least)] == least
                wanted &= inside
                wanted_at = np.flatnonzero(wanted)
                if not len(wanted_at):
                    continue
                new = np.ones(len(wanted_at), bool)
                doc_of = np.searchsorted(own, wanted_at, "right") - 1
                new[1:] = (np.diff(wanted_at) > 1) | (least[wanted_at[1:]] != least[wanted_at[:-1]]) | (doc_of[1:] != doc_of[:-1])
                heads = np.flatnonzero(new)
                count = np.diff(np.append(heads, len(wanted_at)))
                first, doc = wanted_at[heads], doc_of[heads]
                size = count + length - 1
                held.append((least[first], ids[a:b][doc], first - own[doc], size, part[ranges(first, size)]))
                size_held += int(size.sum())
                if size_held >= SEGMENTS:
                    yield from out()
                    size_held = 0
        yield from out()

    return anchored.where("lists is not null").mapInArrow(work, PACKED_DDL)


class Shard:
    """Burrows-Wheeler transform of texts end to end, each with an end mark and each a cycle of its own.

    Rows are sorted by their first `depth` symbols at least.
    """

    def __init__(self, text: np.ndarray, sizes: np.ndarray, depth: int):
        whole = sizes + 1
        ends = np.cumsum(whole)
        firsts = ends - whole
        # UTF-8 has no byte 255, so byte + 1 and the end mark 0 fit.
        symbols = np.zeros(int(ends[-1]), np.uint8)
        symbols[ranges(firsts, sizes)] = text + np.uint8(1)
        n = len(symbols)
        follow = np.arange(1, n + 1)
        follow[ends - 1] = firsts
        # Eight symbols of each suffix are one number; from there on as many ranks as fit are.
        key, ahead = symbols.astype(U), follow
        for bits in (8, 16, 32):
            key = key << U(bits) | key[ahead]
            ahead = ahead[ahead]
        width, step = n.bit_length(), 8
        while True:
            rows = np.argsort(key)
            if step >= depth:
                break
            ordered = key[rows]
            rank = np.empty(n, U)
            rank[rows] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
            key, behind = rank, ahead
            for _ in range(64 // width - 1):
                key = key << U(width) | rank[behind]
                behind = ahead[behind]
            ahead, step = behind, step * (64 // width)
        before = np.arange(-1, n - 1)
        before[firsts] = ends - 1
        self.symbols = symbols[before][rows]  #: the transform
        self.text_of = np.repeat(np.arange(len(sizes)), whole)[rows]
        self.place = (np.arange(n) - np.repeat(firsts, whole))[rows]
        self.row = np.empty(n, np.int64)  #: row of the suffix at each place of the texts end to end
        self.row[rows] = np.arange(n)
        #: Row of each row's suffix with its symbol before it; by the texts, as rows that agree in all symbols compared are in any order.
        self.step = self.row[before[rows]]
        self.text, self.ends, self.whole = symbols, ends, whole


def merge(shards: list[Shard], depth: int, windows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, prefixes): the shards' row (end to end) at each merged row, and the rows' common prefix with the row before, up to depth.

    Of windows of an even depth only their rows are merged: given the rows behind their ends, the interleave follows
    them through the transforms to their starts, and rows that no window passes are not touched. Their prefixes are
    told as depth or 0: whether a window is of the interval of the one before.

    Each round reads the interleave's symbols, two at a time, and re-sorts it stably by them: a row moves to that of
    its suffix with the symbols before it, so the interleave is ordered by two more symbols. Rows part where their
    symbols differ or where the suffixes behind the symbols had parted, and stay apart from then on.
    """
    sizes = np.array([len(s.symbols) for s in shards])
    base = np.cumsum(sizes) - sizes
    symbols = np.concatenate([s.symbols for s in shards])
    step = np.concatenate([s.step + at for s, at in zip(shards, base, strict=True)])
    # Two steps on and the symbols read on the way, as one number.
    ways = step[step] << 16 | symbols[step].astype(np.int64) << 8 | symbols
    interleave = np.arange(len(symbols)) if windows is None else np.sort(windows)
    n, rounds = len(interleave), -(-depth // 2)
    group = np.zeros(n, np.int64)
    parted = np.zeros(n, np.uint8)  # rounds after which a row is parted from the one before
    new = np.zeros(n, np.uint8)
    new[:1] = 1
    for _ in range(rounds):
        way = ways.take(interleave)
        order = np.argsort(way.astype(np.uint16), kind="stable")
        way = way.take(order)
        interleave = way >> 16
        # Rows behind one another are told apart by their group and the symbols before it, as one number.
        way &= 0xFFFF
        way |= group.take(order) << 16
        np.not_equal(way[1:], way[:-1], out=new[1:].view(bool))
        if windows is None:
            parted += new
        np.cumsum(new, out=group)
    if windows is not None:
        return interleave, np.where(new == 1, 0, depth)
    prefixes = 2 * (rounds - parted.astype(np.int64))
    prefixes[:1] = 0
    # Of the two symbols that parted rows, the first may be the same.
    text = np.concatenate([s.text for s in shards])
    cycle, place = (np.concatenate(x)[interleave] for x in ([s.whole[s.text_of] for s in shards], [s.place for s in shards]))
    first = np.concatenate([(s.ends - s.whole)[s.text_of] + at for s, at in zip(shards, base, strict=True)])[interleave]
    at = np.flatnonzero(prefixes[1:] < depth) + 1
    behind = lambda row: text[first[row] + (place[row] + prefixes[at]) % cycle[row]]
    prefixes[at] += behind(at) == behind(at - 1)
    return interleave, np.minimum(prefixes, depth)


def in_several(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Mask of the hashes that several documents have, by tables of slots; hashes that lose their slot go to the next table."""
    out = np.zeros(len(hashes), bool)
    left = np.arange(len(hashes))
    while len(left):
        bits = (2 * len(left)).bit_length()
        own, doc = hashes[left], docs[left]
        slot = (own >> U(64 - bits)).astype(np.int64)
        table, holder, shared = np.empty(1 << bits, U), np.empty(1 << bits, docs.dtype), np.zeros(1 << bits, bool)
        table[slot], holder[slot] = own, doc
        won = table[slot] == own
        slot = slot[won]
        shared[slot[holder[slot] != doc[won]]] = True
        out[left[won]] = shared[slot]
        left = left[~won]
        # Other bits of the hashes decide the next slots.
        hashes = hashes * U(0x9E3779B97F4A7C15)
    return out


def _several(text: np.ndarray, sizes: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first window, windows) of the stretches whose windows' hashes several documents may have; the others have none.

    Stretches that share bytes are one.
    """
    starts, windows = np.cumsum(sizes) - sizes, sizes - length + 1
    at = ranges(starts, windows)
    hashes = window_hashes(text.astype(U) + U(1), length)[at]
    own = np.repeat(np.unique(doc, return_inverse=True)[1].astype(np.int32), windows)
    mask = np.zeros(len(text), bool)
    mask[at] = in_several(hashes, own)
    a, b = runs(mask)
    if not len(a):
        return a, a, a
    segment = np.searchsorted(starts, a, "right") - 1
    new = np.append(True, (a[1:] - b[:-1] >= length) | (segment[1:] != segment[:-1]))
    heads = np.flatnonzero(new)
    last = b[np.append(heads[1:], len(a)) - 1]
    return segment[heads], a[heads] - starts[segment[heads]], last - a[heads]


def settle(key: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray, text: np.ndarray, length: int, shard: int = SHARD, keep: bool = True) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """((document, first window, windows), segments that are left if they are kept): the runs of windows whose string a smaller document has among these segments."""
    starts, windows = np.cumsum(size) - size, size - length + 1
    gone = np.zeros(len(text), bool)  # by the first byte of each window
    order = np.argsort(key, kind="stable")
    total = np.cumsum(windows[order])
    # Whole minimizers, about PRUNED windows at a time.
    cuts = np.flatnonzero((np.diff(total // PRUNED) > 0) & (key[order[1:]] != key[order[:-1]])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True):
        who = order[a:b]
        if not len(who):
            continue
        own, first, count = _several(text[ranges(starts[who], size[who])], size[who], doc[who], length)
        who = who[own]
        most = SHARDS * shard
        begin = starts[who] + first
        while len(who):
            begin, count, who = _merged(text, key, doc, begin, count, who, gone, length, shard, most)
            most *= SHARDS

    def cut(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = runs(mask)
        return np.searchsorted(starts, a, "right") - 1, a, b - a

    lost, from_, n = cut(gone)
    lost = doc[lost], place[lost] + from_ - starts[lost], n
    if not keep:
        return lost, ()
    inside = np.zeros(len(text), bool)
    inside[ranges(starts, windows)] = True
    kept, begin, m = cut(inside & ~gone)
    width = m + length - 1
    return lost, (key[kept], doc[kept], place[kept] + begin - starts[kept], width, text[ranges(begin, width)])


def _merged(text: np.ndarray, key: np.ndarray, doc: np.ndarray, begin: np.ndarray, count: np.ndarray, who: np.ndarray, gone: np.ndarray, length: int, shard: int, most: int) -> tuple[np.ndarray, ...]:
    """Mark in `gone` the windows (count from begin, of segments `who`, in order of keys) that merges of about `most` bytes decide; what is left to be merged again (begin, count, segment)."""
    bytes_ = count + length - 1
    own = key[who]
    heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    of_key = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(own))))
    large = np.add.reduceat(bytes_, heads) > most
    limits = np.cumsum(bytes_) // most
    new_key = of_key[1:] != of_key[:-1]
    # A merge ends between minimizers; one that is larger than a merge is in merges of its own.
    ends = np.where(large[of_key[1:]] | large[of_key[:-1]], new_key | (np.diff(limits) > 0), new_key & (np.diff(limits) > 0))
    cuts = np.flatnonzero(ends) + 1
    for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True):
        if b - a > 1:
            t, p = _smaller(text, begin[a:b], bytes_[a:b], doc[who[a:b]], length, shard)
            gone[begin[a:b][t] + p] = True
    again = large[of_key]
    # The windows that are left of those that meet others once more.
    index = ranges(begin[again], count[again])
    stretch = np.repeat(np.flatnonzero(again), count[again])
    index, stretch = index[~gone[index]], stretch[~gone[index]]
    first = np.flatnonzero(np.append(True, (np.diff(index) != 1) | (np.diff(stretch) != 0))[: len(index)])
    return index[first], np.diff(np.append(first, len(index))), who[stretch[first]]


def _smaller(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, length: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) pairs whose string a text of a smaller document has, by merged transforms of shards."""
    edges = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(1, int(sizes.sum()) // shard + 1) * shard, "right"))
    edges = np.unique(np.concatenate(([0], edges, [len(sizes)])))
    if len(edges) == 2:
        edges = np.array([0, len(sizes) // 2, len(sizes)])
    shards = [Shard(text[ranges(starts[a:b], sizes[a:b])], sizes[a:b], length) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    base = np.cumsum([0, *(len(s.symbols) for s in shards[:-1])])
    # Windows of one text are neighbours; a row behind a window's end is known by its place.
    behind = [s.row[ranges(s.ends - s.whole + length, s.whole - length)] + at for s, at in zip(shards, base, strict=True)]
    order_of, prefixes = merge(shards, length, None if length % 2 else np.concatenate(behind))
    text_of = np.concatenate([s.text_of + a for s, a in zip(shards, edges[:-1], strict=True)])[order_of]
    place = np.concatenate([s.place for s in shards])[order_of]
    interval = np.cumsum(prefixes < length)
    window = np.flatnonzero(place + length <= sizes[text_of])
    interval, doc = interval[window], docs[text_of[window]]
    if not len(window):
        return window, window
    heads = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
    least = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.append(heads, len(interval))))
    lost = window[least < doc]
    return text_of[lost], place[lost]


def repeats(packed: DataFrame, length: int, shard: int) -> DataFrame:
    """(doc_id, spans): runs (first window, windows) as pairs of uint32, by document."""
    buckets = parts(packed.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(buckets)

        def done(held: list[bytes]) -> Iterator[pa.RecordBatch]:
            open_, known = split_decided(held)
            for doc, values in known:
                yield from found.add(doc, values)
            if open_:
                (doc, first, count), _ = settle(*(np.concatenate(c) for c in zip(*map(_unpack_segments, open_), strict=True)), length, shard, False)
                yield from found.add(doc, np.stack((first, count), axis=1))

        yield from each_bucket(batches, done)
        yield from found.out()

    return by_document(dealt(packed).mapInArrow(work, PACKED_DDL))


def removal(documents: DataFrame, *, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", keep_spans: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the removed spans if asked for)."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = bucket_count(documents, spark)
    anchored = with_lists(docs, by_bucket(postings(docs, length, gram, buckets), in_two, np.uint32))
    found = repeats(segments(anchored, length, gram, shard, buckets), length, shard)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("spans", pa.list_(span))] * keep_spans

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("doc_id").to_pylist(), batch.column("lists").to_pylist()
            data, offsets = flat(batch.column("text"))
            rows = []
            for d, doc_id in enumerate(ids):
                own = data[offsets[d] : offsets[d + 1]]
                n, spans = len(own), []
                if lists[d]:
                    pairs = unpack_lists(lists[d], 2)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.minimum(pairs[:, 0], n), 1)
                    np.add.at(edge, np.minimum(pairs[:, 0] + pairs[:, 1] + length - 1, n), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = list(zip(*(x.tolist() for x in runs(gone)), strict=True))
                    own = own[~gone]
                row = (None if doc_id == NO_ID else doc_id, n, n - len(own), len(spans), hashlib.sha256(own.tobytes()).hexdigest())
                rows.append(row + ([{"start": s, "end": e} for s, e in spans],) * keep_spans)
            columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    return with_lists(docs, found).mapInArrow(work, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", spans array<struct<start:bigint,end:bigint>>" * keep_spans)
