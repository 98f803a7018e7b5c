"""Columns of text as flat NumPy arrays: word spans, 64-bit word hashes, rolling window hashes.

A column of n texts is one uint8 array of their UTF-8 bytes and n+1 offsets, so that every step is one
vector operation over a block of documents. Separators are ASCII, so byte classes never split a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are worked on at once, so that their arrays of numbers stay in cache (a longer document is a block of its own).
BLOCK = 100_000
#: Powers of a base that are kept.
POWERS = 1 << 21

_BYTE_BASE = U(0x9E3779B97F4A7C15)
_WORD_BASE = U(0xD6E8FEB86659FD93)

#: Byte classes.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose bytes are at most `most`, one longer document alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**j and base**-j modulo 2**64 for j below n (kept for the usual sizes)."""
    have = _POWERS.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = U(pow(int(base), -1, 1 << 64))
        ups, downs = np.full(size, base, U), np.full(size, inverse, U)
        ups[0] = downs[0] = 1
        have = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
        if size <= POWERS:
            _POWERS[int(base)] = have
    return have[0][:n], have[1][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets of the documents) of the maximal runs of bytes of a kind within documents."""
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, finalised with its length."""
    if not len(starts):
        return np.zeros(0, U)
    ups, downs = _powers(_BYTE_BASE, len(data))
    sums = np.add(data, 1, dtype=U)
    sums *= ups
    np.cumsum(sums, out=sums)
    before = sums[np.maximum(starts - 1, 0)]
    before[starts == 0] = 0
    out = sums[ends - 1]
    out -= before
    out *= downs[starts]
    out += (ends - starts).astype(U) * U(0xA24BAED4963EE407)
    return mix(out)


def window_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every `size` consecutive values (whatever document they are of)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    ups, downs = _powers(_WORD_BASE, len(values))
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * ups, out=sums[1:])
    out = sums[size:] - sums[:-size]
    out *= downs[:n]
    return mix(out)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def segments(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. count-1 for each count, end to end."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, .. for each (start, count), end to end."""
    return np.repeat(starts, counts) + segments(counts)
