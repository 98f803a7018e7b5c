"""Media columns: signature sniffing with an Aho-Corasick automaton, validated structures, carved media.

Magic bytes of all known formats are found in one pass over a blob. A find counts only if the format's
validator confirms its structure and yields its length within the blob, so two-letter magics in text do not.
The type found at the start corrects a declared type; media found further in are carved, the outermost first.

`stored` writes texts as lossless 8-bit media (the format follows from the content), `sniffed` decodes them by
what was found, whatever was declared, and `carved` cuts all confirmed media out of blobs.

Edge cases: null and empty texts are stored as one padded unit; very long ones are one medium each; null and empty
blobs have no media; truncated media are not confirmed; of media that begin at one place (ties) the one whose magic
ends first counts; equal texts and repeated rows give equal values; null ids stay null; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import small_batches

UNIT = 192
#: Magic bytes of the formats, and where they lie from the format's start.
SIGNATURES = {
    b"RIFF": ("riff", 0), b"BM": ("bmp", 0), b"\x89PNG\r\n\x1a\n": ("png", 0), b".snd": ("au", 0), b"GIF87a": ("gif", 0), b"GIF89a": ("gif", 0),
    b"\xff\xd8\xff": ("jpeg", 0), b"fLaC": ("flac", 0), b"OggS": ("ogg", 0), b"ftyp": ("mp4", 4), b"FORM": ("aiff", 0), b"P5\n": ("pgm", 0),
}
TYPES = ("wav", "bmp", "png", "au")


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(b):
        return None
    size, form = struct.unpack_from("<I4s", b, at + 4)
    kind = {b"WAVE": "wav", b"AVI ": "avi", b"WEBP": "webp"}.get(form)
    end = at + 8 + size
    if not kind or size < 4 or end > len(b):
        return None
    place, seen = at + 12, set()
    while place + 8 <= end:
        name, length = struct.unpack_from("<4sI", b, place)
        seen.add(name)
        place += 8 + length + length % 2
    if place not in (end, end + 1) or kind == "wav" and not {b"fmt ", b"data"} <= seen:
        return None
    return kind, 8 + size


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 54 > len(b):
        return None
    size, spare, offset, header, width, height, planes, bits, packed, image = struct.unpack_from("<IIIIiiHHII", b, at + 2)
    if spare or planes != 1 or header < 40 or offset < 14 + header or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or height == 0 or at + size > len(b):
        return None
    if packed == 0 and offset + (width * bits + 31) // 32 * 4 * abs(height) != size:
        return None
    return "bmp", size


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    place, first = at + 8, True
    while place + 12 <= len(b):
        length, name = struct.unpack_from(">I4s", b, place)
        if place + 12 + length > len(b) or first != (name == b"IHDR"):
            return None
        if zlib.crc32(b[place + 4 : place + 8 + length]) != struct.unpack_from(">I", b, place + 8 + length)[0]:
            return None
        first, place = False, place + 12 + length
        if name == b"IEND":
            return "png", place - at
    return None


def _au(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 24 > len(b):
        return None
    offset, size, coding, rate, channels = struct.unpack_from(">IIIII", b, at + 4)
    if offset < 24 or not 1 <= coding <= 27 or not rate or not 1 <= channels <= 255 or size == 0xFFFFFFFF or at + offset + size > len(b):
        return None
    return "au", offset + size


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    place = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
    while place < len(b):
        mark = b[place]
        if mark == 0x3B:
            return "gif", place + 1 - at
        if mark == 0x21:
            place += 2
        elif mark == 0x2C and place + 10 < len(b):
            own = b[place + 9]
            place += 10 + (3 << (own & 7) + 1 if own & 0x80 else 0) + 1
        else:
            return None
        while place < len(b) and b[place]:
            place += b[place] + 1
        place += 1
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    place, frames, scans = at + 2, 0, 0
    while place + 4 <= len(b) and b[place] == 0xFF:
        mark = b[place + 1]
        if mark == 0xFF:  # a fill byte
            place += 1
            continue
        length = struct.unpack_from(">H", b, place + 2)[0]
        if mark < 0xC0 or 0xD0 <= mark <= 0xD8 or length < 2 or place + 2 + length > len(b):
            return None
        frames += 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC)
        place += 2 + length
        if mark == 0xDA:
            scans += 1
            # Coded data: a 0xFF in it is followed by 0 or a restart mark.
            place = b.find(b"\xff", place)
            while 0 <= place < len(b) - 1 and (b[place + 1] == 0 or 0xD0 <= b[place + 1] <= 0xD7):
                place = b.find(b"\xff", place + 2)
            if place < 0 or place >= len(b) - 1:
                return None
        if b[place : place + 2] == b"\xff\xd9":
            return ("jpeg", place + 2 - at) if frames and scans else None
    return None


def _crc_table(width: int, polynomial: int) -> list[int]:
    out = []
    for byte in range(256):
        value = byte << (width - 8)
        for _ in range(8):
            value = (value << 1 ^ polynomial * (value >> (width - 1))) & ((1 << width) - 1)
        out.append(value)
    return out


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _flac_header(b: bytes, at: int) -> tuple[int, int] | None:
    """(length, samples) of the frame header at a place, if its checksum holds; samples 0 if only STREAMINFO has them."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8 or not b[at + 2] >> 4 or b[at + 2] & 15 == 15 or b[at + 3] & 1:
        return None
    first, size, rate = b[at + 4], b[at + 2] >> 4, b[at + 2] & 15
    ones = 8 - (first ^ 0xFF).bit_length()  # bytes of the frame's number, as UTF-8 counts them
    if ones == 1 or ones > 7:
        return None
    end = at + 4 + max(1, ones)
    wide, coded = {6: 1, 7: 2}.get(size, 0), {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end + wide + coded + 1 > len(b):
        return None
    samples = 192 if size == 1 else 576 << (size - 2) if size < 6 else int.from_bytes(b[end : end + wide], "big") + 1 if size < 8 else 256 << (size - 8)
    check = 0
    for x in b[at : end + wide + coded]:
        check = _CRC8[check ^ x]
    return (end + wide + coded + 1 - at, samples) if check == b[end + wide + coded] else None


def _flac(b: bytes, at: int) -> tuple[str, int] | None:
    place, last = at + 4, False
    if place + 38 > len(b) or b[place] & 0x7F or int.from_bytes(b[place + 1 : place + 4], "big") != 34:
        return None
    info = b[place + 4 : place + 38]
    least, total = int.from_bytes(info[4:7], "big"), int.from_bytes(info[13:18], "big") & ((1 << 36) - 1)
    while not last:
        if place + 4 > len(b) or b[place] & 0x7F == 127:
            return None
        last = b[place] >> 7
        place += 4 + int.from_bytes(b[place + 1 : place + 4], "big")
    samples = 0
    while samples < total or not total:
        head = _flac_header(b, place)
        if not head:
            break
        samples += head[1]
        done = bool(total) and samples >= total
        # A frame ends where its checksum comes out, before another frame or at the last sample.
        check, end, floor = 0, place, place + max(head[0] + 2, least)
        while end < len(b):
            check = (check << 8 & 0xFFFF) ^ _CRC16[check >> 8 ^ b[end]]
            end += 1
            if not check and end >= floor and (done or _flac_header(b, end) or (not total and end == len(b))):
                break
        else:
            return None
        place = end
    return ("flac", place - at) if samples >= max(total, 1) else None


_MIRROR = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def _ogg(b: bytes, at: int) -> tuple[str, int] | None:
    place, streams = at, set()
    while b[place : place + 5] == b"OggS\x00" and place + 27 <= len(b):
        n, flags, serial = b[place + 26], b[place + 5], b[place + 14 : place + 18]
        end = place + 27 + n + sum(b[place + 27 : place + 27 + n])
        if end > len(b) or (place == at) and not flags & 2:
            return None
        # The page's checksum is that of zlib with the bits of each byte mirrored, from 0 and without a last inversion.
        page = b[place : place + 22] + bytes(4) + b[place + 26 : end]
        mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
        if int(f"{mirrored:032b}"[::-1], 2) != int.from_bytes(b[place + 22 : place + 26], "little"):
            return None
        if flags & 2:
            streams.add(serial)
        if flags & 4:
            streams.discard(serial)
        place = end
        if not streams:
            return "ogg", place - at
    return None


def _mp4(b: bytes, at: int) -> tuple[str, int] | None:
    place, boxes = at, 0
    while place >= 0 and place + 8 <= len(b):
        size, name = struct.unpack_from(">I4s", b, place)
        if size < 8 or place + size > len(b) or not name.isalnum() or boxes == 0 and (name != b"ftyp" or size > 1024):
            break
        place, boxes = place + size, boxes + 1
    return ("mp4", place - at) if boxes > 1 else None


def _aiff(b: bytes, at: int) -> tuple[str, int] | None:
    if at + 12 > len(b) or b[at + 8 : at + 12] not in (b"AIFF", b"AIFC"):
        return None
    end = at + 8 + struct.unpack_from(">I", b, at + 4)[0]
    place, seen = at + 12, set()
    while place + 8 <= min(end, len(b)):
        name, length = struct.unpack_from(">4sI", b, place)
        seen.add(name)
        place += 8 + length + length % 2
    return ("aiff", end - at) if end <= len(b) and place in (end, end + 1) and {b"COMM", b"SSND"} <= seen else None


def _pgm(b: bytes, at: int) -> tuple[str, int] | None:
    head = b[at + 3 : at + 40].split(None, 3)
    if len(head) < 4 or not all(x.isdigit() and len(x) < 9 for x in head[:3]) or int(head[2]) != 255:
        return None
    start = b.index(head[2], b.index(head[1], b.index(head[0], at + 3) + len(head[0])) + len(head[1])) + len(head[2]) + 1
    size = int(head[0]) * int(head[1])
    return ("pgm", start + size - at) if size and start + size <= len(b) else None


VALIDATORS = {"riff": _riff, "bmp": _bmp, "png": _png, "au": _au, "gif": _gif, "jpeg": _jpeg, "flac": _flac, "ogg": _ogg, "mp4": _mp4, "aiff": _aiff, "pgm": _pgm}


class Sniffer:
    """The automaton of all signatures."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for magic, (kind, before) in SIGNATURES.items():
            self.automaton.add_word(magic.decode("latin-1"), (kind, before + len(magic) - 1))
        self.automaton.make_automaton()

    def media(self, blob: bytes) -> list[tuple[str, int, int]]:
        """(type, start, length) of the confirmed media, in order; those inside another are part of it."""
        out: list[tuple[str, int, int]] = []
        end = 0
        for last, (kind, back) in self.automaton.iter(blob.decode("latin-1")):
            at = last - back
            if at >= end and (found := VALIDATORS[kind](blob, at)):
                out.append((found[0], at, found[1]))
                end = at + found[1]
        return out


def encode(kind: str, payload: bytes) -> bytes:
    """A payload of whole units as a medium of 8-bit samples."""
    n = len(payload)
    if kind == "wav":
        return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
    if kind == "bmp":
        return struct.pack("<2sIIIIiiHHIIiiII", b"BM", 54 + n, 0, 54, 40, UNIT // 3, -(n // UNIT), 1, 24, 0, n, 2835, 2835, 0, 0) + payload
    if kind == "au":
        return struct.pack(">4sIIIII", b".snd", 24, n, 2, 8000, 1) + payload
    if kind == "png":
        rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
        raw = np.concatenate((np.zeros((len(rows), 1), np.uint8), rows), axis=1).tobytes()
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")
    raise ValueError(f"no encoder for {kind}")


def decode(kind: str, medium: bytes) -> bytes:
    """The samples of a confirmed medium that `encode` writes."""
    if kind == "wav":
        place = 12
        while medium[place : place + 4] != b"data":
            length = struct.unpack_from("<I", medium, place + 4)[0]
            place += 8 + length + length % 2
        return medium[place + 8 : place + 8 + struct.unpack_from("<I", medium, place + 4)[0]]
    if kind == "bmp":
        return medium[struct.unpack_from("<I", medium, 10)[0] :]
    if kind == "au":
        return medium[struct.unpack_from(">I", medium, 4)[0] :]
    if kind == "png":
        place, packed = 8, b""
        while place < len(medium):
            length, name = struct.unpack_from(">I4s", medium, place)
            if name == b"IDAT":
                packed += medium[place + 8 : place + 8 + length]
            place += 12 + length
        width = struct.unpack_from(">I", medium, 16)[0]
        return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()
    raise ValueError(f"no decoder for {kind}")


def padded(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text padded to whole units)."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT)


def formats(payload: bytes) -> tuple[str, str]:
    """(format, declared type) that a payload is stored with: one in eight is declared wrongly."""
    key = zlib.crc32(payload)
    kind = TYPES[key % len(TYPES)]
    return kind, kind if key // 4 % 8 else TYPES[(key + 1) % len(TYPES)]


def describe(samples: bytes) -> str:
    """Mean, deviation and share of edges of 8-bit samples, and those of their changes."""
    x = np.frombuffer(samples, np.uint8)
    step = np.abs(np.diff(x.astype(np.int16)))
    return f"mean={x.mean():.3f};sd={x.std():.3f};max={x.max()};step={step.mean():.3f}"


def stored(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as media columns: doc_id, declared, n_bytes, medium (binary)."""
    small_batches(documents.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("declared", pa.string()), ("n_bytes", pa.int64()), ("medium", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                n, payload = padded(text.as_py())
                kind, declared = formats(payload)
                rows.append((declared, n, encode(kind, payload)))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True))], schema=schema)

    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, "doc_id bigint, declared string, n_bytes bigint, medium binary")


def sniffed(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, medium, declared) with what is found in them, read back by the sniffed type."""
    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("declared", pa.string()), ("media_type", pa.string()), ("n_embedded", pa.int64())]
    schema = pa.schema(names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            rows = []
            for doc_id, n, declared, medium in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "declared", "medium")), strict=True):
                found = sniffer.media(medium or b"")
                kind, samples = None, b""
                if found and found[0][1] == 0:
                    kind = found[0][0]
                    samples = decode(kind, medium[: found[0][2]]) if kind in TYPES else b""
                feature = f"type={kind};{describe(samples)}" if samples else f"type={kind}"
                rows.append((doc_id, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(medium or b""), hashlib.sha256(medium or b"").hexdigest(), feature, declared, kind, len(found) - (kind is not None)))
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, names, strict=True)], schema=schema)

    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "declared", "medium").mapInArrow(work, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, declared string, media_type string, n_embedded bigint")


def carved(blobs: DataFrame, id_col: str = "blob_id", blob_col: str = "blob") -> DataFrame:
    """One row per confirmed medium in each blob: blob_id, number, media_type, start, length, sha256, medium."""
    names = [("blob_id", pa.int64()), ("number", pa.int32()), ("media_type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string()), ("medium", pa.binary())]
    schema = pa.schema(names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            rows = []
            for blob_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (kind, at, n) in enumerate(sniffer.media(blob or b"")):
                    own = blob[at : at + n]
                    rows.append((blob_id, k, kind, at, n, hashlib.sha256(own).hexdigest(), own))
            columns = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, names, strict=True)], schema=schema)

    small_batches(blobs.sparkSession)
    return blobs.select(F.col(id_col).cast("bigint").alias("blob_id"), F.col(blob_col).cast("binary").alias("blob")).mapInArrow(work, "blob_id bigint, number int, media_type string, start bigint, length bigint, sha256 string, medium binary")
