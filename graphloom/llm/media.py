"""Media columns: store bytes in a media container and sniff what they really are.

``sniff`` runs one Aho-Corasick pass over the bytes to locate magic numbers and
the end marks of formats, and lets a validator of each format confirm the
structure and find the length. The format found at offset 0 corrects the declared
type; formats confirmed further inside are carved as embedded media. Validators
look end marks up in the list of the pass, and chains of blocks that meet are
walked once, so text of any kind takes time in proportion to its length. (Binary
files made for it can still let checksums or gzip streams overlap.)

A text of any length is handled row by row, in memory of a few times its size. A
null text is an empty one; an empty one stores 64 zero bytes. Repeated rows and
equal texts give equal results, an empty table an empty one. Magic numbers that
end at one place count in the order of the automaton. Extra columns aren't read,
whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_RATE = 8000
BLOCK = 64


class Blob:
    """Bytes with the places of all marks, and what is known of chains of blocks."""

    def __init__(self, data: bytes, marks: dict[bytes, list[int]]):
        self.data, self.marks = data, marks
        self.known: dict[tuple[str, int], int | None] = {}
        self.archives: dict[int, int] | None = None

    def next_mark(self, mark: bytes, at: int) -> int:
        """The first place of ``mark`` from ``at`` on, or -1."""
        places = self.marks.get(mark, [])
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def chain(self, kind: str, pos: int, step: Callable[[bytes, int], tuple[int | None, bool]]) -> int | None:
        """The end of the chain of blocks at ``pos``, None if it breaks; ``step`` gives the next place and whether it is the end."""
        passed = []
        while True:
            if (kind, pos) in self.known:
                end = self.known[kind, pos]
                break
            passed.append(pos)
            try:
                after, last = step(self.data, pos)
            except (struct.error, IndexError):
                after, last = None, True
            if last:
                end = after
                break
            pos = after
        for p in passed:
            self.known[kind, p] = end
        return end


def _wav(blob: Blob, at: int) -> int | None:
    b = blob.data
    if b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    pos, seen = at + 12, set()
    while pos + 8 <= end <= len(b):
        kind, n = struct.unpack_from("<4sI", b, pos)
        seen.add(kind)
        pos += 8 + n + n % 2
    return end - at if pos == end and {b"fmt ", b"data"} <= seen else None


def _png(blob: Blob, at: int) -> int | None:
    def chunk(b: bytes, pos: int) -> tuple[int | None, bool]:
        n, kind = struct.unpack_from(">I4s", b, pos)
        stop = pos + 12 + n
        if not kind.isalpha() or stop > len(b) or zlib.crc32(memoryview(b)[pos + 4 : stop - 4]) != struct.unpack_from(">I", b, stop - 4)[0]:
            return None, True
        return stop, kind == b"IEND"

    # the header is a chunk of 13 bytes, and the first alone
    if blob.data[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return None
    end = blob.chain("png", at + 8, chunk)
    return end - at if end is not None else None


def _gif(blob: Blob, at: int) -> int | None:
    def sub_block(b: bytes, pos: int) -> tuple[int | None, bool]:
        return pos + 1 + b[pos], b[pos] == 0

    def block(b: bytes, pos: int) -> tuple[int | None, bool]:
        if b[pos] == 0x3B:
            return pos + 1, True
        if b[pos] == 0x21:
            start = pos + 2
        elif b[pos] == 0x2C:
            flags = b[pos + 9]
            start = pos + 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
        else:
            return None, True
        end = blob.chain("gif-sub", start, sub_block)
        return end, end is None

    flags = blob.data[at + 10]
    end = blob.chain("gif", at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), block)
    return end - at if end is not None else None


def _jpeg(blob: Blob, at: int) -> int | None:
    def segment(b: bytes, pos: int) -> tuple[int | None, bool]:
        kind = b[pos + 1]
        if b[pos] != 0xFF or not 0xC0 <= kind <= 0xFE:
            return None, True
        after = pos + 2 + struct.unpack_from(">H", b, pos + 2)[0]
        if kind != 0xDA:
            return after, False
        end = blob.next_mark(b"\xff\xd9", after)  # entropy-coded data ends at the end mark
        return (end + 2 if end >= 0 else None), True

    end = blob.chain("jpeg", at + 2, segment)
    return end - at if end is not None else None


def _pdf(blob: Blob, at: int) -> int | None:
    if not blob.data[at + 5 : at + 6].isdigit():
        return None
    end = blob.next_mark(b"%%EOF", at)
    return end + 5 - at if end >= 0 and 0 <= blob.next_mark(b"startxref", at) < end else None


def _zip(blob: Blob, at: int) -> int | None:
    """An end record tells where its archive starts."""
    if blob.archives is None:
        b, blob.archives = blob.data, {}
        for end in blob.marks.get(b"PK\x05\x06", []):
            if end <= len(b) - 22:
                size, offset, comment = struct.unpack_from("<IIH", b, end + 12)
                start, stop = end - offset - size, end + 22 + comment
                if start >= 0 and stop <= len(b) and b[start + offset : start + offset + 4] == b"PK\x01\x02":
                    blob.archives.setdefault(start, stop)
    return blob.archives[at] - at if at in blob.archives else None


def _gzip(blob: Blob, at: int) -> int | None:
    b, d = blob.data, zlib.decompressobj(31)
    try:
        for pos in range(at, len(b), 65536):
            d.decompress(b[pos : pos + 65536])
            if d.eof:
                return min(pos + 65536, len(b)) - len(d.unused_data) - at
    except zlib.error:
        return None
    return None


# Magic bytes of the formats and their media types.
SIGNATURES: dict[bytes, tuple[str, Callable[[Blob, int], int | None]]] = {
    b"RIFF": ("audio/wav", _wav),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"%PDF-": ("application/pdf", _pdf),
    b"PK\x03\x04": ("application/zip", _zip),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
}
# Marks that end a format or that its end must have before it.
MARKS = (b"%%EOF", b"startxref", b"PK\x05\x06", b"\xff\xd9")


def automaton() -> ahocorasick.Automaton:
    """Aho-Corasick automaton of all magic bytes and marks, over latin-1 text."""
    a = ahocorasick.Automaton()
    for magic in (*SIGNATURES, *MARKS):
        a.add_word(magic.decode("latin-1"), magic)
    a.make_automaton()
    return a


def sniff(blob: bytes, declared: str | None, a: ahocorasick.Automaton) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The type confirmed at offset 0 (else the declared one), and (type, offset, length) of embedded media."""
    starts: list[tuple[int, bytes]] = []
    marks: dict[bytes, list[int]] = {}
    for end, word in a.iter(blob.decode("latin-1")):
        at = end + 1 - len(word)
        if word in SIGNATURES:
            starts.append((at, word))
        else:
            marks.setdefault(word, []).append(at)
    found, carved, known = declared, [], Blob(blob, marks)
    for at, magic in starts:
        kind, validate = SIGNATURES[magic]
        try:
            n = validate(known, at)
        except (struct.error, IndexError):
            n = None
        if n is not None:
            if at == 0:
                found = kind
            else:
                carved.append((kind, at, n))
    return found, carved


def store(payload: bytes) -> bytes:
    """``payload`` as 8-bit mono samples of a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(SAMPLE_RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    """The samples of a stored WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def pad(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of 64."""
    return data + b"\0" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
FEATURE_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)
FEATURES = [x.split()[0] for x in FEATURE_SCHEMA.split(", ")]


def to_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media``: each whole text of ``doc_id, text`` as a media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [(t or "").encode() for t in b.column("text").to_pylist()]
            sizes, stored = pa.array(map(len, data), pa.int64()), pa.array((store(pad(x)) for x in data), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, stored], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, MEDIA_SCHEMA)


def media_features(media: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """Reads each media file back and describes it.

    ``feature`` is ``declared>confirmed;frames=N;embedded=type@offset+length,...``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            rows = []
            for blob in b.column("media").to_pylist():
                found, carved = sniff(blob, declared, a)
                payload = load(blob)
                inside = ",".join(f"{k}@{at}+{size}" for k, at, size in carved)
                feature = f"{declared}>{found};frames={len(payload)};embedded={inside}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *columns], FEATURES)

    return media.mapInArrow(run, FEATURE_SCHEMA)


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores every text and reads it back; both steps run in one stage without a shuffle."""
    return media_features(to_media(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
