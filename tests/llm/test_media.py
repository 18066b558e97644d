import gzip
import hashlib
import io
import random
import struct
import time
import zipfile
import zlib

from pyspark.sql import functions as F

from graphloom.llm import media, registry
from graphloom.sources import table

SF = "/root/testdata/sf0.001"


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a", "hello")
    return out.getvalue()


GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02data\xff\xd9"
PDF = b"%PDF-1.4 x startxref 9 %%EOF"


def test_formats_are_confirmed_corrected_and_carved():
    a = media.automaton()
    for kind, blob in (("image/png", png()), ("image/gif", GIF), ("image/jpeg", JPEG), ("application/pdf", PDF), ("application/zip", zipped()), ("application/gzip", gzip.compress(b"x" * 99)), ("audio/wav", media.store(b"\0" * 64))):
        assert media.sniff(blob, "text/plain", a) == (kind, [])
        wrapped = b"head" + blob + b"tail"
        assert media.sniff(wrapped, "text/plain", a) == ("text/plain", [(kind, 4, len(blob))])
        assert media.sniff(blob[: len(blob) // 2], "text/plain", a)[0] == "text/plain"
    assert media.sniff(b"RIFF PK\x03\x04 GIF89a \x1f\x8b\x08 \xff\xd8\xff", None, a) == (None, [])


def test_round_trip(spark, make_docs):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = registry.op9_media_columns(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        # the padding and the container written out by hand
        payload = data + bytes(-len(data) % 64 if data else 64)
        header = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload))
        stored = header + payload
        want = (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want
    edge = media.media_digest(make_docs([None, "", "x" * 64, "y" * 65, "GIF89a"], ids=[1, 2, 3, None, 5])).collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in edge) == [(0, 64), (0, 64), (6, 64), (64, 64), (65, 128)]
    assert media.media_digest(make_docs([])).count() == 0


def test_long_texts_take_little_time(spark, make_docs):
    """Ten million characters of nothing but magic numbers or blocks."""
    size, a = 10_000_000, media.automaton()
    head = b"GIF89a\x01\x01\x01\x01\x01\x01\x01!x"
    bits = [b"%PDF-1 ", b"%PDF-1 %%EOF ", b"PK\x03\x04", b"PK\x03\x04PK\x05\x06" + b"\x01" * 18, b"GIF89a", head, head + b"d" * 9, b"RIFF    WAVE", b"\xc2\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR", b"\xff\xd8\xff\xe0\x00\x04ab"]
    for bit in bits:
        began = time.monotonic()
        media.sniff(bit * (size // len(bit)), None, a)
        assert time.monotonic() - began < 20, bit
    texts = ["%PDF-1 " * 100_000, "x" * 5_000_000]
    rows = media.media_digest(make_docs(texts)).orderBy("doc_id").collect()
    assert [r.n_bytes for r in rows] == [700_000, 5_000_000] and rows[0].payload_bytes == 700_032


def test_embedded_among_noise_and_two_in_a_row():
    rng, a = random.Random(1), media.automaton()
    kinds = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "application/pdf": PDF, "application/zip": zipped()}
    for _ in range(50):
        blob, want = b"-", []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.choice(list(kinds))
            blob += bytes(rng.choices(b"abc \n", k=rng.randrange(9)))
            want.append((kind, len(blob), len(kinds[kind])))
            blob += kinds[kind]
        assert media.sniff(blob, "x", a) == ("x", want)


def test_clashing_columns_and_repeated_rows(make_docs):
    docs = make_docs(["a", "a"], ids=[1, 1]).withColumns({c: F.lit(3) for c in ("n_bytes", "media", "feature", "payload")})
    rows = media.media_digest(docs).collect()
    assert len(rows) == 2 and len({tuple(r) for r in rows}) == 1 and rows[0].n_bytes == 1
