"""Removal of 50-byte strings that start in a document with a smaller id.

The suffixes that matter are reduced to anchored segments. Of the k-grams within
each 50-byte window the one of least hash (the last of equal ones) is the
window's anchor, so equal windows have equal anchors at equal places. The windows
of one anchor are a segment, about 19 bytes apart. Then, by anchor:

1. Within a batch only a segment's copy in the least document is sent on; the
   other copies are known to be repeats. Sent rows meet by anchor.
2. A segment with a copy in a smaller document is a repeat as a whole. Where an
   anchor stands in several different segments, these ask for their bytes.
3. The bytes of asked segments meet by anchor in shards. A shard's suffixes are
   put in order by external induced sorting, whose disk-backed queues carry
   suffixes and common prefixes; a run of common prefixes of 50 bytes or more is
   one string, and all but those in its least document are repeats. An anchor in
   more than ``HOT_SEGMENTS`` segments is posted with the 17 bytes on its left
   and on its right instead: a window around it holds the one or the other.

The spans are joined with the texts once, at the end. No step holds more than a
batch, the rows of ``HOT_SEGMENTS`` segments of an anchor, or a shard's text in a
file and its tables in memory; a task sorts one shard after the other, so that
the number of tasks has a limit. A passage in a third of all documents sends a
row for each batch it is in. Segments are compared by
64-bit hashes, asked windows by their bytes. A null text is an empty one. Rows
without id neither remove nor lose anything; rows of equal id don't match each
other. An empty table gives an empty result; a text of any length is posted in
pieces. Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import gc
import hashlib
import tempfile
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.induced import suffixes_descending
from graphloom.plans import Scratch

LENGTH = 50
GRAM = 16
GRAMS = LENGTH - GRAM + 1
SIDE = (LENGTH - GRAM) // 2
HOT_SEGMENTS = 256
PIECE_BYTES = 1 << 22
CHUNK_BYTES = 1 << 23
#: Asked segments of a shard, about 4 MB of text.
SHARD_ROWS = 50_000
SHARD_TASKS = 8_000
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_PLACE = np.uint64((1 << 24) - 1)
#: Anchors only bring segments together; what they don't tell apart their segments' hashes do.
_ANCHOR_BITS = np.uint64((1 << 40) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    return x * _M1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all k-grams, by doubling."""
    h = _mix((data.astype(np.uint64) + np.uint64(1)) * _M3)
    width = 1
    while width < GRAM:
        h = _mix(h[:-width] * _M2 + h[width:])
        width *= 2
    return h


def segments(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, segment hash, start, length, anchor's offset) of the segments of at least 50 bytes."""
    h = gram_hashes(data)
    # of equal hashes the last place is the least
    order = (h & ~_PLACE) | (_PLACE - np.arange(len(h), dtype=np.uint64))
    width = 1
    while 2 * width <= GRAMS:
        order = np.minimum(order[:-width], order[width:])
        width *= 2
    rest = GRAMS - width
    if rest:
        order = np.minimum(order[:-rest], order[rest:])
    place = (_PLACE - (order & _PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    anchor = place[first]
    end = last + LENGTH - GRAM
    s = (last - first).astype(np.uint64) * _M3 + (anchor - first).astype(np.uint64)
    for k in range(LENGTH // GRAM + 3):
        s = _mix(s * _M2 + h[np.minimum(first + k * GRAM, end)])
    return h[anchor] & _ANCHOR_BITS, s, first, last - first + LENGTH, anchor - first


def _packed(tag: np.ndarray, start: np.ndarray, length: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return tag << 48 | start << 16 | length << 8 | offset


def post(ids: list[int], tags: list[int], texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(kind, anchor, segment, doc, span) of a chunk. Kind 0: a repeat of the chunk; kind 1: the first copy."""
    parts = []
    for doc, tag, text in zip(ids, tags, texts, strict=True):
        whole = np.frombuffer(text, np.uint8)
        for at in range(0, len(whole) - LENGTH + 1, PIECE_BYTES):
            a, s, start, length, offset = segments(whole[at : at + PIECE_BYTES + LENGTH - 1])
            parts.append((a, s, np.full(len(a), doc), _packed(np.int64(tag), start + at, length, offset)))
    if not parts:
        return (np.empty(0, np.int64),) * 5
    anchor, segment, doc, span = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((doc, segment, anchor))
    a, s, d = anchor[order], segment[order], doc[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])])
    least = np.empty(len(doc), np.int64)
    least[order] = d[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]
    # rows stay in the order of the texts, which packs best
    return (doc == least).astype(np.int64), anchor.view(np.int64), segment.view(np.int64), doc, span


def posted_segments(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "anchor", "segment", "doc", "span"]
        for b in batches:
            ids, tags, texts, size = [], [], [], 0
            rows = zip(b.column("doc_id").to_pylist(), b.column("tag").to_pylist(), b.column("text").to_pylist(), strict=True)
            for doc, tag, text in rows:
                data = text.encode()
                ids.append(doc)
                tags.append(tag)
                texts.append(data)
                size += len(data)
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in post(ids, tags, texts)], names)
                    ids, tags, texts, size = [], [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in post(ids, tags, texts)], names)

    return docs.mapInArrow(run, "kind long, anchor long, segment long, doc long, span long")


def _by_runs(batches: Iterator[pa.RecordBatch], key: str, names: list[str]) -> Iterator[list[np.ndarray]]:
    """Column arrays of whole runs of ``key`` from sorted batches."""
    held: list[list] = []
    for b in batches:
        cols = [b.column(n) for n in names]
        keys = b.column(key).to_numpy()
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if held and (last or held[-1][0] != keys[-1]):
            head = [c.slice(0, last) for c in cols]
            yield [pa.concat_arrays([*(h[1][i] for h in held), head[i]]) for i in range(len(cols))]
            held = []
        elif last:
            yield [c.slice(0, last) for c in cols]
        held.append([keys[-1], [c.slice(last) for c in cols]])
    if held:
        yield [pa.concat_arrays([h[1][i] for h in held]) for i in range(len(names))]


def judge(anchor: np.ndarray, segment: np.ndarray, doc: np.ndarray, hot_segments: int = HOT_SEGMENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(repeat, asks, hot) for rows sorted by anchor, segment and document, in whole runs of anchors."""
    at = np.arange(len(anchor))
    new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    new = new_anchor | np.concatenate([[True], segment[1:] != segment[:-1]])
    least = doc[np.maximum.accumulate(np.where(new, at, 0))]
    starts = np.flatnonzero(new_anchor)
    group = np.cumsum(new_anchor) - 1
    n = np.add.reduceat(new.astype(np.int64), starts)
    several = (n > 1) & (np.minimum.reduceat(least, starts) < np.maximum.reduceat(least, starts))
    repeat = doc > least
    return repeat, several[group] & ~repeat, (n > hot_segments)[group]


def judged_segments(posted: DataFrame, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``kind, anchor, doc, span``. Kind 0: a repeat; 1: asks for its bytes; 2: the same at a hot anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _by_runs(batches, "anchor", ["kind", "anchor", "segment", "doc", "span"]):
            kind, anchor, segment, doc, span = (c.to_numpy(zero_copy_only=False) for c in cols)
            done, sent = kind == 0, kind == 1
            out = [(np.zeros(int(done.sum()), np.int64), anchor[done], doc[done], span[done])]
            anchor, segment, doc, span = (x[sent] for x in (anchor, segment, doc, span))
            if len(anchor):
                repeat, asks, hot = judge(anchor, segment, doc, hot_segments)
                for some, k in ((repeat, 0), (asks & ~hot, 1), (asks & hot, 2)):
                    out.append((np.full(int(some.sum()), k), anchor[some], doc[some], span[some]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["kind", "anchor", "doc", "span"])

    # repeats of a batch pass through under a key of their own, spread by document
    key = F.when(F.col("kind") == 0, F.xxhash64("doc")).otherwise(F.col("anchor"))
    posted = posted.withColumn("anchor", key)
    return posted.repartition("anchor").sortWithinPartitions("anchor", "segment", "doc", "span").mapInArrow(run, "kind long, anchor long, doc long, span long")


def tag(text: Column) -> Column:
    """Tells rows of equal id apart."""
    return F.pmod(F.xxhash64(text), F.lit(1 << 15)).cast("long")



def _field(name: str) -> Column:
    span = F.col("span")
    return {
        "tag": F.shiftrightunsigned(span, 48),
        "start": F.shiftrightunsigned(span, 16).bitwiseAND(F.lit((1 << 32) - 1)),
        "length": F.shiftrightunsigned(span, 8).bitwiseAND(F.lit(255).cast("long")),
        "offset": span.bitwiseAND(F.lit(255).cast("long")),
    }[name].alias(name)


class Shard:
    """Segments of a shard: their text in a file, characters 1 to 256 for bytes and 0 after each segment."""

    def __init__(self):
        self.file, self.n = tempfile.TemporaryFile(), 0
        self.rows: list[tuple[np.ndarray, ...]] = []

    def add(self, doc: np.ndarray, tag_: np.ndarray, start: np.ndarray, data: pa.Array) -> None:
        pieces = data.to_pylist()
        sizes = np.array([len(x) for x in pieces], np.int64)
        ends = np.cumsum(sizes + 1)
        text = np.ones(int(ends[-1]), np.uint16)
        inside = np.ones(len(text), bool)
        inside[ends - 1] = False
        text[inside] += np.frombuffer(b"".join(pieces), np.uint8)
        text[~inside] = 0
        self.file.write(text.tobytes())
        self.rows.append((doc, tag_, start, self.n + ends - sizes - 1, self.n + ends - 1))
        self.n += len(text)

    def repeats(self) -> list[np.ndarray]:
        """doc, tag, start and length of the runs of windows that are in a smaller document."""
        if not self.n:
            return [np.empty(0, np.int64)] * 4
        self.file.flush()
        text = np.memmap(self.file, np.uint16, "r", shape=(self.n,))
        doc, tag_, start, first, end = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        gone = np.zeros(self.n, bool)

        def close(at: np.ndarray, group: np.ndarray) -> None:
            """Marks the suffixes of whole groups of equal windows that have a smaller document among them."""
            k = np.searchsorted(first, at, "right") - 1
            whole = at + LENGTH <= end[k]
            at, k, group = at[whole], k[whole], group[whole]
            if len(at):
                starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                least = np.repeat(np.minimum.reduceat(doc[k], starts), np.diff(np.append(starts, len(at))))
                gone[at[doc[k] > least]] = True

        held: list[tuple[np.ndarray, np.ndarray]] = []
        group = 0
        for at, lcp in suffixes_descending(text, 257):
            groups = group + np.cumsum(lcp < LENGTH)
            group = int(groups[-1])
            held.append((at, groups))
            if groups[0] != group:
                at, groups = (np.concatenate(x) for x in zip(*held, strict=True))
                done = int(np.searchsorted(groups, group))
                close(at[:done], groups[:done])
                held = [(at[done:], groups[done:])]
        if held:
            close(*(np.concatenate(x) for x in zip(*held, strict=True)))
        at = np.flatnonzero(gone)
        if not len(at):
            return [np.empty(0, np.int64)] * 4
        new = np.append(True, np.diff(at) > 1)
        run = at[new]
        length = np.diff(np.append(np.flatnonzero(new), len(at))) + LENGTH - 1
        k = np.searchsorted(first, run, "right") - 1
        return [doc[k], tag_[k], start[k] + run - first[k], length]


def asked_repeats(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc, tag, start, length`` of repeats within the segments that ask for their bytes."""
    shards = max(1, min(SHARD_TASKS, -(-asked.count() // SHARD_ROWS)))
    asked = asked.select("kind", "anchor", "doc", _field("tag"), _field("start"), _field("length"), _field("offset"))
    texts = docs.select(F.col("doc_id").alias("doc"), "tag", F.col("text").cast("binary").alias("data"))
    data = F.substring(F.col("data"), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    rows = asked.join(texts, ["doc", "tag"]).select("kind", "anchor", "doc", "tag", "start", "offset", data.alias("data"))
    offset = F.col("offset").cast("int")
    left = F.when(offset >= SIDE, F.xxhash64(F.lit(0), "anchor", F.substring("data", offset - SIDE + 1, F.lit(SIDE))))
    has_right = F.length("data") - offset - GRAM >= SIDE
    right = F.when(has_right, F.xxhash64(F.lit(1), "anchor", F.substring("data", offset + GRAM + 1, F.lit(SIDE))))
    keys = F.when(F.col("kind") == 1, F.array("anchor")).otherwise(F.array_compact(F.array(left, right)))
    rows = rows.select(F.explode(keys).alias("key"), "doc", "tag", "start", "data")
    names = ["doc", "tag", "start", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = Shard(), 0
        for cols in _by_runs(batches, "key", ["key", "doc", "tag", "start", "data"]):
            key = cols[0].to_numpy()
            same = key[1:] == key[:-1]
            met = np.append(False, same) | np.append(same, False)
            if met.any():
                if rows + int(met.sum()) > 2 * SHARD_ROWS and rows:  # keys are whole, so a shard can end here
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in shard.repeats()], names)
                    shard, rows = Shard(), 0
                doc, tag_, start = (c.to_numpy()[met] for c in cols[1:4])
                shard.add(doc, tag_, start, cols[4].filter(pa.array(met)))
                rows += int(met.sum())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in shard.repeats()], names)

    return rows.repartition(shards, "key").sortWithinPartitions("key", "doc").mapInArrow(run, "doc long, tag long, start long, length long")


def merge(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of intervals."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(starts[1:] > ends[:-1]) + 1
    return list(zip(starts[np.concatenate([[0], new])].tolist(), ends[np.concatenate([new - 1, [len(ends) - 1]])].tolist(), strict=True))


REMOVED_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _release(scratch: Scratch) -> None:
    """Lets Spark delete the shuffle files of finished steps, which it does once their plans are collected."""
    for _ in range(3):
        gc.collect()
        scratch.spark._jvm.System.gc()
        time.sleep(0.5)


def repeat_spans(docs: DataFrame, scratch: Scratch, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``doc, tag, start, length`` of all repeats of ``doc_id, tag, text``, overlapping ones included."""
    docs = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    judged = scratch.save(judged_segments(posted_segments(docs), hot_segments), "judged")
    _release(scratch)
    asked = scratch.save(asked_repeats(judged.filter("kind > 0"), docs), "asked")
    _release(scratch)
    return judged.filter("kind = 0").select("doc", _field("tag"), _field("start"), _field("length")).unionAll(asked)


def remove_repeats(docs: DataFrame, with_bytes: bool = False, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document, and ``kept``, its remaining bytes."""
    scratch = Scratch(docs.sparkSession, "repeats")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", tag(F.col("text")).alias("tag"), "text")
    spans = repeat_spans(texts, scratch, hot_segments)
    spans = spans.groupBy(F.col("doc").alias("doc_id"), "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))
    joined = texts.join(spans, ["doc_id", "tag"], "left").select("doc_id", "text", "starts", "lengths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_bytes
        for b in batches:
            rows = []
            for text, starts, lengths in zip(*(b.column(c).to_pylist() for c in ("text", "starts", "lengths")), strict=True):
                data = text.encode()
                first = np.array(starts or [], np.int64)
                runs = merge(first, first + np.array(lengths or [], np.int64))
                at, kept = 0, []
                for start, end in runs:
                    kept.append(data[at:start])
                    at = end
                left = b"".join([*kept, data[at:]])
                row = (len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest())
                rows.append(row + ((left,) if with_bytes else ()))
            if rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names)

    schema = REMOVED_SCHEMA if with_bytes else REMOVED_SCHEMA.rpartition(",")[0]
    names = [x.split()[0] for x in schema.split(", ")]
    return joined.mapInArrow(run, schema)


ORACLE_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
-- windows are cut from chunks of 2048 starts, as a substring reads its string from the beginning
c AS (SELECT doc_id, n, k, substr(h, 4096 * k + 1, 4096 + 98) AS part FROM (SELECT *, unnest(range(n // 2048 + 1)) AS k FROM d)),
w AS (SELECT doc_id, 2048 * k + i AS pos, substr(part, 2 * i + 1, 100) AS s
      FROM (SELECT *, unnest(range(greatest(0, least(2048, n - 49 - 2048 * k)))) AS i FROM c)),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY s) AS least_id FROM w) WHERE least_id < doc_id),
o AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run
      FROM (SELECT *, (pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50, -1))::INT AS fresh FROM r)),
s AS (SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM o GROUP BY doc_id, run),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prior FROM s),
p AS (SELECT g.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS stop,
             string_agg(substr(h, 2 * prior + 1, 2 * (a - prior)), '' ORDER BY a) AS head FROM g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN p ON p.doc_id = d.doc_id
"""
