"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is 8 positional bytes. Fingerprints at Hamming distance 3 or less
differ in at most 3 bytes, so they share at least 5 positional bytes, and of
these at least 3 lie in the same half. The index therefore posts each distinct
fingerprint under the 8 combinations of 3 positional bytes of a half: every pair
that reaches 5 shared bytes meets in some list. In a list the shared positional
bytes of a pair are tallied, pairs below 5 dropped and the others verified.

A list longer than ``LONG_LIST`` is split: its pairs share 2 more of the 5 other
bytes, so its members are posted anew under the 10 pairs of these. Members of
such a list differ in three bytes only; where they are many, each looks up the
2,324 neighbours of its three bytes in a table, so that a list of any length (it
has at most 2^24 members) takes time in proportion to it. Within a list
the links are contracted to a spanning forest before they leave the task; no
link is lost and what is sent grows with the fingerprints, not with their pairs.
Components of the forest follow by alternating large-star and small-star steps
over written tables.

Words are as in ``textstats``; a text of fewer than 3 words is one shingle, a
null or empty text has fingerprint 0 and links like any other. Repeated rows
share their fingerprint. Null ids never become a component's id unless a
component has no other. Texts of any length are read whole, in pieces; a bit with
as many ones as zeros is 0. An empty table gives an empty result. Extra columns
aren't read, whatever their names; ``drop_near_duplicates`` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans import Scratch

SEED = 42
SHINGLE = 3
MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
LONG_LIST = 2048
#: Members of a list from which on looking up neighbours is less work than comparing pairs.
MANY = 4700
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text, as an unsigned integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].astype("<u8").view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame) -> DataFrame:
    """Adds ``fp`` (signed) for the column ``text`` and drops it. Other columns pass unchanged."""
    rest = [f for f in df.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(fps)], [*(f.name for f in rest), "fp"])

    schema = T.StructType([*rest, T.StructField("fp", T.LongType())])
    return df.select(*[F.col(f"`{f.name}`") for f in rest], "text").mapInArrow(run, schema)


def _byte(i: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255).cast("long"))


def _packed(number: int, positions: tuple[int, ...], before: Column | None = None) -> Column:
    key = F.lit(number).cast("long") if before is None else before * 16 + number
    for i in positions:
        key = key * 256 + _byte(i)
    return key


def contract(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of its component for each of ``n`` nodes."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            above = label[label]
            if np.array_equal(above, label):
                break
            label = above
    return label


def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tallies shared positional bytes of pairs, then verifies those that reach the least number."""
    diff = np.bitwise_xor(x, y)
    found = (diff.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= MIN_SHARED
    found[found] = np.bitwise_count(diff[found]) <= MAX_BITS
    return found


def table_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Spanning forest of the links among fingerprints that differ in three bytes at most, None if they differ in more."""
    n = len(fps)
    some = np.bitwise_or.reduce(fps ^ fps[0])
    places = [i for i in range(8) if int(some) >> 8 * i & 255]
    if len(places) > 3:
        return None
    code = np.zeros(n, np.int64)
    for i in places:
        code = code << 8 | (fps >> np.uint64(8 * i) & np.uint64(255)).astype(np.int64)
    size = 1 << 8 * len(places)
    table = np.full(size, -1, np.int32)
    table[code] = np.arange(n, dtype=np.int32)
    masks = np.arange(1, size)
    label, starts, ends, pending = np.arange(n), [], [], 0
    at = np.arange(n)
    for mask in masks[np.bitwise_count(masks) <= MAX_BITS].tolist():
        other = table[code ^ mask]
        hit = other > at
        starts.append(at[hit])
        ends.append(other[hit].astype(np.int64))
        pending += len(starts[-1])
        if pending > 1 << 20:
            label = contract(n, np.concatenate([*starts, at]), np.concatenate([*ends, label]))
            starts, ends, pending = [], [], 0
    label = contract(n, np.concatenate([*starts, at]), np.concatenate([*ends, label]))
    leaf = label != at
    return fps[leaf], fps[label[leaf]]


def list_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within runs of equal keys, as (fingerprint, root)."""
    starts_of = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys))
    rest, found = np.ones(len(keys), bool), []
    for k in np.flatnonzero(np.diff(starts_of) > MANY).tolist():
        run = slice(int(starts_of[k]), int(starts_of[k + 1]))
        links = table_links(np.unique(fps[run]))
        if links is not None:
            found.append(links)
            rest[run] = False
    found.append(_pair_links(keys[rest], fps[rest]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pair_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``list_links`` by comparing all pairs of a run."""
    n, step = len(keys), 1
    label = np.arange(n)
    at = np.arange(n)
    starts, ends = [], []
    pending = 0
    while True:
        at = at[at + step < n]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        hit = at[near(fps[at], fps[at + step])]
        starts.append(hit)
        ends.append(hit + step)
        pending += len(hit)
        if pending > 1 << 20:
            label = contract(n, np.concatenate([*starts, np.arange(n)]), np.concatenate([*ends, label]))
            starts, ends, pending = [], [], 0
        step += 1
    label = contract(n, np.concatenate([*starts, np.arange(n)]), np.concatenate([*ends, label]))
    leaf = label != np.arange(n)
    return fps[leaf], fps[label[leaf]]


def _links_of_lists(posted: DataFrame) -> DataFrame:
    """Links ``u, v`` within the lists of ``key, fp``; a task holds one list and a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            u, v = list_links(keys, fps.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            keys, fps = b.column("key").to_numpy(), b.column("fp").to_numpy()
            if not len(keys):
                continue
            if keys[0] != keys[-1]:
                last = int(np.searchsorted(keys, keys[-1]))
                held.append((keys[:last], fps[:last]))
                yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, keys, fps = [], keys[last:], fps[last:]
            elif held and held[-1][0][-1] != keys[0]:
                yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            held.append((keys, fps))
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return posted.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "u long, v long")


def near_links(fps: DataFrame, scratch: Scratch, long_list: int = LONG_LIST) -> DataFrame:
    """Links between distinct fingerprints whose components are those of all pairs at 3 bits or less."""
    keys = F.array(*[_packed(k, t) for k, t in enumerate(TRIPLES)])
    posted = fps.select(F.explode(keys).alias("key"), "fp")
    long_ = scratch.save(posted.groupBy("key").count().filter(F.col("count") > long_list).select("key"), "long-lists")
    links = _links_of_lists(posted.join(long_, "key", "left_anti"))
    if not long_.isEmpty():
        parts = posted.join(long_, "key", "left_semi").withColumn("triple", F.shiftrightunsigned("key", 24))
        # from the half's number, the five positions outside of a triple
        pairs = F.lit(None).cast("array<long>")
        for k, t in enumerate(TRIPLES):
            others = [p for p in combinations(sorted(set(range(8)) - set(t)), 2)]
            # the list itself, a pair's number and two bytes: 27 + 4 + 16 bits
            pairs = F.when(F.col("triple") == k, F.array(*[_packed(n, p, F.col("key")) for n, p in enumerate(others)])).otherwise(pairs)
        links = links.unionAll(_links_of_lists(parts.select(F.explode(pairs).alias("key"), "fp")))
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``u, v``: the least node ``v`` of its component for every linked node ``u`` but ``v`` itself.

    Links have ``u > v``. Least neighbours are partial aggregates, so a node with any number of links is in no one task.
    """

    def star(both: DataFrame) -> DataFrame:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(least, "u")

    edges, state, k = scratch.save(links, "links-0"), None, 0
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges
        state, k = now, k + 1
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.distinct(), f"large-{k}")
        small = star(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        done = f"links-{k - 1}"
        edges = scratch.save(small.select("e.u", "e.v").filter("u <> v").distinct(), f"links-{k}")
        scratch.drop(done, f"large-{k}")


def component_ids(rows: DataFrame) -> DataFrame:
    """``fp, component_id, root`` of every fingerprint of a written table ``doc_id, fp``; the root is a component's least fingerprint."""
    scratch = Scratch(rows.sparkSession, "simhash")
    fps = scratch.save(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(near_links(fps.select("fp"), scratch), scratch)
    rooted = fps.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", F.coalesce("v", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return scratch.save(rooted.join(least, "root").select("fp", "component_id", "root"), "components")


def simhash_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document."""
    rows = Scratch(docs.sparkSession, "simhash-rows").save(with_fingerprint(docs.select("doc_id", "text")), "rows")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(component_ids(rows), "fp").select("doc_id", text, "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component, that with its least doc_id, with the columns of ``docs``.

    A component is known by its root, as null and repeated ids don't tell components apart. Null ids come last; of
    rows that repeat an id in a component, that with the least fingerprint stays.
    """
    scratch = Scratch(docs.sparkSession, "simhash-stage")
    rows = scratch.save(with_fingerprint(docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), "text")), "rows")
    roots = component_ids(rows.select(F.col("id").alias("doc_id"), "fp")).select("fp", "root")
    least = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "fp")).alias("least")
    first = rows.select("id", "fp").join(roots, "fp").groupBy("root").agg(least)
    first = scratch.save(first.select(F.col("least.id").alias("keep_id"), F.col("least.fp").alias("keep_fp")), "first")
    match = rows["id"].eqNullSafe(first["keep_id"]) & (rows["fp"] == first["keep_fp"])
    return rows.join(first, match, "left_semi").dropDuplicates(["id", "fp"]).select("row.*")
