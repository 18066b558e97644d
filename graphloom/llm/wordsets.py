"""Near-duplicates by word shingles at a Jaccard similarity, on a byte-position inverted index with count filtering.

SimHash can't serve here: at a similarity of 0.8 about 15 % of its bits differ, so that no byte need be shared, whatever
its width. The ``BYTES`` positional bytes of a text are those of min-wise hashes of its set of shingles instead; two
texts share each with a chance of their similarity (and by chance with 1/256). A check byte for each block of them comes
from other bits of the same hashes: blocks that are equal by chance alone are told apart by it in all but 1/256.

1. Pairs that share ``MIN_SHARED`` bytes or more differ in ``BYTES - MIN_SHARED`` at most, so of as many blocks of
   ``BLOCK`` bytes and one more they share one whole. Each distinct signature is posted under these blocks and their check
   bytes. Only blocks that another signature has too are listed with their signatures.
2. In a list the shared bytes of pairs are tallied. Only links that join two parts of the list leave the task, the
   strongest first in lists of up to ``LONG_LIST`` signatures. In longer ones a part is compared only with what is
   outside of it, so that a group of copies takes time in proportion to its size; what remains of a list after ``EFFORT``
   tallies for each signature is posted anew under further blocks, up to ``LEVELS`` in all, which the guarantee allows.
   A list of more than ``HUGE_LIST`` signatures is dealt to parts, and each two parts are a list.
3. Links are verified by the exact similarity of the two texts' shingle sets, and components follow as in ``simhash``.

The tally's standard error at 0.8 is 0.033 and ``MIN_SHARED`` is 0.75, so that of pairs at exactly 0.8 one in twenty is
missed in the tally, and of those at 0.85 or more fewer than one in a thousand.
A forest's link that fails the exact check may stand before weaker pairs of the same parts that pass it. So the parts
that failed links hold together are read again with their texts, and their pairs that share enough bytes and aren't joined
by links that passed are checked within the task, which joins parts as it goes: a link that passes spares the pairs of the
two parts it joins, and no more links than texts leave the task.

Lists are posted and counted as narrow rows; a signature is fetched once for each list that has another one in it. Texts
are moved only if they are an end of a link, and whole rows only if they are linked or have a copy, as far as ``among``
can tell.

Words are as in ``textstats``, lower-cased in A-Z; a text of fewer words than a shingle is one shingle, and texts without
words are copies of each other. Null texts are empty; texts of any length are read whole. Repeated rows are copies; an
empty table gives an empty result. Extra columns of any name pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.simhash import components
from graphloom.plans import Scratch

SHINGLE = 5
SIMILARITY = 0.8
BYTES = 144
BLOCK = 3
BLOCKS = BYTES // BLOCK
MIN_SHARED = 108
POSTED = BYTES - MIN_SHARED + 1
LEVELS = 3
LONG_LIST = 2048
HUGE_LIST = 1 << 18
EFFORT = 2048
GROUP_BYTES = 1 << 23
SEED = 42
#: Bits of a bitmap of keys.
MARKS = 1 << 24
_CHUNK = 1 << 12
_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 1 << 63, BYTES, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _RNG.integers(0, 1 << 63, BYTES, np.uint64)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64))


def signature(hashes: np.ndarray) -> bytes:
    """The positional bytes of a set and then the check bytes of their blocks; all zero for the empty one."""
    least = np.full(BYTES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        values = (hashes[at : at + _CHUNK, None] ^ _MASKS) * _FACTORS
        least = np.minimum(least, values.min(0))
    if not len(hashes):
        return bytes(BYTES + BLOCKS)
    spread = least * _SPREAD
    checks = np.bitwise_xor.reduce((spread >> np.uint64(48)).astype(np.uint8).reshape(BLOCKS, BLOCK), 1)
    return (spread >> np.uint64(56)).astype(np.uint8).tobytes() + checks.tobytes()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of sorted hashes; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def with_signature(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``id, text_key, node, signature`` of ``id, text_key, text``; the node is a hash of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [signature(shingle_hashes(t, shingle)) for t in b.column("text").to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s) for s in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), pa.array(nodes), pa.array(found, pa.binary())], ["id", "text_key", "node", "signature"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text_key", "text").mapInArrow(run, f"id {kind}, text_key string, node long, signature binary")


def block_keys(signatures: np.ndarray, before: np.ndarray | None = None, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, blocks posted so far) of the posted blocks of each signature. A key is a hash of the key before, a block's
    number, its bytes and its check byte, where the signatures have them; ``used`` has a bit for each block posted before,
    which is passed over."""
    n = len(signatures)
    blocks = signatures[:, :BYTES].reshape(n, BLOCKS, BLOCK).astype(np.uint64)
    values = blocks[:, :, 0] << np.uint64(16) | blocks[:, :, 1] << np.uint64(8) | blocks[:, :, 2]
    if signatures.shape[1] > BYTES:
        values = values | signatures[:, BYTES:].astype(np.uint64) << np.uint64(32)
    used = np.zeros(n, np.int64) if used is None else used
    taken = (used[:, None] >> np.arange(BLOCKS)) & 1
    numbers = np.argsort(taken, 1, kind="stable")[:, :POSTED]
    keys = np.take_along_axis(values, numbers, 1) | numbers.astype(np.uint64) << np.uint64(24)
    if before is not None:
        keys = keys ^ (before.view(np.uint64)[:, None] * _SPREAD)
    keys = (keys ^ keys >> np.uint64(29)) * _SPREAD
    return (keys ^ keys >> np.uint64(32)).view(np.int64), used[:, None] | (np.int64(1) << numbers)


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _tallied(column: pa.Array) -> np.ndarray:
    """The positional bytes alone."""
    return np.ascontiguousarray(_rows_of(column)[:, :BYTES])


def _post(table: DataFrame, with_used: bool) -> DataFrame:
    """``key, node[, used]`` of ``node, signature`` and, above the first level, ``key`` and ``used``."""
    again = "key" in table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                rows = _rows_of(b.column("signature"))
                keys, used = block_keys(rows, *(b.column(c).to_numpy() for c in ("key", "used") if again))
                pick = np.repeat(np.arange(len(rows)), POSTED)
                columns, names = [pa.array(keys.ravel()), pa.array(np.take(b.column("node").to_numpy(), pick))], ["key", "node"]
                if with_used:
                    columns.append(pa.array(used.ravel()))
                    names.append("used")
                yield pa.RecordBatch.from_arrays(columns, names)

    return table.mapInArrow(run, "key long, node long" + (", used long" if with_used else ""))


def _tallies(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Shared positional bytes of each of ``rows`` with each of ``others``."""
    out = np.empty((len(rows), len(others)), np.int16)
    step = max(1, (1 << 24) // max(1, others.size))
    for at in range(0, len(rows), step):
        out[at : at + step] = (rows[at : at + step, None, :] == others[None, :, :]).sum(2)
    return out


def short_links(rows: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of the pairs that share enough bytes, the strongest links first."""
    n = len(rows)
    starts, ends, counts = [], [], []
    for at in range(0, n, 256):
        tally = _tallies(rows[at : at + 256], rows[at:])
        i, j = np.nonzero(tally >= MIN_SHARED)
        later = j > i
        starts.append(i[later] + at)
        ends.append(j[later] + at)
        counts.append(tally[i[later], j[later]])
    a, b, c = (np.concatenate(x) for x in (starts, ends, counts))
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for k in np.argsort(-c, kind="stable").tolist():
        x, y = int(a[k]), int(b[k])
        rx, ry = root(x), root(y)
        if rx != ry:
            up[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
            if len(out) == n - 1:
                break
    return out


def long_links(rows: np.ndarray, effort: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(links, rest): as ``short_links`` for any length. Members of a part are compared only with what is outside of it.
    After ``effort`` tallies for each row the rows are returned that are still to be compared with each other."""
    out: list[tuple[int, int]] = []
    outside, done = np.arange(len(rows)), 0
    while len(outside):
        pending, outside = [int(outside[0])], outside[1:]
        while pending and len(outside):
            if effort is not None and done > effort * len(rows):
                return out, np.concatenate([np.array(pending, np.int64), outside])
            some, pending = pending[:256], pending[256:]
            tally = _tallies(rows[outside], rows[some])
            done += tally.size
            best = tally.argmax(1)
            hit = tally[np.arange(len(outside)), best] >= MIN_SHARED
            new = outside[hit].tolist()
            out += [(some[k], x) for k, x in zip(best[hit].tolist(), new, strict=True)]
            pending += new
            outside = outside[~hit]
    return out, outside


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The lists of rows sorted by ``key``, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        keys = b.column("key").to_numpy()
        if not len(keys):
            continue
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if held and keys[start] != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(start, stop - start))
            last = keys[start]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def links_between(rows: np.ndarray, roots: np.ndarray, same: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Links that pass ``same`` and join different ``roots`` to the components of all such pairs that share enough bytes,
    the strongest tried first. Pairs that are joined already are passed over, and rows of a root never compared."""
    _, label = np.unique(roots, return_inverse=True)
    sizes = np.bincount(label)
    # all pairs of two roots are met from the smaller ones
    few = np.flatnonzero(label != sizes.argmax())
    few = few[np.argsort(sizes[label[few]], kind="stable")]
    done, out = np.zeros(len(rows), bool), []
    step = max(1, min(256, (1 << 24) // len(rows)))
    for at in range(0, len(few), step):
        some = few[at : at + step]
        for i, tally in zip(some.tolist(), _tallies(rows[some], rows), strict=True):
            done[i] = True
            others = np.flatnonzero((tally >= MIN_SHARED) & (label != label[i]) & ~done)
            for j in others[np.argsort(-tally[others], kind="stable")].tolist():
                if label[j] != label[i] and same(i, j):
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


def _links_of_lists(posted: DataFrame, long_list: int, effort: int | None) -> DataFrame:
    """Links ``u, v`` within the lists of ``key, used, node, signature``, and the rows that are to be posted anew; a task
    holds a list at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows < 2:
                return
            nodes, rows = table.column("node").to_numpy(), _tallied(table.column("signature"))
            found, rest = (short_links(rows), np.empty(0, np.int64)) if len(rows) <= long_list else long_links(rows, effort)
            if found:
                u, v = (pa.array(nodes[[x[i] for x in found]]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([u, v, *(pa.nulls(len(found), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names)
            if len(rest):
                for b in table.take(pa.array(rest)).select(["key", "used", "node", "signature"]).to_batches(1024):
                    yield pa.RecordBatch.from_arrays([pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int64()), *b.columns], names)

        names = ["u", "v", "key", "used", "node", "signature"]
        for table in _lists(batches):
            yield from links(table)

    columns = ["key", "used", "node", "signature"]
    return posted.select(*columns).repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "u long, v long, key long, used long, node long, signature binary")


def _dealt(listed: DataFrame, huge_list: int) -> DataFrame:
    """Lists of more than ``huge_list`` rows as a list for each two of their parts."""
    n = F.ceil(F.col("count") / huge_list).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(1)), n).cast("int")
    others = F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.xxhash64("key", F.least(t, mine), F.greatest(t, mine)))
    return listed.withColumn("key", F.explode(F.when(n > 1, others).otherwise(F.array("key"))))


def near_links(nodes: DataFrame, scratch: Scratch, long_list: int = LONG_LIST, huge_list: int = HUGE_LIST, effort: int = EFFORT) -> DataFrame:
    """Links ``u > v`` of a written table ``node, signature`` whose components are those of all pairs that share enough bytes."""
    links, table = None, nodes
    for level in range(LEVELS):
        sizes = scratch.save(_post(table, False).groupBy("key").count().filter("count > 1"), f"lists-{level}")
        listed = scratch.save(_dealt(_post(table, True).join(sizes, "key"), huge_list).drop("count"), f"listed-{level}")
        found = scratch.save(_links_of_lists(listed.join(nodes, "node"), long_list, effort if level < LEVELS - 1 else None), f"found-{level}")
        some = found.filter(F.col("u").isNotNull()).select("u", "v")
        links = some if links is None else links.unionAll(some)
        table = found.filter(F.col("node").isNotNull()).select("key", "used", "node", "signature")
        if level == LEVELS - 1 or table.isEmpty():
            break
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()


def parts_of(failed: DataFrame, roots: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``key, node, root`` of the nodes that links which ``failed`` the exact check hold together across the components
    ``roots`` of those that passed it. Of two nodes alone the only pair has failed."""
    root = lambda side: roots.select(F.col("u").alias(side), F.col("v").alias(f"{side}_root"))
    ends = failed.join(root("u"), "u", "left").join(root("v"), "v", "left").select(F.coalesce("u_root", "u").alias("a"), F.coalesce("v_root", "v").alias("b"))
    apart = ends.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    groups = components(apart, scratch)
    groups = scratch.save(groups.unionAll(groups.select(F.col("v").alias("u"), "v")).distinct().select(F.col("u").alias("root"), F.col("v").alias("key")), "groups")
    rooted = nodes.select("node").join(roots.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    members = scratch.save(rooted.join(groups, "root").select("key", "node", "root"), "members")
    return members.join(members.groupBy("key").count().filter("count > 2").select("key"), "key")


def links_left_out(members: DataFrame, scratch: Scratch, shingle: int = SHINGLE, least: float = SIMILARITY, huge_list: int = HUGE_LIST) -> DataFrame:
    """Links ``u > v`` at a similarity of ``least`` or more that join the roots of a written table ``key, node, root,
    signature, text`` to the components of all its pairs of a key that share enough bytes. A task holds the texts of a key
    at a time, or of two parts of it where they have more than ``GROUP_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _lists(batches):
            nodes = table.column("node").to_numpy()
            sets = [shingle_hashes(t.as_py(), shingle) for t in table.column("text")]
            found = links_between(_tallied(table.column("signature")), table.column("root").to_numpy(), lambda i, j: similarity(sets[i], sets[j]) >= least)  # noqa: B023
            if found:
                i, j = (nodes[list(x)] for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(i, j)), pa.array(np.minimum(i, j))], ["u", "v"])

    sizes = members.groupBy("key").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    count = F.greatest("rows", F.ceil(F.col("bytes") * huge_list / GROUP_BYTES)).alias("count")
    sizes = scratch.save(sizes.select("key", count), "left-out-sizes")
    dealt = _dealt(members.join(sizes, "key"), huge_list).select("key", "node", "root", "signature", "text")
    return dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "u long, v long").distinct()


def verified(links: DataFrame, texts: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """The links whose texts (``node, text``) have a similarity of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                pairs = zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)
                keep = [similarity(shingle_hashes(x, shingle), shingle_hashes(y, shingle)) >= least for x, y in pairs]
                yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    side = lambda node, text: texts.select(F.col("node").alias(node), F.col("text").alias(text))
    return links.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def among(df: DataFrame, key: str, keys: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` that may have a ``key`` of the table ``keys``, rows that have none). No row is moved for that: a bitmap
    of ``MARKS`` hashes, 2 MB whatever the tables, is broadcast. Where it is full more rows may have one."""
    at = F.pmod(F.xxhash64(key), F.lit(MARKS))
    place, bit = F.shiftright(at, 15).alias("_place"), at.bitwiseAND(F.lit((1 << 15) - 1))
    marks = scratch.save(keys.select(place, bit.alias("bit")).groupBy("_place").agg(F.bitmap_construct_agg("bit").alias("_bits")), name)
    byte = "CAST(conv(hex(substring(_bits, CAST((_bit >> 3) + 1 AS INT), 1)), 16, 10) AS INT)"
    marked = F.expr(f"coalesce(({byte} >> CAST(_bit & 7 AS INT)) & 1 = 1, false)")
    rows = df.withColumns({"_place": F.shiftright(at, 15), "_bit": bit}).join(F.broadcast(marks), "_place", "left")
    return rows.filter(marked).select(*df.columns), rows.filter(~marked).select(*df.columns)


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, **limits: int) -> DataFrame:
    """One document of each component, that with its least doc_id, with the columns of ``docs``.

    A component is known by its root, as null and repeated ids don't tell components apart. Null ids come last; of rows
    that repeat an id in a component, that of the least hash of its text stays. ``limits`` are those of ``near_links``.
    """
    scratch = Scratch(docs.sparkSession, "wordsets")
    text_key = F.md5(F.coalesce("text", F.lit("")))
    slim = docs.select(F.col("doc_id").alias("id"), text_key.alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    rows = scratch.save(with_signature(slim, shingle), "rows")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_key")).alias("first")
    nodes = scratch.save(rows.groupBy("node").agg(F.min("signature").alias("signature"), first, F.count("*").alias("copies")), "nodes")
    links = scratch.save(near_links(nodes.select("node", "signature"), scratch, **limits), "candidates")
    # written, so that where few texts are linked the others aren't moved
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ends = scratch.save(ends.join(nodes.select("node", "first.text_key"), "node"), "ends")
    asked, _ = among(slim.select("text_key", "text"), "text_key", ends, scratch, "asked")
    texts = scratch.save(asked.join(ends, "text_key").dropDuplicates(["node"]).select("node", "text"), "texts")
    good = scratch.save(verified(links, texts, shingle, least), "passing")
    roots = components(good, scratch)
    failed = scratch.save(links.join(good, ["u", "v"], "left_anti"), "failed")
    if not failed.isEmpty():
        again = Scratch(docs.sparkSession, "wordsets")
        members = parts_of(failed, roots, nodes, again).join(nodes.select("node", "signature"), "node").join(texts, "node")
        more = links_left_out(again.save(members, "texts"), again, shingle, least, limits.get("huge_list", HUGE_LIST))
        more = again.save(more, "left-out")
        if not more.isEmpty():
            roots = components(good.unionAll(more), Scratch(docs.sparkSession, "wordsets"))
    rooted = nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").select(F.coalesce("v", "node").alias("root"), "first")
    # one key of id and text, so that the join and what drops repeated rows share their shuffle
    key = lambda id_, text: F.concat(F.when(id_.isNull(), "n").otherwise(F.concat(F.lit("="), id_.cast("string"))), F.lit(" "), text)
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(key(F.col("first.id"), F.col("first.text_key")).alias("doc_key"))
    kept = scratch.save(kept, "kept")
    whole = docs.select(F.struct("*").alias("row"), key(F.col("doc_id"), text_key).alias("doc_key"))
    # a row that is neither linked nor has a copy stays where it is
    several = nodes.filter("copies > 1").select("node").unionAll(roots.select(F.explode(F.array("u", "v")).alias("node")))
    several, _ = among(rows.select("id", "text_key", "node"), "node", several, scratch, "several")
    several, alone = among(whole, "doc_key", several.select(key(F.col("id"), F.col("text_key")).alias("doc_key")), scratch, "doubtful")
    firsts = several.join(kept, "doc_key", "left_semi").dropDuplicates(["doc_key"])
    return alone.unionByName(firsts).select("row.*")
