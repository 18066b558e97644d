"""Language model with Katz backoff, learned from and applied to a whole corpus.

Counts of n-grams are discounted by Good-Turing's estimate, and what a context
saves goes to the words it was not seen with, by the model of one word less:

    P(w | h) = d(c) c(h w) / c(h)       if h w was seen
             = alpha(h) P(w | h')       else, h' being h without its first word

Below one word every type has P = 1 / (V + 1): the V types of the training tokens
and one for all unknown words. ``alpha(h)`` is what the seen words leave over,
divided by what P(. | h') gives to all words but these, so that the V + 1
probabilities of every context sum to 1. Counts up to 5 are discounted. Where
Good-Turing's estimate of a discount is not between 0 and 1, as in small corpora,
d(c) = c / (c + 1). A context without any discounted word counts one more token,
which is what it leaves over. A context that was never seen has alpha = 1.

Tasks see documents in blocks of tokens; a block holds each different n-gram of
its tokens once. For one n after the other (1, 2, ...)

1. blocks ask: they send their n-grams, with counts and the probability of the
   word after h', to buckets of contexts (the one shuffle of n-grams),
2. buckets merge the counts of all blocks and are written, a table partitioned by
   context; its counts of counts give the discounts,
3. buckets answer: counts, numbers and the backoff weight of each context go back
   to the blocks that asked, which have P for each of their n-grams then.

So the recursion of a token is evaluated level by level, and each level's table
is made and normalised with the level below. A context with very many tokens is
dealt to several buckets by its words, and its parts are summed; the empty
context of the level 1 is such a one. Blocks, buckets and rows are bounded, their
numbers grow with the corpus. Numbers travel as packed arrays (sorted ones as
differences, by byte planes, compressed). Words are known by 64-bit hashes: among
a thousand million different words some two share one with a chance of 3 %.

A null text is an empty one, and an empty one is a single end token. Texts of any
length are treated whole: a long one spans several blocks, with the tokens before
as history. Repeated rows count as often as they come and have equal scores. In an
empty training set every token is unknown: P = 1. Null ids count as empty ones
when documents are held out. Extra columns aren't read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.plans import Scratch

#: Words of an n-gram at most.
ORDER = 2
#: Counts up to this one are discounted.
DISCOUNTED = 5
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Limits:
    """Bounds of what a task holds; they change no result."""

    #: tokens of a block
    block: int = 2_000_000
    #: n-grams that blocks send to a bucket, about
    bucket: int = 1_500_000
    #: tokens of a context that a bucket holds alone; larger ones are dealt by their words
    context: int = 300_000
    #: bytes of a text that are split at once
    text: int = 8_000_000


_SPACE = re.compile(rb"[\x20\t-\r]")
#: The end token's place among the hashes of words.
_END = np.uint64(1)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; sorted integers as differences."""
    heads, parts = [], []
    for a in arrays:
        is_sorted = a.dtype.kind in "iu" and len(a) > 1 and bool(np.all(a[1:] >= a[:-1]))
        if is_sorted:
            a = np.concatenate([a[:1], np.diff(a)])
        heads.append((len(a), f"{a.dtype.str}{'+' if is_sorted else ''}"))
        parts.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    head = ";".join(f"{n},{kind}" for n, kind in heads).encode()
    body = b"".join(parts)
    return len(head).to_bytes(4, "little") + len(body).to_bytes(8, "little") + head + pa.compress(body, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    """The arrays of ``pack``."""
    n_head, n_body = int.from_bytes(data[:4], "little"), int.from_bytes(data[4:12], "little")
    body = np.frombuffer(pa.decompress(data[12 + n_head :], decompressed_size=n_body, codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for head in data[12 : 12 + n_head].decode().split(";"):
        n, kind = head.split(",")
        dtype = np.dtype(kind.rstrip("+"))
        size = int(n) * dtype.itemsize
        a = np.ascontiguousarray(body[at : at + size].reshape(dtype.itemsize, int(n)).T).view(dtype).reshape(int(n))
        out.append(np.cumsum(a, dtype=dtype) if kind.endswith("+") else a)
        at += size
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit numbers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _slices(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of a text of about ``size`` bytes that no word spans."""
    at = 0
    while len(data) - at > size:
        space = _SPACE.search(data, at + size)
        if not space:
            break
        yield data[at : space.end()]
        at = space.end()
    yield data[at:] if at else data


_BLOCKS = "block long, n_tokens long, n_words long, ids array<{id}>, pieces binary, words binary, tokens binary"


class _Block:
    """Collects pieces of documents. Token -1 is the mark before a document's first one."""

    def __init__(self, order: int):
        self.order = order
        self.index: dict[bytes | None, int] = {}
        self.pieces: list[np.ndarray] = []
        self.rows: list[tuple[int, bool]] = []
        self.ids: list = []
        self.n = 0

    def numbers(self, words: list) -> np.ndarray:
        index = self.index
        for w in set(words):
            if w not in index:
                index[w] = len(index)
        return np.fromiter(map(index.__getitem__, words), np.int64, len(words))

    def add(self, row: int, doc_id: object, train: bool, history: list, words: list) -> None:
        before = [-1 if w is False else self.index.setdefault(w, len(self.index)) for w in history]
        self.pieces.append(np.concatenate([np.array(before, np.int64), self.numbers(words)]))
        self.rows.append((row, train))
        self.ids.append(doc_id)
        self.n += len(words)

    def batch(self, block: int, id_type: pa.DataType) -> pa.RecordBatch:
        hashes = np.array([_END if w is None else xxhash.xxh3_64_intdigest(w) for w in self.index], np.uint64)
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tokens = np.concatenate(self.pieces)
        tokens = np.where(tokens < 0, 0, place[tokens] + 1).astype(np.uint32)
        pieces = pack(np.array([r for r, _ in self.rows], np.int64), np.array([len(p) for p in self.pieces], np.int64), np.array([t for _, t in self.rows], np.uint8))
        values = [[block], [self.n], [len(order)], [self.ids], [pieces], [pack(hashes[order])], [pack(tokens)]]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(id_type), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], [f.split()[0] for f in _BLOCKS.split(", ")])


def token_blocks(docs: DataFrame, train: Column, order: int = ORDER, limits: Limits = Limits()) -> DataFrame:
    """The corpus as blocks of tokens, a row for each."""
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        block, n_blocks, row, id_type = _Block(order), 0, 0, None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text, train_ in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("train").to_pylist(), strict=True):
                data = (text.as_py() or "").encode().translate(_LOWER)
                # False is the mark before the first token, None the end
                history: list = [False] * (order - 1)
                for part, last in _marked(_slices(data, limits.text)):
                    words: list = part.split()
                    if last:
                        words.append(None)
                    at = 0
                    while at < len(words):
                        some = words[at : at + limits.block - block.n]
                        block.add(base + row, doc_id, train_, history, some)
                        history = (history + some)[len(history + some) - (order - 1) :] if len(some) < order - 1 else some[len(some) - (order - 1) :]
                        at += len(some)
                        if block.n >= limits.block:
                            yield block.batch(base + n_blocks, id_type)
                            block, n_blocks = _Block(order), n_blocks + 1
                row += 1
        if block.n:
            yield block.batch(base + n_blocks, id_type)

    return rows.mapInArrow(run, _BLOCKS.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _marked(parts: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Items with whether they are the last."""
    item = next(parts)
    for following in parts:
        yield item, False
        item = following
    yield item, True


class Grams:
    """The different n-grams of a block, level by level; places in arrays are the block's own numbers for them."""

    def __init__(self, pieces: bytes, words: bytes, tokens: bytes, order: int, upto: int):
        self.rows, lengths, train = unpack(pieces)
        self.hashes = unpack(words)[0]
        self.tokens = unpack(tokens)[0].astype(np.int64) - 1
        n = len(self.tokens)
        starts = np.cumsum(lengths) - lengths
        place = np.arange(n) - np.repeat(starts, lengths)
        self.piece = np.repeat(np.arange(len(lengths)), lengths)
        #: Tokens that are predicted; those before them are history.
        self.own = place >= order - 1
        self.counted = self.own & (train[self.piece] > 0)
        self.train = train
        self.at = [self.tokens]
        n_words = int(self.tokens.max(initial=-1)) + 1
        self.context = [np.zeros(n_words, np.int64)]
        self.word = [np.arange(n_words)]
        self.first: list[np.ndarray | None] = [None]
        for level in range(2, upto + 1):
            before = np.concatenate([[-1], self.at[-1][:-1]])
            some = np.flatnonzero((place >= level - 1) & (self.tokens >= 0))
            keys = ((before[some] + 1) << 32) | self.tokens[some]
            found, first, number = np.unique(keys, return_index=True, return_inverse=True)
            at = np.full(n, -1)
            at[some] = number
            self.at.append(at)
            self.context.append((found >> 32) - 1)
            self.word.append(found & 0xFFFFFFFF)
            self.first.append(some[first])

    def counts(self, level: int) -> np.ndarray:
        at = self.at[level - 1][self.counted]
        return np.bincount(at[at >= 0], minlength=len(self.word[level - 1]))


class Known:
    """What answers tell a block of its n-grams: numbers, counts and probabilities by level."""

    def __init__(self, grams: Grams, limits: Limits):
        self.grams, self.limits = grams, limits
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.probs: list[np.ndarray] = []

    def asked(self, level: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n-grams of the level in the order they are sent: places, buckets, contexts, words, parts of the context."""
        g = self.grams
        if level == 1:
            context, word = np.zeros(len(g.hashes), np.int64), g.hashes.view(np.int64)
            parts = np.full(len(word), n_buckets)
        else:
            of = g.context[level - 1]
            ids, counts = self.ids[level - 2], self.counts[level - 2]
            context, word = np.where(of < 0, 0, ids[of]), self.ids[0][g.word[level - 1]]
            parts = np.where(of < 0, n_buckets, 1 + counts[of] // self.limits.context)
        bucket = (_mixed(context) % np.uint64(n_buckets) + _mixed(word) % parts.astype(np.uint64)) % np.uint64(n_buckets)
        order = np.lexsort((word, context, bucket))
        return order, bucket[order].astype(np.int64), context[order], word[order], parts[order]

    def lower(self, level: int, n_types: int) -> np.ndarray:
        """P of each n-gram's last word after the context without its first."""
        if level == 1:
            return np.full(len(self.grams.word[0]), 1.0 / (n_types + 1))
        return self.probs[level - 2][self.grams.at[level - 2][self.grams.first[level - 1]]]

    def take(self, level: int, n_buckets: int, answers: dict[int, bytes], discounts: list[float], n_types: int) -> None:
        """Adds what the buckets answered."""
        order, bucket, context, _, _ = self.asked(level, n_buckets)
        numbers = np.empty(len(order), np.int64)
        counts = np.empty(len(order), np.int64)
        total, alpha = np.empty(len(order)), np.empty(len(order))
        bounds = np.flatnonzero(np.diff(bucket, prepend=-1))
        for first, stop in zip(bounds, [*bounds[1:], len(order)], strict=True):
            c, i, t, a = unpack(answers[int(bucket[first])])
            here = order[first:stop]
            counts[here], numbers[here] = c, i
            which = np.cumsum(np.diff(context[first:stop], prepend=context[first]) != 0)
            total[here], alpha[here] = t[which], a[which]
        self.ids.append(numbers)
        self.counts.append(counts)
        seen = np.array([0.0, *discounts, 1.0])[np.minimum(counts, DISCOUNTED + 1)] * counts / np.maximum(total, 1)
        self.probs.append(np.where(counts > 0, seen, alpha * self.lower(level, n_types)))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a sorted array and how often each comes."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[starts], np.diff(np.concatenate([starts, [len(values)]]))


def _narrow(values: np.ndarray) -> np.ndarray:
    """Not negative integers in the width they need."""
    top = int(values.max(initial=0))
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _by_value(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    different, which = np.unique(values, return_inverse=True)
    return different, _narrow(which)


def question(known: Known, level: int, n_buckets: int, n_types: int) -> Iterator[tuple[int, bytes]]:
    """A packed question for each bucket."""
    order, bucket, context, word, parts = known.asked(level, n_buckets)
    counts, lower = known.grams.counts(level)[order], known.lower(level, n_types)[order]
    bounds = np.flatnonzero(np.diff(bucket, prepend=-1))
    for first, stop in zip(bounds, [*bounds[1:], len(order)], strict=True):
        s = slice(first, stop)
        contexts, lengths = _runs(context[s])
        starts = first + np.cumsum(lengths) - lengths
        yield int(bucket[first]), pack(contexts, _narrow(lengths), _narrow(parts[starts]), *_by_value(word[s]), _narrow(counts[s]), *_by_value(lower[s]))


_TABLE = "bucket long, counts_of_counts array<long>, grams binary, blocks array<long>, asked array<binary>"


def merge(bucket: int, blocks: list[int], questions: list[bytes]) -> dict:
    """A bucket of the level's table: different n-grams with the counts of all blocks, and which of them each block asked for."""
    parts: list[list[np.ndarray]] = []
    for q in questions:
        contexts, lengths, pieces, words, which, counts, lowers, of = unpack(q)
        lengths = lengths.astype(np.int64)
        parts.append([np.repeat(contexts, lengths), words[which], counts.astype(np.int64), lowers[of], np.repeat(pieces, lengths).astype(np.int64)])
    sizes = [len(p[0]) for p in parts]
    context, word, counts, lower, pieces = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((word, context))
    context, word = context[order], word[order]
    new = np.concatenate([[True], (context[1:] != context[:-1]) | (word[1:] != word[:-1])])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    total = np.add.reduceat(counts[order], starts)
    by_count = np.bincount(np.minimum(total, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
    ends = np.cumsum(sizes)
    contexts, lengths = _runs(context[starts])
    first = starts[np.cumsum(lengths) - lengths]
    return {
        "bucket": bucket,
        # n-grams seen once, twice, ... then all seen, and their tokens
        "counts_of_counts": [*by_count[1 : DISCOUNTED + 2].tolist(), int((total > 0).sum()), int(total.sum())],
        "grams": pack(contexts, _narrow(lengths), _narrow(pieces[order][first]), *_by_value(word[starts]), _narrow(total), *_by_value(lower[order][starts])),
        "blocks": blocks,
        "asked": [pack(number[e - n : e]) for n, e in zip(sizes, ends, strict=True)],
    }


def discounts(by_count: list[int]) -> list[float]:
    """Katz's discounts of the counts 1 to ``DISCOUNTED`` by Good-Turing's estimate from how many n-grams have the counts 1, 2, ..."""
    out = []
    k, n = DISCOUNTED, [0, *by_count]
    rest = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        out.append(d if 0 < d < 1 else r / (r + 1))
    return out


class Bucket:
    """An unpacked bucket with the sums of its contexts."""

    def __init__(self, grams: bytes, discount: list[float]):
        self.contexts, lengths, self.parts, words, which, counts, lowers, of = unpack(grams)
        self.lengths = lengths.astype(np.int64)
        self.counts = counts.astype(np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        factor = np.array([0.0, *discount, 1.0])[np.minimum(self.counts, DISCOUNTED + 1)]
        #: by context: tokens, discounted tokens, P of the seen words one level below, discounted words
        self.sums = np.stack([add(self.counts.astype(float)), add(factor * self.counts), add(np.where(self.counts > 0, lowers[of], 0.0)), add(((self.counts > 0) & (self.counts <= DISCOUNTED)).astype(float))])


def backoff(sums: np.ndarray, n_types: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """By context: the divisor of its counts, and alpha. ``n_types`` on level 1, where one type of them all and one more is unseen."""
    tokens, kept, lower, discounted = sums
    # without any discounted word, one token more is left over
    total = np.where((tokens > 0) & (discounted == 0), tokens + 1, tokens)
    left = np.where(tokens > 0, (total - kept) / np.maximum(total, 1), 1.0)
    return total, left * (n_types + 1) if n_types is not None else left / np.maximum(1.0 - lower, np.finfo(float).tiny)


_SUMS = "bucket long, context long, tokens double, kept double, lower double, discounted double"


def _split_sums(table: DataFrame, discount: list[float]) -> DataFrame:
    """A row for each bucket and context that is dealt to several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, grams in zip(batch.column("bucket").to_pylist(), batch.column("grams"), strict=True):
                b = Bucket(grams.as_py(), discount)
                some = np.flatnonzero(b.parts > 1)
                columns = [pa.array(np.full(len(some), bucket)), pa.array(b.contexts[some]), *(pa.array(x) for x in b.sums[:, some])]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SUMS.split(", ")])

    return table.select("bucket", "grams").mapInArrow(run, _SUMS)


def _answers(table: DataFrame, discount: list[float], n_buckets: int, level: int, last: bool, n_types: int) -> DataFrame:
    """``block, level, bucket, answer`` for each question."""
    sums = Scratch(table.sparkSession, "katz-sums").save(_split_sums(table, discount), "sums")
    names = ("tokens", "kept", "lower", "discounted")
    whole = sums.groupBy("context").agg(*[F.sum(c).alias(c) for c in names])
    shared = sums.select("bucket", "context").join(whole, "context").groupBy("bucket").agg(F.collect_list(F.struct("context", *names)).alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Bucket(row["grams"], discount)
                for s in row["shared"] or []:
                    b.sums[:, np.searchsorted(b.contexts, s["context"])] = [s[c] for c in names]
                total, alpha = backoff(b.sums, n_types if level == 1 else None)
                of = np.repeat(np.arange(len(b.contexts)), b.lengths)
                out = []
                for block, asked in zip(row["blocks"], row["asked"], strict=True):
                    which = unpack(asked)[0]
                    contexts = _runs(of[which])[0]
                    number = np.zeros(len(which), np.uint8) if last else 1 + row["bucket"] + which * n_buckets
                    out.append(pack(_narrow(b.counts[which]), number, _narrow(total[contexts].astype(np.int64)), alpha[contexts]))
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array(row["blocks"], pa.int64()), pa.array([level] * n, pa.int32()), pa.array([row["bucket"]] * n, pa.int64()), pa.array(out, pa.binary())], ["block", "level", "bucket", "answer"])

    return table.drop("counts_of_counts").join(shared, "bucket", "left").mapInArrow(run, "block long, level int, bucket long, answer binary")


class Katz:
    """The levels of a model over a corpus in blocks: sizes, discounts and answers so far."""

    def __init__(self, blocks: DataFrame, order: int, limits: Limits, n_tokens: int, n_words: int, n_blocks: int):
        self.blocks, self.order, self.limits, self.n_blocks = blocks, order, limits, n_blocks
        self.scratch = Scratch(blocks.sparkSession, "katz")
        self.sizes = (n_words, n_tokens)
        self.n_buckets: list[int] = []
        self.discounts: list[list[float]] = []
        self.answers: list[DataFrame] = []
        self.n_types = self.n_train = 0

    def per_block(self, columns: list[str], upto: int, run: Callable[[Known, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """Applies ``run`` to every block, with what is known of the levels below ``upto``."""
        order, limits, n_buckets, discount, n_types = self.order, self.limits, list(self.n_buckets), list(self.discounts), self.n_types
        rows = self.blocks.select("block", *columns)
        if self.answers:
            told = self.answers[0]
            for a in self.answers[1:]:
                told = told.unionAll(a)
            # both sides are dealt alike, so the blocks are shuffled once
            told = told.repartition(max(1, self.n_blocks), "block").groupBy("block").agg(F.collect_list(F.struct("level", "bucket", "answer")).alias("told"))
            rows = rows.repartition(max(1, self.n_blocks), "block").join(told, "block", "left")

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].values if c == "ids" else batch.column(c)[k].as_py() for c in batch.schema.names}
                    known = Known(Grams(row["pieces"], row["words"], row["tokens"], order, upto), limits)
                    for level in range(1, len(n_buckets) + 1):
                        told_ = {t["bucket"]: t["answer"] for t in row["told"] or [] if t["level"] == level}
                        known.take(level, n_buckets[level - 1], told_, discount[level - 1], n_types)
                    yield from run(known, row)

        return rows.mapInArrow(each, schema)

    def build(self) -> None:
        for level in range(1, self.order + 1):
            n_buckets = max(1, math.ceil(self.sizes[level > 1] / self.limits.bucket))
            n_types = self.n_types

            def ask(known: Known, row: dict, level: int = level, n_buckets: int = n_buckets, n_types: int = n_types) -> Iterator[pa.RecordBatch]:
                for bucket, packed in question(known, level, n_buckets, n_types):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([row["block"]], pa.int64()), pa.array([packed], pa.binary())], ["bucket", "block", "question"])

            def put_together(table: pa.Table) -> pa.Table:
                table = table.sort_by("block")
                row = merge(table.column("bucket")[0].as_py(), table.column("block").to_pylist(), table.column("question").to_pylist())
                types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())]
                return pa.table({k: pa.array([v], t) for (k, v), t in zip(row.items(), types, strict=True)})

            asked = self.per_block(["pieces", "words", "tokens"], level, ask, "bucket long, block long, question binary")
            table = self.scratch.save(asked.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(put_together, _TABLE), f"level-{level}")
            found = {r.pos: r.n for r in table.select(F.posexplode("counts_of_counts").alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()}
            by_count = [found.get(k, 0) for k in range(DISCOUNTED + 3)]
            if level == 1:
                self.n_types, self.n_train = by_count[-2:]
            discount = discounts(by_count[: DISCOUNTED + 1])
            self.answers.append(self.scratch.save(_answers(table, discount, n_buckets, level, level == self.order, self.n_types), f"answers-{level}"))
            self.n_buckets.append(n_buckets)
            self.discounts.append(discount)


_SCORES = "row long, doc_id {id}, n_tokens long, n_known long, base_score double, score double"


def token_scores(docs: DataFrame, train: Column, order: int = ORDER, limits: Limits = Limits()) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every document, by a model of the rows where ``train`` holds."""
    scratch = Scratch(docs.sparkSession, "katz-blocks")
    blocks = scratch.save(token_blocks(docs, train, order, limits), "blocks")
    size = blocks.agg(F.sum("n_tokens").alias("t"), F.sum("n_words").alias("w"), F.count("*").alias("b")).first()
    model = Katz(blocks, order, limits, size.t or 0, size.w or 0, size.b)
    model.build()
    n_types, n_train = model.n_types, model.n_train

    def score(known: Known, row: dict) -> Iterator[pa.RecordBatch]:
        g = known.grams
        tokens, of = g.tokens[g.own], g.piece[g.own]
        counts = known.counts[0][tokens]
        n = len(g.rows)
        add = lambda x: np.bincount(of, weights=x, minlength=n)
        base = add(np.log10((counts + 1) / (n_train + n_types + 1)))
        best = add(np.log10(known.probs[-1][g.at[-1][g.own]]))
        longs = lambda x: pa.array(x.astype(np.int64))
        known_ = add((counts > 0).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(g.rows), row["ids"], longs(np.bincount(of, minlength=n)), longs(known_), pa.array(base), pa.array(best)], [f.split()[0] for f in _SCORES.split(", ")])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = model.per_block(["ids", "pieces", "words", "tokens"], order, score, _SCORES.format(id=id_type))
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known")] + [F.lit(n_train).cast("long").alias("train_tokens")] + [F.sum(c).alias(c) for c in ("base_score", "score")]
    return parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *sums).drop("row")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: its id's CRC-32 leaves 2 when divided by 7."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document."""
    rows = token_scores(docs, ~held_out(F.col("doc_id")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
