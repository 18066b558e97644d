"""Best-fit packing of token sequences.

1. ``tokenize_pieces``: each text becomes byte-level BPE ids, with the ids of
   added tokens for their strings, and a closing id.
   A document longer than a sequence is cut into full pieces, the first piece
   taking what is left over.
2. ``pack_pieces``: pieces shorter than a sequence are dealt to packing groups
   whose number follows from their count. Each group streams its pieces, longest
   first, through ``BestFit``: a fixed number of open bins in a bitset keyed by
   free space. A piece goes to the open bin with the least space that holds it;
   when a new bin is needed and all are open, the fullest closes first. Groups
   have fewer pieces than bins, so that only repeated rows reach the limit.

A group's state is the open bins, whatever its number of pieces. Up to
``PARTITIONS`` tasks pack one group after the other, so that their number doesn't
grow with the corpus. Null and empty texts give one piece with the closing id;
texts of any length are tokenized whole. Repeated rows are packed as often as
they occur; pieces of equal length are in order of id, piece and checksum. An
empty table packs to an empty table. Extra columns aren't read, whatever their
names.
"""

from __future__ import annotations

import array
import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.plans import Scratch

SEQUENCE = 1024
END_ID = 2
OPEN_BINS = 4096
#: Fewer than ``OPEN_BINS`` by more than hashing varies, so that no bin closes while a shorter piece is to come.
PIECES_PER_GROUP = 3_700
PARTITIONS = 8_000

#: Without runs of white space the look-ahead of the published pattern changes nothing.
_SIMPLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_RUN = re.compile(r"\s\s")
_encoders: dict[str, tuple] = {}
_added: dict[str, dict[str, int]] = {}


def encoder(vocabulary: str | None = None):
    """Function text -> ids of the byte-level BPE vocabulary (a .tiktoken file), cached in the process.

    The strings of added tokens are ordinary text; ``document_encoder`` knows them.
    """
    import public_tokenizers
    import tiktoken

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _encoders:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
        _encoders[path] = tuple(
            tiktoken.Encoding("bytes", pat_str=p, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary
            for p in (public_tokenizers.PATTERN, _SIMPLE)
        )
    full, simple = _encoders[path]
    return lambda text: (full if _RUN.search(text) else simple)(text)


def added_tokens(path: str) -> dict[str, int]:
    """String -> id of the tokens that a tokenizer file (.json) adds to its vocabulary, cached in the process."""
    if path not in _added:
        with open(path, encoding="utf-8") as f:
            tokens = json.load(f).get("added_tokens") or []
        if any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"added tokens with strip or word rules: {path}")
        _added[path] = {t["content"]: t["id"] for t in tokens}
    return _added[path]


def document_encoder(vocabulary: str | None = None):
    """As ``encoder``, but the strings of added tokens become their ids, as in the tokenizer's default settings.

    The tokenizer file lies beside the ranks; ranks without one have no added tokens.
    """
    import public_tokenizers

    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    file = os.path.splitext(path)[0] + ".json"
    added = added_tokens(file) if os.path.exists(file) else {}
    plain = encoder(vocabulary)
    if not added:
        return plain
    find = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def encode(text: str) -> list[int]:
        if not find.search(text):
            return plain(text)
        ids: list[int] = []
        for k, part in enumerate(find.split(text)):
            if k % 2:
                ids.append(added[part])
            elif part:
                ids += plain(part)
        return ids

    return encode


def cut(n: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % size
    starts = ([0] if first else []) + list(range(first, n, size))
    return [(s, first if first and s == 0 else size) for s in starts]


class BestFit:
    """Online best fit over at most ``bins`` open bins of ``size`` tokens."""

    def __init__(self, size: int = SEQUENCE, bins: int = OPEN_BINS):
        self.size, self.limit = size, bins
        self.free: list[list[int]] = [[] for _ in range(size + 1)]  # open bins by free space
        self.bits = 0  # bit s is set if a bin with free space s is open
        self.open = self.next = 0

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) for a piece of ``n`` tokens."""
        above = self.bits >> n
        if above:
            space = n + (above & -above).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            space, bin_ = self.size, self.next
            self.next += 1
        left = space - n
        if left:
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.size - space

    def _take(self, space: int) -> int:
        bins = self.free[space]
        bin_ = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.open -= 1
        return bin_


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenize_pieces(docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = document_encoder(vocabulary)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = array.array("I", encode(text) if text else [])
                ids.append(END_ID)
                data = memoryview(ids.tobytes())
                rows += [(doc_id, i, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for i, (s, n) in enumerate(cut(len(ids), size))]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE_SCHEMA)


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE, bins: int = OPEN_BINS, per_group: int = PIECES_PER_GROUP, partitions: int = PARTITIONS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces.

    A full piece is a sequence of its own and isn't shuffled; its id is negative.
    """
    short = pieces.filter(F.col("length") < size)
    groups = max(1, -(-short.count() // per_group))
    names = [f.name for f in pieces.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, group = BestFit(size, bins), None
        first = TaskContext.get().partitionId() << 40
        for b in batches:
            sequences, offsets = [], []
            for g, n in zip(b.column("_group").to_pylist(), b.column("length").to_pylist(), strict=True):
                if g != group:
                    first += fit.next
                    fit, group = BestFit(size, bins), g
                x, y = fit.place(n)
                sequences.append(first + x)
                offsets.append(y)
            columns = [*(b.column(n) for n in names), pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    packed = (
        short.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
        .repartition(min(groups, partitions), "_group")
        .sortWithinPartitions("_group", F.desc("length"), "doc_id", "piece", "ids_crc32")
        .mapInArrow(run, schema)
    )
    whole = pieces.filter(F.col("length") >= size).select(
        *names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionAll(whole)


def pack_documents(docs: DataFrame, size: int = SEQUENCE, bins: int = OPEN_BINS, vocabulary: str | None = None) -> DataFrame:
    """Tokenizes and packs all documents."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack_pieces(scratch.save(tokenize_pieces(docs, size, vocabulary), "pieces"), size, bins)
