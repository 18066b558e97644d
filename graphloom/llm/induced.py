"""External induced suffix sorting with common-prefix values, to a bounded depth.

Suffixes are sorted by their first ``DEPTH`` characters, which is all that
equal strings of that length need. As in induced sorting only the LMS suffixes
(an S-type character after an L-type one) are sorted directly; of the others
each follows from the suffix after it: one scan from the least character up
induces the L-type suffixes, one from the greatest down the S-type ones.

Both scans take suffixes from a priority queue of (first character, order of
arrival): the queue is one disk-backed FIFO for each character, for suffixes
arrive in their order. A tuple carries the suffix and the common prefix of its
successor with the successor before it in the same FIFO; one more is the common
prefix of the two suffixes, so no earlier value is ever looked up. Suffixes that
induce one of their own character wait for the next round of its FIFO.

In memory are a buffer for each FIFO, a chunk, and 32 bytes for each LMS suffix;
the text is an array that may be mapped from disk.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Characters by which suffixes are sorted, in words of 7 packed characters.
WORD, WORDS = 7, 8
DEPTH = WORD * WORDS
BITS = 9
CHUNK = 1 << 18
BUFFER = 1 << 14
ITEM = np.dtype([("at", np.int64), ("lcp", np.int32)])


class DiskQueue:
    """A FIFO of (suffix, common prefix) that keeps ``BUFFER`` tuples in memory and the rest in an unnamed file."""

    def __init__(self):
        self.held: list[np.ndarray] = []
        self.n_held = self.n_file = 0
        self.file = None

    def push(self, at: np.ndarray, lcp: np.ndarray) -> None:
        items = np.empty(len(at), ITEM)
        items["at"], items["lcp"] = at, lcp
        self.held.append(items)
        self.n_held += len(items)
        if self.n_held > BUFFER:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for x in self.held:
                self.file.write(x.tobytes())
            self.n_file += self.n_held
            self.held, self.n_held = [], 0

    def __len__(self) -> int:
        return self.n_file + self.n_held

    def _read(self, first: int, n: int) -> np.ndarray:
        self.file.seek(first * ITEM.itemsize)
        return np.frombuffer(self.file.read(n * ITEM.itemsize), ITEM)

    def chunks(self, reverse: bool = False) -> Iterator[np.ndarray]:
        """All tuples in chunks, from the last to the first if ``reverse``."""
        starts = range(0, self.n_file, CHUNK)
        tail = np.concatenate(self.held) if self.held else np.empty(0, ITEM)
        if reverse:
            if len(tail):
                yield tail[::-1]
            for s in reversed(starts):
                yield self._read(s, min(CHUNK, self.n_file - s))[::-1]
        else:
            for s in starts:
                yield self._read(s, min(CHUNK, self.n_file - s))
            if len(tail):
                yield tail


def suffix_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is S-type, less than the one after it; the last isn't."""
    s = np.zeros(len(text), bool)
    after, after_s = -1, False
    for end in range(len(text), 0, -CHUNK):
        begin = max(0, end - CHUNK)
        block = text[begin:end].astype(np.int64)
        nxt = np.append(block[1:], after)
        differs = np.append(block != nxt, True)
        less = np.append(block < nxt, after_s)
        # the type of a run of equal characters is that of its last
        last = np.minimum.accumulate(np.where(differs, np.arange(len(differs)), len(differs))[::-1])[::-1]
        s[begin:end] = less[last[:-1]]
        after, after_s = int(block[0]), bool(s[begin])
    return s


def _word(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """7 characters from ``at`` packed in order, 0 beyond the end."""
    out = np.zeros(len(at), np.int64)
    for k in range(WORD):
        inside = at + k < len(text)
        c = np.zeros(len(at), np.int64)
        c[inside] = text[at[inside] + k].astype(np.int64) + 1
        out = out << BITS | c
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal characters at the front of packed words that differ."""
    return (WORD * BITS - np.frexp((a ^ b).astype(np.float64))[1]) // BITS


def sort_lms(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes in order of their first ``DEPTH`` characters, and the common prefix of each with the one before."""
    word = _word(text, at)
    order = np.argsort(word, kind="stable")
    at, word = at[order], word[order]
    lcp = np.zeros(len(at), np.int32)
    same = np.append(False, word[1:] == word[:-1])
    lcp[1:] = np.where(same[1:], WORD, _common(word[1:], word[:-1])) if len(at) else 0
    for depth in range(WORD, DEPTH, WORD):
        tied = same | np.append(same[1:], False)
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        group = np.cumsum(~same)[rows]
        word = _word(text, at[rows] + depth)
        order = np.lexsort((word, group))
        at[rows], word = at[rows][order], word[order]
        equal_group = np.append(False, group[1:] == group[:-1])
        equal = equal_group & np.append(False, word[1:] == word[:-1])
        common = np.full(len(rows), depth + WORD, np.int32)
        apart = np.flatnonzero(equal_group & ~equal)
        common[apart] = depth + _common(word[apart], word[apart - 1])
        lcp[rows[equal_group]] = common[equal_group]
        same = np.zeros(len(at), bool)
        same[rows] = equal
    return at, lcp


class _Inducer:
    """FIFOs by character, fed in the order of a scan."""

    def __init__(self, text: np.ndarray, size: int):
        self.text, self.size = text, size
        self.queues = [DiskQueue() for _ in range(size)]
        #: Common prefix of the suffix taken last with the last one that fed each FIFO.
        self.since = np.full(size, DEPTH, np.int32)

    def take(self, at: np.ndarray, lcp: np.ndarray, induces: np.ndarray, before: np.ndarray) -> None:
        """Suffixes in scan order with the common prefix of each with the one taken before; those that ``induces``
        push the suffix that precedes them, whose character is ``before``."""
        pushed = np.flatnonzero(induces)
        chars = before[pushed]
        order = np.argsort(chars, kind="stable")
        pushed, chars = pushed[order], chars[order]
        starts = np.flatnonzero(np.append(True, chars[1:] != chars[:-1])) if len(chars) else []
        ends = np.append(starts[1:], len(chars)) if len(chars) else []
        least = np.minimum(self.since, lcp.min())
        for a, b in zip(starts, ends, strict=True):
            rows, c = pushed[a:b], int(chars[a])
            between = np.empty(b - a, np.int32)
            between[0] = min(int(self.since[c]), int(lcp[: rows[0] + 1].min()))
            if b - a > 1:
                between[1:] = np.minimum.reduceat(lcp, rows[:-1] + 1)[: b - a - 1] if rows[-1] == len(lcp) - 1 else np.minimum.reduceat(lcp, np.append(rows[:-1] + 1, rows[-1] + 1))[:-1]
            rest = lcp[rows[-1] + 1 :]
            least[c] = rest.min() if len(rest) else DEPTH
            self.queues[c].push(at[rows] - 1, np.minimum(between + 1, DEPTH))
        self.since = least

    def rounds(self, c: int) -> Iterator[np.ndarray]:
        """Chunks of the FIFO of ``c``, and of what is pushed to it meanwhile."""
        while len(self.queues[c]):
            queue, self.queues[c] = self.queues[c], DiskQueue()
            yield from queue.chunks()


def _run_length(text: np.ndarray, at: int) -> int:
    """Equal characters from ``at``, up to ``DEPTH``."""
    piece = text[at : at + DEPTH]
    other = np.flatnonzero(piece != piece[0])
    return int(other[0]) if len(other) else len(piece)


def suffixes_descending(text: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of (suffix, common prefix with the next greater suffix), from the greatest suffix to the least.

    ``text`` has characters from 0 to ``size - 1``, at most 510. Common prefixes are exact below ``DEPTH``.
    """
    n = len(text)
    if not n:
        return
    s_type = suffix_types(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    lms, lms_lcp = sort_lms(text, lms)
    first = np.searchsorted(text[lms], np.arange(size + 1)) if len(lms) else np.zeros(size + 1, int)

    def preceding(at: np.ndarray) -> np.ndarray:
        return text[np.maximum(at - 1, 0)].astype(np.int64)

    # L-type suffixes, upwards; the empty suffix comes first and induces the last character's
    up, l_type = _Inducer(text, size), [DiskQueue() for _ in range(size)]
    up.queues[int(text[-1])].push(np.array([n - 1]), np.array([0]))
    up.since[:] = 0
    for c in range(size):
        last, fresh = None, True
        for items in up.rounds(c):
            at, lcp = items["at"], items["lcp"].copy()
            if fresh:
                lcp[0], fresh = 0, False
            last = int(at[-1])
            l_type[c].push(at, lcp)
            before = preceding(at)
            up.take(at, lcp, (at > 0) & (before >= c), before)
        at, lcp = lms[first[c] : first[c + 1]], lms_lcp[first[c] : first[c + 1]].copy()
        for k in range(0, len(at), CHUNK):
            part, common = at[k : k + CHUNK], lcp[k : k + CHUNK]
            if k == 0:
                common[0] = 0 if last is None else min(_run_length(text, last), _run_length(text, int(part[0])))
            up.take(part, common, np.ones(len(part), bool), preceding(part))

    # S-type suffixes, downwards; in a bucket they are greater than the L-type ones
    down = _Inducer(text, size)
    down.since[:] = 0
    for c in range(size - 1, -1, -1):
        least, fresh = None, True
        for items in down.rounds(c):
            at, lcp = items["at"], items["lcp"].copy()
            if fresh:
                lcp[0], fresh = 0, False
            least = int(at[-1])
            before = preceding(at)
            down.take(at, lcp, (at > 0) & (before <= c), before)
            yield at, lcp
        carried = None
        for items in l_type[c].chunks(reverse=True):
            at = items["at"]
            if carried is None:
                carried = 0 if least is None else min(_run_length(text, least), _run_length(text, int(at[0])))
            # a tuple has the common prefix with the lesser one; shift it to the greater
            lcp = np.append(np.int32(carried), items["lcp"][:-1]).astype(np.int32)
            carried = int(items["lcp"][-1])
            before = preceding(at)
            down.take(at, lcp, (at > 0) & (before < c), before)
            yield at, lcp
