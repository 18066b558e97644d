"""Fill-in-the-middle transformation.

A text is cut into prefix, middle and suffix at the ends of units, and the parts
are written in another order behind sentinels. Units are runs of one character
class, of at most so many code points as the class allows. One Aho-Corasick
automaton finds the ASCII characters that change the class and the sentinels.
These events are sparse: what lies between two of them is a run of the rest
class, whose number of units follows from its length. The runs with their running
numbers of units are all that the lookup of a unit's end needs.

A text that contains a sentinel stays plain, so an output splits at its sentinels
in one way: they start with ``<``, end with ``>`` and hold neither inside.

A null text is an empty one, and an empty one stays plain. A null id draws as an
empty one. Repeated rows get equal cuts; texts of any length are treated whole,
with memory for their runs. An empty table gives an empty one. Extra columns
aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20


@dataclass(frozen=True)
class Classes:
    """Character classes with the most code points of a unit; every other character is of the rest class."""

    listed: tuple[tuple[str, int], ...] = ((" \t\n\v\f\r", 1),)
    rest: int = 1


class Scanner:
    """Finds sentinels and runs of classes in one pass."""

    def __init__(self, classes: Classes = Classes(), sentinels: tuple[str, ...] = SENTINELS):
        for s in sentinels:
            if not (s.isascii() and len(s) > 2 and s[0] == "<" and s[-1] == ">" and not set(s[1:-1]) & set("<>")):
                raise ValueError(f"not a sentinel: {s!r}")
        if len(set(sentinels)) != 3:
            raise ValueError("three different sentinels are needed")
        chars = "".join(c for c, _ in classes.listed)
        if not chars.isascii() or len(set(chars)) != len(chars) or set(chars) & set("<>"):
            raise ValueError("classes are disjoint sets of ASCII characters other than < and >")
        self.sentinels = sentinels
        self.sizes = [n for _, n in classes.listed] + [classes.rest]
        self.rest = len(classes.listed)
        self.machine = ahocorasick.Automaton()
        for k, s in enumerate(sentinels):
            self.machine.add_word(s, (-1, k))
        for k, (some, _) in enumerate(classes.listed):
            for c in some:
                self.machine.add_word(c, (k, 0))
        self.machine.make_automaton()

    def runs(self, text: str) -> tuple[list[int], list[int], list[int]] | None:
        """Starts of the runs, units before them and their classes, with an end entry; None if there is a sentinel."""
        starts, before, kinds = [], [], []
        units = stop = 0
        sizes, rest = self.sizes, self.rest
        kind = -1  # class of the open run
        opened = 0

        for at, (k, _) in self.machine.iter(text):
            if k < 0:
                return None
            if at > stop:  # a gap of the rest class
                if kind >= 0:
                    units += -((opened - stop) // sizes[kind])
                starts.append(stop)
                before.append(units)
                kinds.append(rest)
                units += -((stop - at) // sizes[rest])
                kind = -1
            if k != kind:
                if kind >= 0:
                    units += -((opened - stop) // sizes[kind])
                kind, opened = k, at
                starts.append(at)
                before.append(units)
                kinds.append(k)
            stop = at + 1
        if kind >= 0:
            units += -((opened - stop) // sizes[kind])
        if stop < len(text):
            starts.append(stop)
            before.append(units)
            kinds.append(rest)
            units += -((stop - len(text)) // sizes[rest])
        return [*starts, len(text)], [*before, units], [*kinds, rest]

    def end_of(self, runs: tuple[list[int], list[int], list[int]], k: int) -> int:
        """Where the first ``k`` units end."""
        starts, before, kinds = runs
        i = bisect_right(before, k) - 1
        return starts[i] if i + 1 == len(starts) else min(starts[i] + (k - before[i]) * self.sizes[kinds[i]], starts[i + 1])

    def places(self, output: str) -> list[int]:
        """Ends of the sentinels of an output, in its order."""
        return [at + 1 for at, (k, _) in self.machine.iter(output) if k < 0]


def draws(doc_id: object, seed: int = SEED) -> list[int]:
    """The four hash draws of a document."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(scanner: Scanner, text: str, h: list[int]) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, lengths of prefix and middle in code points (None if plain), and the output."""
    runs = scanner.runs(text)
    if runs is None:
        # a sentinel is text like any other here
        runs = Scanner.runs(_blind(scanner), text)
        return runs[1][-1], "plain", None, None, text
    n = runs[1][-1]
    if not text or h[2] % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    i, j = scanner.end_of(runs, a), scanner.end_of(runs, b)
    prefix, suffix, middle = scanner.sentinels
    if h[3] % 100 < SPM_BELOW:
        return n, "spm", i, j - i, "".join((suffix, text[j:], prefix, text[:i], middle, text[i:j]))
    return n, "psm", i, j - i, "".join((prefix, text[:i], suffix, text[j:], middle, text[i:j]))


def _blind(scanner: Scanner) -> Scanner:
    """The same scanner without sentinels, for the units of texts that hold some."""
    if not hasattr(scanner, "blind"):
        other = object.__new__(Scanner)
        other.sizes, other.rest, other.sentinels = scanner.sizes, scanner.rest, scanner.sentinels
        other.machine = ahocorasick.Automaton()
        for key, value in scanner.machine.items():
            if value[0] >= 0:
                other.machine.add_word(key, value)
        other.machine.make_automaton()
        scanner.blind = other
    return scanner.blind


def restore(scanner: Scanner, output: str, form: str) -> str:
    """The text of an output."""
    if form == "plain":
        return output
    a, b, c = scanner.places(output)
    p, s, m = scanner.sentinels
    if form == "spm":
        suffix, prefix = output[a : b - len(p)], output[b : c - len(m)]
    else:
        prefix, suffix = output[a : b - len(s)], output[b : c - len(m)]
    return "".join((prefix, output[c:], suffix))


_OUT = "doc_id {id}, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, seed: int = SEED, classes: Classes = Classes(), sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every document; ``n`` counts units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, sentinels)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [transform(scanner, t or "", draws(i, seed)) for i, t in zip(ids, batch.column("text").to_pylist(), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else [()] * 5
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select("doc_id", "text").mapInArrow(run, _OUT.format(id=docs.schema["doc_id"].dataType.simpleString()))


def restore_text(outputs: DataFrame, classes: Classes = Classes(), sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """``fill_in_middle``'s rows with ``restored``, the text rebuilt from ``output`` and ``form``."""
    schema = T.StructType([*outputs.schema, T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, sentinels)
        for batch in batches:
            texts = [restore(scanner, o, f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "restored"])

    return outputs.mapInArrow(run, schema)


def infill_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of every document, in units of a code point."""
    rows = restore_text(fill_in_middle(docs))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))


ORACLE_INFILL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
