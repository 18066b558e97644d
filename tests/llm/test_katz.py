import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import katz
from graphloom.sources import table

SF = "/root/testdata/sf0.01"
SMALL = katz.Limits(block=40, bucket=30, context=3, text=16)


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


class Plain:
    """The model with dictionaries and recursion."""

    def __init__(self, texts, order):
        self.counts = [defaultdict(Counter) for _ in range(order)]
        for t in texts:
            seq = [False] * (order - 1) + tokens(t)
            for i in range(order - 1, len(seq)):
                for n in range(order):
                    self.counts[n][tuple(seq[i - n : i])][seq[i]] += 1
        self.n_types = len(self.counts[0][()])
        self.n = sum(self.counts[0][()].values())
        self.factor = []
        for level in self.counts:
            of = Counter(c for words in level.values() for c in words.values())
            rest = 6 * of[6] / of[1] if of[1] else 1
            good = {}
            for r in range(1, 6):
                d = ((r + 1) * of[r + 1] / (r * of[r]) - rest) / (1 - rest) if of[r] and rest < 1 else 0
                good[r] = d if 0 < d < 1 else r / (r + 1)
            self.factor.append(good)
        self.known = {}

    def prob(self, context, word):
        key = context, word
        if key not in self.known:
            self.known[key] = self._prob(context, word)
        return self.known[key]

    def weight(self, context):
        """Divisor and alpha of a context."""
        if ("weight", context) not in self.known:
            level, words = len(context), self.counts[len(context)].get(context)
            if not words:
                self.known["weight", context] = 0, 1.0
            else:
                total = sum(words.values()) + all(c > 5 for c in words.values())
                kept = sum(self.factor[level].get(c, 1) * c for c in words.values()) / total
                below = math.fsum(self.below(context, w) for w in words)
                rest = 1 / (self.n_types + 1) if not context else 1 - below
                self.known["weight", context] = total, (1 - kept) / rest
        return self.known["weight", context]

    def below(self, context, word):
        return self.prob(context[1:], word) if context else 1 / (self.n_types + 1)

    def _prob(self, context, word):
        total, alpha = self.weight(context)
        c = self.counts[len(context)].get(context, {}).get(word, 0)
        return self.factor[len(context)].get(c, 1) * c / total if c else alpha * self.below(context, word)


def slow(docs, train, order):
    model = Plain([t for i, t in docs if train(i)], order)
    rows = []
    for i, t in docs:
        seq = [False] * (order - 1) + tokens(t)
        own = seq[order - 1 :]
        counts = [model.counts[0][()][w] for w in own]
        base = sum(math.log10((c + 1) / (model.n + model.n_types + 1)) for c in counts)
        best = sum(math.log10(model.prob(tuple(seq[k : k + order - 1]), w)) for k, w in enumerate(own))
        rows.append((i, len(own), sum(c > 0 for c in counts), model.n, base, best))
    return rows, model


def check(docs, order, limits=katz.Limits(), of=lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 != 2):
    found = katz.token_scores(docs, ~katz.held_out(F.col("doc_id")), order, limits).collect()
    want, model = slow([tuple(r) for r in docs.select("doc_id", "text").collect()], of, order)
    key = lambda r: (str(r[0]), r[1], round(r[4], 6), round(r[5], 6))
    found, want = sorted(map(tuple, found), key=key), sorted(want, key=key)
    assert [r[:4] for r in found] == [r[:4] for r in want]
    np.testing.assert_allclose([r[4:] for r in found], [r[4:] for r in want], rtol=1e-9)
    return model


def texts_of(rng, n):
    words = [*"abcdefgh", "The", "the", "é", "É", "𝒳", "x\x00y", "x y"]
    return [" ".join(rng.choice(words[: rng.randrange(2, len(words))]) for _ in range(rng.randrange(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_recursion(make_docs, order):
    rng = random.Random(order)
    texts = [None, "", " \n\t", "a", "zzz zzz", *texts_of(rng, 120), " ".join(rng.choice("ab") for _ in range(400))]
    docs = make_docs(texts).withColumns({"row": F.lit(1), "train": F.lit("t"), "block": F.lit(2), "score": F.lit(3)})
    model = check(docs, order)
    check(docs, order, SMALL)
    # the probabilities of every context sum to 1, with one for all unknown words
    words = [*model.counts[0][()], b"unknown"]
    contexts = [c for level in model.counts for c in level] + [(b"zzz",) * (order - 1)]
    for c in contexts[:300]:
        assert math.isclose(math.fsum(model.prob(c, w) for w in words), 1, rel_tol=1e-9)


def test_long_text_in_many_blocks(make_docs):
    rng = random.Random(1)
    check(make_docs([" ".join(rng.choice(["ab", "b", "ccc"]) for _ in range(3000)), "b ab", None]), 3, katz.Limits(block=100, bucket=200, context=50, text=64))


def test_empty_and_untrained(make_docs):
    docs = make_docs(["a b", None])
    assert katz.score_digest(docs.limit(0)).collect() == []
    rows = katz.token_scores(docs, F.lit(False)).collect()
    assert sorted(tuple(r)[1:] for r in rows) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c")] * 3 + [(7, "a b d"), (7, "a b d"), (8, None)], "doc_id long, text string")
    check(docs, 2, SMALL)


def test_packed_arrays():
    rng = np.random.default_rng(0)
    arrays = [np.zeros(0, np.int64), rng.integers(0, 255, 9).astype(np.uint8), np.sort(rng.integers(-(2**62), 2**62, 50)), rng.random(7), np.array([5], np.uint32), np.array([0, 2**64 - 1], np.uint64)]
    for a, b in zip(arrays, katz.unpack(katz.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def test_all_documents(spark):
    docs = table(spark, SF, "documents")
    check(docs, katz.ORDER)
    rows = katz.score_digest(docs).collect()
    assert {r.held_out for r in rows} == {zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows} == {True, False}
    unseen = [r for r in rows if r.held_out]
    # on documents that it hasn't seen, the model beats single words
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
