import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from graphloom.llm import resampling
from graphloom.sources import table

from ..oracle import assert_same, connect

SF = "/root/testdata/sf0.01"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n=1):
    words = _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(g.encode()) % 10000 for g in grams]


def slow(docs, targets, n=1):
    """The whole draw in plain Python: sorted rows ``doc_id, n_features, weight, score, rank``."""
    found = [(i, *features(t, n)) for i, t in docs]
    raw, want = Counter(b for _, _, f in found for b in f), Counter(b for t in targets for b in features(t, n)[1])
    s_all, t_all = sum(raw.values()), sum(want.values())
    gain = {b: math.floor(1000 * math.log((want[b] + 1) * (s_all + 10000) / ((raw[b] + 1) * (t_all + 10000)))) for b in raw}
    rows = []
    for i, words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    some = sorted((-r[4], r[0] is not None, r[0] or 0, k) for k, r in enumerate(rows) if r[1] >= 20)
    rank = {x[3]: at + 1 for at, x in enumerate(some[: len(some) * 10 // 100])}
    return sorted(((i, n_, w, s, rank.get(k)) for k, (i, _, n_, w, s) in enumerate(rows)), key=str)


def check(docs, benchmark, n=1, **how):
    rows = resampling.resample(docs, benchmark, "item_id", max_gram=n, **how).select("doc_id", "n_features", "weight", "score", "rank").collect()
    want = slow([tuple(r) for r in docs.select("doc_id", "text").collect()], [r.text for r in benchmark.collect()], n)
    assert sorted(map(tuple, rows), key=str) == want
    return rows


def texts_of(rng, size):
    bits = ["Alpha", "beta", "GAMMA7", "é1", "çÀ", "𝒳x", "under_score", "it's", "x\x00y", "\x7f", "\n", "1-2"]
    return [" ".join(rng.choice(bits) for _ in range(rng.randrange(0, 60))) for _ in range(size)]


def test_odd_texts(spark, make_docs):
    rng = random.Random(2)
    texts = [None, "", " \n", "ÀÉ É" * 10, "word " * 200_000, *texts_of(rng, 200)]
    docs = make_docs(texts).withColumns({"id": F.lit(1), "place": F.lit(2), "counts": F.lit("c"), "rank": F.lit(3)})
    target = spark.createDataFrame([(1, "alpha alpha beta 𝒳x"), (2, None), (3, "")], "item_id long, text string")
    assert sum(r.rank is not None for r in check(docs, target)) == sum(features(t)[0] >= 20 for t in texts) // 10
    # chunks of a few texts give the same
    check(docs, target, chunk_chars=500)
    for n in (2, 3):
        check(docs, target, n)
    check(docs, target.limit(0))
    assert resampling.resample_digest(docs.limit(0), target).collect() == []


def test_repeated_rows_and_null_ids(spark):
    """Ties by score and id: the drawn are as many and the ranks have no gap."""
    rows = [(None, "some words here " * 10)] * 3 + [(k // 2, f"words {k // 2} of text " * 9) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(1, "words of text")], "item_id long, text string")
    found = resampling.resample_digest(docs, target).collect()
    assert len(found) == len(rows) and sorted(r.rank for r in found if r.rank) == list(range(1, len(rows) // 10 + 1))
    drawn = [(r.score, r.doc_id) for r in sorted((r for r in found if r.rank), key=lambda r: r.rank)]
    best = sorted(((r.score, r.doc_id) for r in found), key=lambda x: (-x[0], x[1] is not None, x[1] or 0))
    assert drawn == best[: len(drawn)]


def test_all_documents(spark):
    docs, benchmark = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    check(docs, benchmark)
    assert_same(resampling.resample_digest(docs, benchmark), resampling.ORACLE_RESAMPLE, connect(SF))
