import random
import time

import numpy as np
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import simhash as S


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words)] if 0 < len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in (None, "", "  \n", "One", "A b", "a B c", "x y z w x y z É q", "the " * 300):
        assert S.fingerprint(t) == slow_fingerprint(t)


def brute_components(fps):
    label = list(range(len(fps)))
    find = lambda i: i if label[i] == i else find(label[i])
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [find(i) for i in range(len(fps))]


def test_links_of_all_distances(spark):
    rng = random.Random(3)
    fps = [0]
    for _ in range(40):
        at = rng.getrandbits(64)
        for _ in range(12):
            fps.append(at)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                at ^= 1 << b
    want = brute_components(fps)
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    found = {r.doc_id: r.component_id for r in rows.join(S.component_ids(rows), "fp").collect()}
    assert [found[i] for i in range(len(fps))] == want
    # long lists are split without losing links
    for long_list in (1, 3):
        scratch = S.Scratch(spark, "t")
        links = S.components(S.near_links(rows.select("fp").distinct(), scratch, long_list), scratch).collect()
        root = {r.u: r.v for r in links}
        keys = [root.get(f - (1 << 64) if f >> 63 else f, f - (1 << 64) if f >> 63 else f) for f in fps]
        assert len({(k, w) for k, w in zip(keys, want, strict=True)}) == len(set(want)) == len(set(keys))


def test_contract():
    assert S.contract(6, np.array([5, 3, 1]), np.array([3, 1, 4])).tolist() == [0, 1, 2, 1, 1, 1]


def test_stage_keeps_one_of_each_group(spark, make_docs):
    base = "one two three four five six seven eight nine ten " * 30
    docs = make_docs([base, base, base.upper(), "other words entirely here", None, ""], ids=[5, 2, 9, 7, 8, 3]).withColumns({"fp": F.lit(1), "id": F.lit("x"), "component_id": F.lit(0)})
    out = S.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 3, 7]
    twice = make_docs([base, base], ids=[1, 1])
    assert S.drop_near_duplicates(twice).count() == 1
    assert S.drop_near_duplicates(docs.limit(0)).count() == 0
    digest = {r.doc_id: r for r in S.simhash_digest(docs).collect()}
    assert digest[8].fingerprint == "0" * 16 and digest[8].component_id == 3


def test_stage_keeps_components_of_null_and_repeated_ids(spark, make_docs):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.getrandbits(30)}" for _ in range(60))
    different = [text() for _ in range(30)]
    out = S.drop_near_duplicates(make_docs(different + different[:3], ids=[None] * 33))
    assert sorted(r.text for r in out.collect()) == sorted(different)
    a, b = different[:2]
    out = S.drop_near_duplicates(make_docs([a, b, b, b], ids=[1, 1, 7, None]))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(1, a), (1, b)])


def test_many_fingerprints_that_differ_in_three_bytes():
    """Looked up in a table as by pairs; a million take seconds, where pairs would take hours."""
    rng = np.random.default_rng(2)
    base = np.uint64(0x0123456789ABCDEF)
    make = lambda n: np.unique(base ^ (rng.integers(0, 1 << 24, n).astype(np.uint64) << np.uint64(16)))
    parts = lambda fps, links: S.contract(len(fps), *(np.searchsorted(fps, x) for x in links))
    fps = make(3000)
    assert np.array_equal(parts(fps, S.table_links(fps)), parts(fps, S._pair_links(np.zeros(len(fps)), fps)))
    many = make(400_000)
    keys = np.zeros(len(many))
    began = time.monotonic()
    u, v = S.list_links(keys, many)
    assert time.monotonic() - began < 120 and len(u) > 100_000 and len(u) == len(v)
    assert S.table_links(np.array([1, 1 << 20, 1 << 30, 1 << 40], np.uint64)) is None


def test_text_of_more_shingles_than_a_piece():
    words = [f"w{i % 70_001}" for i in range(150_000)]
    bits = np.zeros(64, int)
    for i in range(len(words) - 2):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42)
        bits += [h >> k & 1 for k in range(64)]
    assert S.fingerprint(" ".join(words)) == sum(1 << k for k in range(64) if 2 * bits[k] > len(words) - 2)
