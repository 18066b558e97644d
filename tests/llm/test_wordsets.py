import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import wordsets as N
from graphloom.plans import Scratch
from graphloom.sources import table


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def slow_kept(texts):
    """Least index of each component of all pairs at 0.8 or more."""
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        union = sets[i] | sets[j]
        if not union or len(sets[i] & sets[j]) >= 0.8 * len(union):
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return {i for i in range(len(texts)) if root(i) == i}


def variants(rng, words, n, edits):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return out


def corpus():
    rng = random.Random(4)
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for edits in (1, 2, 3, 30):
        for _ in range(8):
            words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(200, 400))]
            texts += [" ".join(words), *variants(rng, words, 3, edits)]
    rng.shuffle(texts)
    return texts


def test_stage_against_brute_force(make_docs):
    texts = corpus()
    docs = make_docs(texts)
    for limits in ({}, {"long_list": 1, "huge_list": 2, "effort": 0}):
        kept = N.drop_near_duplicates(docs, **limits)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == slow_kept(texts)


def test_a_chain_and_a_large_group(make_docs):
    """Copies that are near to the first only, in lists longer than the limit."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words), *variants(rng, words, 300, 6)]
    assert len(slow_kept(texts)) == 1
    assert [r.doc_id for r in N.drop_near_duplicates(make_docs(texts), long_list=16, huge_list=100).collect()] == [0]


def test_long_links_find_the_same_parts():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (30, N.BYTES), np.uint8)
    rows = np.concatenate([np.where(rng.random((6, N.BYTES)) < 0.1, rng.integers(0, 256, (6, N.BYTES), np.uint8), b) for b in base])
    parts = lambda links: {frozenset(np.flatnonzero(N_contract(len(rows), links) == k).tolist()) for k in range(len(rows))}
    links, rest = N.long_links(rows)
    assert parts(N.short_links(rows)) == parts(links) and not len(rest)
    assert len(links) == len(N.short_links(rows)) == 30 * 5
    links, rest = N.long_links(rows, 20)
    assert 0 < len(rest) < len(rows) and parts(links + [(int(rest[a]), int(rest[b])) for a, b in N.short_links(rows[rest])]) == parts(N.short_links(rows))


def N_contract(n, links):
    from graphloom.llm.simhash import contract

    a, b = (np.array([x[i] for x in links], np.int64) for i in (0, 1))
    return contract(n, a, b)


def test_ids_columns_and_empty_tables(make_docs):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = make_docs([a, b, b, a + " z", a + " z"], ids=[None, None, 3, 1, 1]).withColumns({c: F.lit(1) for c in ("node", "row", "id", "signature", "key", "first")})
    kept = N.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a + " z"), (3, b)]
    assert N.drop_near_duplicates(docs.limit(0)).count() == 0
    null_ids = make_docs([a, b, a], ids=[None, None, None])
    assert sorted(r.text for r in N.drop_near_duplicates(null_ids).collect()) == [a, b]


def test_long_text(make_docs):
    long = " ".join(f"w{i}" for i in range(300_000))
    kept = N.drop_near_duplicates(make_docs([long + " end", long, "other words " * 100]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_documents_of_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    want = {ids[k] for k in slow_kept([texts[i] for i in ids])}
    kept = {r.doc_id for r in N.drop_near_duplicates(docs).collect()}
    assert len(kept ^ want) <= 1


def test_a_failed_link_hides_no_weaker_one(make_docs, monkeypatch):
    """The strongest pairs of each group fail the check, and those that pass it were left out of the forest."""
    texts = [f"{c}{i} " * 9 for c in "ab" for i in range(4)]
    base = np.random.default_rng(3).integers(0, 256, (2, N.BYTES), np.uint8)
    rows = np.repeat(base, 4, 0)
    for k in range(8):
        rows[k, N.BYTES - 1 - 4 * (k % 4) :] ^= np.uint8(255)
    made = {t: r.tobytes() for t, r in zip(texts, rows, strict=True)}
    near = lambda x, y: abs(x - y) >= 2
    signatures = {N.shingle_hashes(t).tobytes(): made[t] for t in texts}
    places = {N.shingle_hashes(t).tobytes(): k for k, t in enumerate(texts)}
    monkeypatch.setattr(N, "signature", lambda h: signatures[h.tobytes()])
    monkeypatch.setattr(N, "similarity", lambda x, y: float(near(places[x.tobytes()], places[y.tobytes()])))
    # of a group 0-1-2-3 the pairs 0-2, 0-3 and 1-3 pass: one component
    for limits in ({}, {"long_list": 1, "huge_list": 3}):
        assert sorted(r.doc_id for r in N.drop_near_duplicates(make_docs(texts), **limits).collect()) == [0, 4]


def test_pairs_behind_failed_links_leave_as_a_forest():
    """All pairs of 300 texts share enough bytes; what is checked and found grows with the texts, not with their pairs."""
    rows, asked = np.zeros((300, N.BYTES), np.uint8), []
    same = lambda i, j: asked.append((i, j)) or (i + j) % 3 > 0 and 299 not in (i, j)
    links = N.links_between(rows, np.arange(300), same)
    assert len(links) == 298 and len(np.unique(N_contract(300, links))) == 2
    assert len(asked) == len({frozenset(p) for p in asked}) < 3 * 300
    # of a part that holds together nothing is asked
    assert N.links_between(rows, np.zeros(300), same) == [] and len(asked) < 3 * 300


def test_a_group_of_near_copies_without_their_original(make_docs):
    """Copies at about the limit: some links of the forest fail, and what is checked anew isn't all pairs."""
    rng = random.Random(6)
    texts = variants(rng, [f"w{i}" for i in range(600)], 80, 7)
    found, links_left_out = [], N.links_left_out
    try:
        N.links_left_out = lambda *a, **k: found.append(links_left_out(*a, **k)) or found[0]
        kept = {r.doc_id for r in N.drop_near_duplicates(make_docs(texts)).collect()}
    finally:
        N.links_left_out = links_left_out
    assert kept == slow_kept(texts) and len(kept) < 80
    assert found and found[0].count() < len(texts)


def test_blocks_that_are_equal_by_chance_are_told_apart():
    """Of sets without a common shingle the same three bytes are no list; of copies every block is one."""
    rng = np.random.default_rng(8)
    sets = rng.integers(0, 1 << 63, (3000, 40), np.uint64)
    rows = np.frombuffer(b"".join(map(N.signature, sets)), np.uint8).reshape(len(sets), -1)
    common = lambda r: N.block_keys(r)[0].size - len(np.unique(N.block_keys(r)[0]))
    assert common(rows[:, : N.BYTES]) > 5 and common(rows) <= 1
    assert (N.block_keys(rows[[0, 0]])[0][0] == N.block_keys(rows[[0, 0]])[0][1]).all()


def test_among_moves_no_row(spark):
    df = spark.range(50_000).selectExpr("CAST(id AS STRING) AS k", "id AS _x")
    asked = df.filter("_x % 10 = 3").select("k")
    some, rest = N.among(df, "k", asked, Scratch(spark, "among"), "marks")
    assert some.columns == rest.columns == df.columns and some.count() + rest.count() == 50_000
    assert some.filter("_x % 10 = 3").count() == 5_000 and some.count() < 5_200
    assert "Exchange hash" not in some._jdf.queryExecution().executedPlan().toString()
    none, all_ = N.among(df, "k", asked.limit(0), Scratch(spark, "among"), "none")
    assert none.count() == 0 and all_.count() == 50_000
