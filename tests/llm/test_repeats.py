import hashlib
import random

from pyspark.sql import functions as F

from graphloom.llm import registry
from graphloom.llm import repeats as R

from ..oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


def brute(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            if i is not None and least.get(w, i) >= i:
                least[w] = i
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and least[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.setdefault(i, []).append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


def check(docs, **options):
    found = {}
    for r in R.remove_repeats(docs, **options).collect():
        found.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    assert {i: sorted(v) for i, v in found.items()} == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def random_texts(seed, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("ab cdé\n") for _ in range(rng.randint(45, 160))) for _ in range(6)] + ["a" * 90, "xy" * 40]
    noise = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 80)))
    cut = lambda p: p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)]
    return ["".join(noise() + cut(rng.choice(passages)) for _ in range(rng.randint(0, 4))) for _ in range(n)]


def test_against_brute_force(spark, make_docs):
    texts = random_texts(1)
    docs = make_docs([*texts, None, "", "z" * 49, "z" * 50, "z" * 50, texts[0], texts[0]], ids=random.Random(2).sample(range(1000), len(texts) + 7))
    check(docs.repartition(3))
    check(docs, hot_segments=1)


def test_pieces_of_long_texts(spark, make_docs, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdef ") for _ in range(5000))
    texts = [long, long[1000:3000], "q" + long, long[:60] + "r" + long[60:]]
    data = [t.encode() for t in texts]
    monkeypatch.setattr(R, "PIECE_BYTES", 700)
    kind, _, _, doc, span = R.post(list(range(4)), [0] * 4, data)
    assert len(span) and set(doc.tolist()) == {0, 1, 2, 3}
    monkeypatch.undo()
    check(make_docs(texts))


def test_ids_nulls_extra_columns_and_empty_table(spark, make_docs):
    t = "The same passage of text is here, and it is longer than fifty bytes."
    docs = make_docs([t, t, t, "x" + t, t + "y"], ids=[4, 4, None, 4, 2]).withColumns({"tag": F.lit(1), "start": F.lit(2), "data": F.lit("d"), "kind": F.lit(0)})
    check(docs)
    assert R.remove_repeats(docs.limit(0)).count() == 0


def test_against_oracle(spark):
    assert_same(registry.op7_suffix_dedup(spark, SF), registry.ORACLE_SQL["op7_suffix_dedup"], connect(SF))
