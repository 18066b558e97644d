import random
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import packing


def test_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Hello  world\n\n x", "a b", " lead", "trail ", "don't won't I'll", "ééçñ ß  x\t\ty", "日本語 テキスト", "1234 56.7 #!?", "\U0001f600 emoji", "", "it's\n\nnew\r\n"]
    encode = packing.encoder()
    assert [encode(x) for x in texts] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)]
    assert packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]


def test_best_fit_closes_the_fullest_and_never_overfills():
    rng = random.Random(1)
    for bins in (1, 3, 50):
        fit, used = packing.BestFit(100, bins), {}
        for _ in range(3000):
            n = rng.randint(1, 100)
            b, at = fit.place(n)
            assert used.get(b, 0) == at and at + n <= 100 and fit.open <= bins
            used[b] = at + n
    fit = packing.BestFit(100, 2)
    assert [fit.place(n) for n in (60, 90, 70, 25)] == [(0, 0), (1, 0), (2, 0), (2, 70)]  # 70 needs a bin: that of 90 closes


def test_documents(spark, make_docs):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.choice((3, 50, 400, 3000)))) for _ in range(120)] + [None, "", "x" * 20000]
    rows = packing.pack_documents(make_docs(texts)).collect()
    encode = packing.encoder()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = encode(t or "") + [2]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(p.start, p.length) for p in pieces] == packing.cut(len(ids))
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[p.start : p.start + p.length]))
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    least = -(-sum(r.length for r in rows) // 1024)
    assert len(by_sequence) <= 1.02 * least + 1


def test_repeated_rows_nulls_and_empty_table(spark, make_docs):
    docs = make_docs(["a", "a", None], ids=[1, 1, None]).withColumns({"piece": F.lit(1), "length": F.lit("x")})
    assert packing.pack_documents(docs).count() == 3
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("groups", [1, 5])
def test_groups(spark, make_docs, groups):
    pieces = packing.Scratch(spark, "t").save(packing.tokenize_pieces(make_docs([f"t {i} " * 90 for i in range(200)])), "p")
    n = pieces.filter("length < 1024").count()
    rows = packing.pack_pieces(pieces, per_group=-(-n // groups), partitions=2).collect()
    assert len(rows) == pieces.count() and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_fill_of_full_groups(spark):
    # four in ten pieces above half a sequence, as in documents
    n = F.when(F.rand(1) < 0.41, 513 + F.floor(F.rand(2) * 511)).otherwise(1 + F.floor(F.rand(3) * 512)).cast("long")
    pieces = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), n.alias("length"), F.col("id").alias("ids_crc32"))
    pieces = packing.Scratch(spark, "t").save(pieces, "fill")
    least = -(-pieces.agg({"length": "sum"}).first()[0] // 1024)
    assert packing.pack_pieces(pieces).select("sequence_id").distinct().count() <= 1.02 * least


def test_added_tokens_have_their_ids(spark, make_docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n\n", "<|endoftext|", "a <|<|endoftext|>|>", "é\n <|endoftext|>日本"]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert 50256 in want[0] and [packing.document_encoder()(x) for x in texts] == want
    crc = {r.doc_id: (r.length, r.ids_crc32) for r in packing.pack_documents(make_docs(texts)).collect()}
    assert crc == {i: (len(ids) + 1, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*ids, 2]))) for i, ids in enumerate(want)}


def test_best_fit_against_brute_force():
    """A list of all open bins searched for each piece."""
    rng = random.Random(7)
    for bins in (2, 7, 100):
        fit, free, nxt = packing.BestFit(64, bins), [], 0
        for _ in range(2000):
            n = rng.randint(1, 64)
            fits = [b for b in free if b[0] >= n]
            if fits:
                space = min(b[0] for b in fits)
                b = [x for x in free if x[0] == space][-1]
                free.remove(b)
            else:
                if len(free) == bins:
                    least = min(x[0] for x in free)
                    free.remove([x for x in free if x[0] == least][-1])
                b, nxt = (64, nxt), nxt + 1
            assert fit.place(n) == (b[1], 64 - b[0])
            if b[0] > n:
                free.append((b[0] - n, b[1]))
