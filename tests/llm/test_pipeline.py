import zlib
from collections import defaultdict
from hashlib import md5

import corpus_pipeline
from graphloom.llm import packing
from graphloom.llm.mixing import MAX_EPOCHS
from graphloom.sources import table

from . import test_pii
from .test_mixing import targets_by_rounds
from .test_quality_rules import slow_verdicts
from .test_wordsets import slow_kept

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


def words(text):
    for c in SPACE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def head(text, n):
    """Up to the end of word ``n``."""
    seen, inside = 0, False
    for i, c in enumerate(text):
        if c in SPACE:
            if inside and seen == n:
                return text[:i]
            inside = False
        elif not inside:
            inside, seen = True, seen + 1
    return text


def slow_mix(rows):
    """(doc_id, text) of the mix of (doc_id, text, source)."""
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    targets = targets_by_rounds(dict(sizes))
    out = []
    for source, size in sizes.items():
        budget = min(int(targets[source]), MAX_EPOCHS * size)
        mine = sorted((md5(f"mix-1:{i}:{md5(t.encode()).hexdigest()}".encode()).hexdigest(), i, t) for i, t, s in rows if s == source)
        epochs, left = divmod(budget, max(size, 1))
        out += [(i, t) for _, i, t in mine] * epochs
        for _, i, t in mine:
            n = min(left, len(words(t)))
            left -= n
            if n:
                out.append((i, t if n == len(words(t)) else head(t, n)))
    return out


def slow_pieces(rows):
    """(doc_id, piece, start, length, crc) of (doc_id, text)."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for (i, _), e in zip(rows, t.encode_batch([x for _, x in rows], add_special_tokens=False), strict=True):
        ids = [*e.ids, 2]
        for k, (start, n) in enumerate(packing.cut(len(ids))):
            out.append((i, k, start, n, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[start : start + n]))))
    return sorted(out)


def test_run_against_brute_force(spark):
    """Every stage in plain Python, from the documents to the pieces."""
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in table(spark, SF, "documents").collect()]
    good = {i for i, (_, kept) in slow_verdicts(docs).items() if kept}
    docs = sorted((r for r in docs if r[0] in good), key=lambda r: r[0])
    stay = slow_kept([r[1] for r in docs])
    test_pii.KEY, before = corpus_pipeline.PUBLIC_KEY, test_pii.KEY
    try:
        rows = [(i, test_pii.slow_pii(t), s) for k, (i, t, _, s) in enumerate(docs) if k in stay]
    finally:
        test_pii.KEY = before
    want = slow_pieces(slow_mix(rows))
    found = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for pieces in places.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(places) <= 1.02 * -(-sum(r.length for r in found) // 1024) + 1


def test_stages_keep_all_columns_and_treat_empty_tables_nulls_and_copies(spark, make_docs):
    from pyspark.sql import functions as F

    long = " ".join(f"word{i}" for i in range(80))
    texts = [None, "", long, long, long.replace("word7 ", "thing "), " ".join(f"other{i}" for i in range(80))]
    docs = make_docs(texts, sources=("a", None), ids=[1, 2, 3, 3, 5, None]).withColumns({c: F.lit(1) for c in ("row", "id", "size", "key", "vector", "kept", "node", "found", "_group")})
    for start in (docs, docs.limit(0)):
        now, names = start, [n for n, _ in corpus_pipeline.STAGES]
        scratch = packing.Scratch(spark, "stages")
        for name, stage in corpus_pipeline.STAGES:
            now = scratch.save(stage(spark, now, SF), name)
            if name != "packing":
                assert now.columns == docs.columns, name
            if name == "near_dedup":
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in now.collect()) == ([(False, 3), (True, 0)] if start is docs else [])
        assert names == ["quality_rules", "near_dedup", "pii", "mixing", "packing"]
        assert (now.count() > 0) == (start is docs)
