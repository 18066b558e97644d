import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import infill
from graphloom.sources import table

from ..oracle import assert_same, connect

SF = "/root/testdata/sf0.01"


def plain_version(doc_id, text):
    """The contract in code points, by slices."""
    text, h = text or "", hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, sha(f"<S>{s}<P>{p}<M>{m}"), sha(text)
    return n, "psm", a, b - a, sha(f"<P>{p}<S>{s}<M>{m}"), sha(text)


def check(docs):
    rows = infill.infill_digest(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    assert sorted((r.doc_id, *r[1:]) for r in rows if r.prefix_chars is not None) == sorted((t.doc_id, *v) for t in texts if (v := plain_version(*t))[2] is not None)
    assert {(r.doc_id, *r[1:]) for r in rows} == {(t.doc_id, *plain_version(*t)) for t in texts}
    assert len(rows) == len(texts)
    return {r.form for r in rows}


def test_odd_texts(make_docs):
    rng = random.Random(3)
    bits = ["<", ">", "<P", "P>", "S>", "<<S", " ", "\n\t", "é", "𝒳", "\x00", "word", "12", "<M"]
    texts = [None, "", " ", "\n" * 50, "a <P> b", "<S>", "x<M>", "<p>", "𝒳" * 1000, "word " * 200_000, *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(400))]
    docs = make_docs(texts).withColumns({"form": F.lit(1), "n": F.lit(2), "output": F.lit("o"), "restored": F.lit("r")})
    assert check(docs) == {"plain", "psm", "spm"}
    assert infill.infill_digest(docs.limit(0)).collect() == []
    check(docs.unionAll(docs))


def test_null_ids(spark):
    rows = infill.infill_digest(spark.createDataFrame([(None, "some text"), (None, "some text")], "doc_id long, text string")).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].restored_sha256 == hashlib.sha256(b"some text").hexdigest()


def test_units_of_classes():
    """Ends of all units against a regular expression, for classes of several sizes."""
    scanner = infill.Scanner(infill.Classes((("0123456789", 3), (" \n", 2), (".,;", 1)), rest=4))
    unit = re.compile(r"[0-9]{1,3}|[ \n]{1,2}|[.,;]|[^0-9 \n.,;]{1,4}")
    rng = random.Random(9)
    for _ in range(500):
        text = "".join(rng.choice(["1", "23", "4567", " ", "\n", "  ", ".", ",,", "ab", "cdé", "𝒳", "xyzuvw"]) for _ in range(rng.randrange(0, 25)))
        runs, ends = scanner.runs(text), [0, *(m.end() for m in unit.finditer(text))]
        assert runs[1][-1] == len(ends) - 1
        assert [scanner.end_of(runs, k) for k in range(len(ends))] == ends
        n, form, prefix, middle, output = infill.transform(scanner, text, [rng.randrange(2**32) for _ in range(4)])
        assert n == len(ends) - 1 and infill.restore(scanner, output, form) == text
        assert form == "plain" or {prefix, prefix + middle} <= set(ends)
        assert infill.transform(scanner, f"{text}<S>", [0] * 4)[1] == "plain"


def test_sentinels_are_checked():
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<S>", "<M<>"), ("P", "<S>", "<M>"), ("<é>", "<S>", "<M>")):
        with pytest.raises(ValueError):
            infill.Scanner(sentinels=bad)
    with pytest.raises(ValueError):
        infill.Scanner(infill.Classes((("ab", 1), ("bc", 1))))


def test_all_documents(spark):
    docs = table(spark, SF, "documents")
    assert check(docs) == {"plain", "psm", "spm"}
    assert_same(infill.infill_digest(docs), infill.ORACLE_INFILL, connect(SF))
