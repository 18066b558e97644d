import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality_rules as Q
from graphloom.llm import registry
from graphloom.llm.textstats import styles, text_stats
from graphloom.sources import table

SF = "/root/testdata/sf0.01"


def slow_counts(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_counts():
    for t in (None, "", " ", "a b c a b c a", "x\nx\n\nx\n y", "é # ü|<> z", "a a a a a", "a b c d a b c e b c d"):
        assert text_stats(t)[0] == slow_counts(t) == text_stats(t, styles)[0]


def test_styles():
    words = ["The", "cat,", "the", "hat."]
    sizes = np.log([len(w) for w in words])
    shares = [np.arcsin(np.sqrt(x / 14)) for x in (2, 1)]
    assert text_stats(" ".join(words), styles)[1] == pytest.approx([sizes.mean(), sizes.std(), *shares, 1.0])
    assert text_stats("a a", styles)[1][-1] == 0 and text_stats(None, styles)[1] == [0] * 5


def distances(x, steady, location, scatter):
    z = x - location
    return np.einsum("ni,ij,nj->n", z, np.linalg.inv(scatter), z) * steady


def slow_core(d):
    """Weight of each document in the core: nearest bins first, the last bin by its share."""
    bins = np.floor(np.log2(np.maximum(d, 2.0**-20)) * 16).astype(int)
    left, weight = 0.75 * len(d), np.zeros(len(d))
    for b in np.unique(bins):
        weight[bins == b] = min(1.0, max(0.0, left / (bins == b).sum()))
        left -= (bins == b).sum()
    return weight


def slow_mcd(x, steady, guard):
    """MCD of one group in memory."""
    q1, median, q3 = np.percentile(np.round(x, 3), [25, 50, 75], axis=0)
    scale = np.maximum((q3 - q1) / 1.349, np.sqrt(guard))
    z = (x - median) / scale
    sign = z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
    best = None
    for moment in (np.cov(np.tanh(z).T, bias=True), sign.T @ sign / len(x), np.eye(x.shape[1])):
        size = np.sqrt(np.maximum(np.diag(moment), 1e-12))
        correlation = 0.99 * moment / np.outer(size, size) + 0.01 * np.eye(x.shape[1])
        state = (np.inf, median, correlation * np.outer(scale, scale) + np.diag(guard))
        for _ in range(2):
            state = slow_step(x, steady, guard, state)[0]
        if best is None or state[0] < best[0]:
            best = state
    while True:
        best, done = slow_step(x, steady, guard, best)
        if done:
            return best[1:]


def slow_step(x, steady, guard, state):
    core = slow_core(distances(x, steady, *state[1:]))
    weight = core * steady
    location = weight @ x / weight.sum()
    z = x - location
    scatter = Q._CONSISTENT * (z.T * weight) @ z / core.sum() + np.diag(guard)
    new = (np.linalg.slogdet(scatter)[1], location, scatter)
    return min(new, state, key=lambda s: s[0]), min(new[0], state[0]) > state[0] - 1e-3


def slow_verdicts(given):
    """id -> (distance, kept) of (id, text, lang, source), every group in memory."""
    stats = {i: text_stats(t, styles) for i, t, _, _ in given}
    failed = {i: c[0] < 50 or 100 * c[4] > 50 * c[0] for i, (c, _) in stats.items()}
    distinct = {json.dumps([a, b, *stats[i]]): (a, b, stats[i][1], stats[i][0][0]) for i, _, a, b in given if not failed[i]}
    distinct = {json.dumps([a, b, v, n]): (a, b, np.array(v), n / (n + 400)) for a, b, v, n in distinct.values()}.values()
    vectors = np.array([v for _, _, v, _ in distinct])
    guard = 1e-6 * np.maximum(vectors.var(0), 1e-6)

    def fit(keep):
        some = [(v, s) for a, b, v, s in distinct if keep(a, b)]
        return (len(some), *slow_mcd(np.array([v for v, _ in some]), np.array([s for _, s in some]), guard))

    all_ = fit(lambda a, b: True)
    langs = {x: fit(lambda a, b, x=x: a == x) for x in {a for a, *_ in distinct}}
    out = {i: (None, False) for i, *_ in given}
    for lang, source in {(a, b) for a, b, *_ in distinct}:
        own = fit(lambda a, b, k=(lang, source): (a, b) == k)
        location, scatter = all_[1:]
        for n, m, s in (langs[lang], own):
            location, scatter = (n * m + 50 * location) / (n + 50), (n * s + 50 * scatter) / (n + 50)
        for i, _, a, b in given:
            if (a, b) == (lang, source):
                n = stats[i][0][0]
                d = distances(np.array([stats[i][1]]), n / (n + 400), location, scatter)[0]
                out[i] = d, not failed[i] and d <= Q.CUTOFF
    return out


def test_verdicts_against_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang", F.when(F.col("doc_id") % 7 > 0, F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b")).alias("source"))
    rows = {r.doc_id: r for r in Q.quality_digest(docs).collect()}
    given = [tuple(r) for r in docs.collect()]
    verdicts = slow_verdicts(given)
    for i, t, _, _ in given:
        r, counts = rows[i], text_stats(t, styles)[0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert r.distance == pytest.approx(verdicts[i][0], rel=1e-4, abs=1e-9) and r.kept == verdicts[i][1]


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = registry.op10_quality_rules(spark, sf).join(table(spark, sf, "labels"), "doc_id").filter("not base_failed").collect()
    clean, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in clean) <= 0.003 * len(clean)
    assert sum(r.kept for r in bad) <= 0.01 * len(bad)


def test_the_fit_decides(spark):
    """With the identity as every group's estimate no bad document would be found."""
    sf = "/root/testdata/sf0.1"
    scratch = Q.Scratch(spark, "test")
    stats = scratch.save(Q.with_stats(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"), styles), "stats")
    fit = Q.fit_outliers(stats)
    flat = fit.withColumns({"location": F.array(*[F.lit(0.0)] * Q.P), "precision": F.array(*[F.lit(float(x)) for x in np.eye(Q.P).ravel()])})
    found = lambda f: {r.doc_id for r in Q.judge(stats, f).filter("not kept and not base_failed").collect()}
    assert len(found(fit)) > 300 and not found(flat)
    # and with one group's estimate for all, clean documents of other languages would go
    one = fit.filter(F.col("group").contains("=en")).orderBy("group").limit(1).select("location", "precision")
    assert len(found(fit.drop("location", "precision").crossJoin(one)) - found(fit)) > 200


def test_chi_square():
    assert Q.chi2_quantile(0.95, 7) == pytest.approx(14.0671, abs=1e-3)
    assert Q.chi2_quantile(0.999999, 5) == pytest.approx(35.888, abs=1e-2)


def test_edge_cases(spark, make_docs):
    good = " ".join(f"word{i}" for i in range(80))
    docs = make_docs([None, "", good, good, "# " * 500], sources=(None, "a"), langs=(None,)).withColumns({"row": F.lit(1), "vector": F.lit(2), "kept": F.lit(3), "group": F.lit(4), "steady": F.lit(5)})
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert Q.quality_digest(docs.limit(0)).count() == 0 and Q.keep_good(docs.limit(0)).count() == 0


def test_long_text_and_lone_groups(spark, make_docs):
    """A text of millions of characters, and documents that are each alone in their source."""
    prose = [f"{w} of the {v}, and then some {w}{v}." for w in ("light", "river", "Stone", "a") for v in ("house", "bird", "summer", "idea", "To")]
    texts = [" ".join(prose[(k + i * (k + 1)) % 20] for i in range(30)) + f" End {k}." for k in range(40)] + [" ".join(f"{p}{i}" for i in range(20_000) for p in ("tree", "sky", "Sea."))]
    docs = make_docs(texts, sources=[f"s{k}" for k in range(41)], langs=("en",))
    rows = {r.doc_id: r for r in Q.quality_digest(docs).collect()}
    assert rows[40].n_words == 60_000 and len(rows) == 41 and all(r.distance is not None for r in rows.values() if not r.base_failed)


def test_no_copy_of_the_documents_is_written(make_docs, monkeypatch):
    saved, save = [], Q.Scratch.save
    monkeypatch.setattr(Q.Scratch, "save", lambda self, df, name, *a: saved.append(set(df.columns)) or save(self, df, name, *a))
    Q.keep_good(make_docs([" ".join(f"word{i}" for i in range(80))] * 3))
    assert saved and not any(c & {"row", "text"} for c in saved)
