import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts; language and source take turns unless given."""

    def make(texts, sources=("a", "b"), langs=("en", "de"), ids=None):
        ids = ids or list(range(len(texts)))
        rows = [(i, t, langs[k % len(langs)], sources[k % len(sources)], None if t is None else len(t)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        return spark.createDataFrame(rows, DOCS)

    return make
