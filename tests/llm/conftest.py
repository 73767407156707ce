import pytest

#: Columns whose names an operator might use itself, beside those of documents.
CLASHES = ["row", "t", "s", "c0", "n", "size", "key", "_d", "_p", "spans", "a.b"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls in every column, empty, blank and long texts, ties, repeated rows and clashing columns."""
    long = " ".join(f"word{i % 997}" for i in range(30000))
    rows = [
        (1, "one two three four five six seven", "en", "b", 33),
        (2, "one two three four five six seven", "en", "a", 33),
        (2, "one two three four five six seven", "en", "a", 33),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \n\t ", "fr", None, 4),
        (None, "text without an id", "de", "c", 18),
        (6, long, "en", "c", len(long)),
        (7, "é😀 ñandú\nline two\nline three\nline four", "es", "a", 40),
        (8, "é😀 ñandú\nline two\nline three\nline four", "es", "d", 40),
        (9, "x", "en", "d", 1),
    ]
    full = [(*r, *[i] * len(CLASHES)) for i, r in enumerate(rows)]
    kinds = ", ".join(f"`{c}` int" for c in CLASHES)
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {kinds}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


def kept(df, odd_docs):
    """All rows and columns of the odd documents are still there."""
    assert set(odd_docs.columns) <= set(df.columns)
    assert sorted(r["c0"] for r in df.select("c0").collect()) == list(range(11))
    return df
