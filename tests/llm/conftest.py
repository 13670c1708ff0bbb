import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows, extra=()):
        schema = DOCS + "".join(f", {c} string" for c in extra)
        return spark.createDataFrame([tuple(r) + ("x",) * len(extra) for r in rows], schema)

    return make


#: Names that the operators use inside; other columns may bear them too.
CLASHING = ["row", "text_key", "line_key", "bucket", "node", "a", "b", "hash", "n", "kept", "key", "name", "content", "place", "u"]


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids, clashing names."""
    long_ = " ".join(f"word{k % 5000}" for k in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s1", 10),
        (2, None, None, None, None), (3, "", "en", "s1", 0), (4, " \n\t ", "en", "s2", 4), (5, long_, "en", "s1", len(long_)),
        (6, long_, "en", "s2", len(long_)), (7, "one two", "en", "s1", 7), (8, "one two", "fr", "s1", 7), (9, "one two", "en", None, 7), (9, "one two", "en", None, 7),
        (None, "no id here at all but words enough for a set", "en", "s3", 10), (10, "\0 zero <|endoftext|> Σίσυφος ÀÉ ﬁ ½ 日本", "el", "s4", 10), (11, "a" * 100_000, "en", "s1", 100_000),
    ]
    return docs_of(rows, CLASHING)
