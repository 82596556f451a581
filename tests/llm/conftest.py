import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with columns whose
    names clash with those that operators work with."""

    def make(rows, extra=True):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:
            df = df.selectExpr("*", "1 as size", "'x' as h", "2 as part", "3 as rank", "4 as length", "5 as token", "6 as node", "7 as score")
        return df

    return make


@pytest.fixture(scope="session")
def hard_texts():
    """Null, empty, blank, long, repeated and odd texts."""
    long_line = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a b"), (5, "a b"), (6, long_line), (7, "x" * 50_000),
        (8, "Ärger über Öl – ½ ﬁ   é 😀"), (9, "\n\n\n"), (None, "no id at all here"), (None, None),
        (10, "the same line\nthe same line\nthe same line"), (11, "a b c d e f g h " * 20), (12, "a b c d e f g h " * 20),
    ]
