import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, words string"


def document(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", "y")


@pytest.fixture()
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    line = "The quick brown fox jumps over the lazy dog. "
    rows = [
        document(1, line * 3), document(2, line * 3), document(2, line * 3), document(3, None), document(4, ""),
        document(5, " \n\t "), document(None, line), document(None, None, None, None), document(6, line * 20_000),
        document(7, "a" * 300_000), document(8, "één 数据 \U0001f600 é İstanbul ΣΑΣ", None, None),
        document(9, "+1 (974) 555-3436, jo@mail.example.com; 4111 1111 1111 1111 and 10.0.0.1", "en", "b"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture()
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
