"""Rows that every operator on documents must survive, and the crc32 folds."""

import zlib

import pytest

LONG = " ".join(f"word{i % 977} and thing{i % 53}" for i in range(20_000))
TEXTS = [
    None, "", " \t\n\r\v\f ", "one", "two words", "Über die Straße, ganz schön — dit-il: “où?”", "a b c d e f g h " * 40, LONG, LONG,
    "same text here for all of us to read and to keep", "same text here for all of us to read and to keep", "SAME text HERE for all of us to read and to keep",
    "# * $ % & | < >", "   odd  spaces\u0085 ", "line one of this\nline one of this\n\nline two", "▁ ▁▁ x", "  lead and trail  ", "\U0001f600 emoji \U0001f600\U0001f600", "日本語のテキスト 中文", "<|endoftext|> as text",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null and repeated ids and texts, ties, a very long text, and columns whose names operators use inside."""
    rows = [(None if i == 5 else i - 2 if i == 10 else i, t, None if i % 5 == 0 else ("en", "de")[i % 2], None if i % 3 == 0 else f"s{i % 3}", None, i, "x", "y", 1.5, "z", i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, id string, key string, score double, component string, `range` int")


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


def fold(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n
