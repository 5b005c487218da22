import pytest

from ledgerloom.llm.common import importable

# fixed values: texts of every awkward kind
TEXTS = [
    None, "", " \n\t ", "one", "two words", "It's a line.\nAnd it's another, isn't it?", "Ünïcödé wörds\u00a0and\u3000spaces ñ",
    "tab\tand\r\nreturn\x0b\x0c ends ", "repeat " * 40, "\\### Assistant: </turn> ok", "a" * 5000, "word number %d " * 3000, "<|endoftext|> 12,345.67",
]


@pytest.fixture(scope="session")
def texts():
    return list(TEXTS)


@pytest.fixture(scope="session")
def docs(spark):
    """Awkward documents: nulls in every column, repeated rows, columns with working names."""
    importable(spark)
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0, "x", 1) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], (None, "no id at all, but some words", None, None, None, None, None), (None, None, None, None, None, None, None)]
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, position int"
    return spark.createDataFrame(rows, kinds)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session", autouse=True)
def _importable(spark):
    importable(spark)
