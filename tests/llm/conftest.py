import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, code long, n_tokens string, text_ string"


@pytest.fixture
def docs(spark):
    """Rows of (doc_id, text) as documents, with columns that clash with names the operators use."""

    def make(rows, lang="en"):
        return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, "k", 1, "x", None) for i, t in rows], SCHEMA)

    return make


#: Texts that each operator meets: null, empty, blank, one letter, no letter, white space of all kinds, marks, wide characters, long.
ODD = [
    None, "", " ", "a", "!!!", "\n\n\n", "\t\x0b\x0c\r \n", "<|endoftext|>", "it's  we'll don't   x y", "日本語のテキスト 😀👍🏽 é",
    "\x00nul\x00 and\x1c more", "word " * 3000, "x" * 50_000, "line\n" * 2000,
]
