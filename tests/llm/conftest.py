from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators might use for themselves.
CLASHES = {
    c: f"'{c}'"
    for c in ("score", "shard", "slot", "ids", "spans", "row", "word", "fp", "key", "part", "rank",
              "quality", "_text", "_measures", "_quality", "_toxicity", "label", "rare", "size")
}


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with the given texts and columns of clashing names."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, DOCS).selectExpr(
            "*", *[f"{value} AS `{name}`" for name, value in CLASHES.items()]
        )

    return make


#: Null, empty, blank, repeated, odd and long texts.
EDGES = [
    None, "", "   \n\t ", "a", "a", "one two three", "one two three", "x" * 5000,
    "word " * 3000, "\x1c\x00 é ß İ 漢字 😀  ", "1 2 3 4 5 6 7 8 9 0 " * 300, "@" * 2000,
    "<|endoftext|> a", "+" + "1" * 4000, "\n" * 50,
]
