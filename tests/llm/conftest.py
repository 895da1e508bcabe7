import pytest

#: Names that operators use inside, as columns of the input.
CLASH = ["keep", "stats", "hash", "gram", "words", "word", "f0", "rep", "rows", "key", "token_start", "gone", "stays", "rank", "p", "block", "good"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, columns with clashing names."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    body = " ".join(f"alpha{i} beta{i % 7}" for i in range(60))
    rows = [
        (1, body, "en", "a", 5), (1, body, "en", "a", 5), (2, body, None, None, None), (3, None, "en", "a", 1), (4, "", "en", "b", 0),
        (None, body, "en", "b", 2), (None, None, None, None, None), (5, long, "en", "b", 9), (6, long, "en", "b", 9), (7, "!!! ... ???", "en", "a", 1),
        (8, "one", "en", "c", 1), (8, "another text under one id, quite different from the first", "en", "c", 1), (9, "É ü   ß\n\n\nx", "de", "c", 1),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, *([f"v{k}" for k in range(len(CLASH))])) for r in rows], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
