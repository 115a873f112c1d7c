import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, `_part` int, fp string, key string, `_keep` int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with extra columns whose names the operators use inside."""

    def make(pairs):
        rows = [(i, t, "en" if k % 2 else None, None if k % 3 == 0 else f"src{k % 4}", None if t is None else len(t), 7, "x", 1, "y", "z", k) for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return [
        (1, "The quick brown fox jumps over the lazy dog and runs away."), (2, None), (3, ""), (4, "  \t\n "), (5, long), (6, long), (None, "A text without an id"),
        (7, "the QUICK brown fox jumps over the lazy dog and runs away."), (8, "Été naïve Straße – «ñandú» 12³ ½ <|endoftext|> it's"), (9, "same"), (9, "same"), (10, "x" * 5000), (-3, "same"), (None, None),
    ]
