import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, token string, kept boolean, n_bytes long, component string"


def words(seed: int, n: int, stem: str = "w") -> str:
    """n words that no other seed has."""
    return " ".join(f"{stem}{seed}x{(i * 7919 + seed * 104729) % 99991:05d}" for i in range(n))


def documents(spark, texts):
    rows = [(i, t, "en", "s", 0, 7, "t", True, 1, "c") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, a long text, ties, repeated rows, columns with clashing names."""
    long = words(1, 6000)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, words(2, 300)), (6, words(2, 300)), (None, words(3, 200)), (None, None), (7, "one two"), (8, "ONE two"), (9, "Ünïcode 漢字 " * 100)]
    return documents(spark, texts)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
