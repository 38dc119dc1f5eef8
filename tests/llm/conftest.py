import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, print long, at int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, lang]) as documents, with extra columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None, "x", 1, 2) for r in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    import random

    rng = random.Random(7)
    known = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def line(n, seed):
        own = random.Random(seed)
        return " ".join(own.choice(known) for _ in range(n))

    return line
