import pytest

WORDS = "the of and to in is was for that with by this are from have not but had they which one you were all".split()


def sentence(rnd, n, vocabulary=400):
    return " ".join(rnd.choice(WORDS) if rnd.random() < 0.2 else f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from (doc_id, text[, lang[, source]])."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return build
