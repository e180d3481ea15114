import pytest

#: Columns that operators use by the same names inside.
EXTRA = "n_words long, key string, row long, mark long, block long, tokens string, spans string, rank int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with the table's columns and others that clash with inner names."""

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t), 1, "k", 2, 3, 4, "t", "s", 5) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA)

    return make


def words(seed, n, vocabulary=400):
    import random

    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


#: Null and empty texts, a very long one, repeated rows, a null id.
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, " ".join(words(1, 30_000))), (6, "same text here"), (6, "same text here"), (None, "no id at all"), (7, "ÉÀ ß İ K 中文")]
