import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, place string, f string"


@pytest.fixture
def docs(spark):
    """A frame of (id, text) pairs with the other columns of documents, and extra ones whose names clash."""

    def make(pairs, lang="en", source="s", parts=3):
        rows = [(i, t, lang, source, None if t is None else len(t), "x", "y", "z") for i, t in pairs]
        return spark.createDataFrame(rows, DOCS).repartition(parts)

    return make


@pytest.fixture
def prose():
    def make(n, seed=0, vocabulary=400):
        rng = random.Random(seed)
        return " ".join(rng.choice(["alpha", "beta", "Gamma", "delta."]) + str(rng.randrange(vocabulary)) for _ in range(n))

    return make


#: Null, empty, blank, one word, repeated rows, other scripts and odd white space.
ODD = [(None, "no id here at all"), (1, None), (2, ""), (3, " \t\n\r "), (4, "one"), (4, "one"), (5, "né à 東京 𝒳 \x1c\x85 x"), (6, "a b\n\na b\n"), (7, "x" * 3000)]
