import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary):x}" for _ in range(n))


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents rows from texts (or (doc_id, text) pairs), with columns whose names operators use inside."""

    def build(texts, lang="en"):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        full = [(i, t, lang, "s", None if t is None else len(t), "x", 1) for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", key string, fp int")

    return build


#: Null, empty, blank, short, other scripts, very long, and repeated rows.
ODD = [None, "", " \n\t ", "a", "é ß 日本 語", "x " * 50_000, "a", "same words again", "same words again"]
