import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=()):
        """Documents from (id, text); ``extra`` names further integer columns."""
        schema = DOC_SCHEMA + "".join(f", {name} int" for name in extra)
        data = [(i, t, "en", "s", None if t is None else len(t), *[7] * len(extra)) for i, t in rows]
        return spark.createDataFrame(data, schema)

    return make


@pytest.fixture
def words():
    """Random prose from a small invented vocabulary."""
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(400)]

    def make(count, seed):
        own = random.Random(seed)
        return " ".join(own.choice(vocabulary) for _ in range(count))

    return make
