import random

import pytest

# Rows with a null or empty text, a null id, a repeated row, one very long text, and columns whose names clash with
# the ones operators use inside.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, path string, n string, cls string"


@pytest.fixture(scope="session")
def prose():
    """A generator of plain invented sentences."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(3000)]

    def make(n_words: int, seed: int) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(vocabulary) for _ in range(n_words))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Documents with every awkward case."""
    rows = [(1, prose(80, 1)), (2, prose(120, 2)), (3, None), (4, ""), (5, "   \n\t"), (6, prose(80, 1)),
            (7, prose(30000, 7)), (None, prose(60, 8)), (8, "a"), (9, "É à ü 漢字 𝒳"), (2, prose(120, 2)), (10, "\n\n\n")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "p", "x", "c") for i, t in rows], CLASH)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], CLASH)


@pytest.fixture
def folder(tmp_path):
    """Write frames as the tables of a data folder."""
    def put(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put
