import os

os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

import pytest  # noqa: E402

# names that the operators use inside, as columns of the input
CLASHES = ["blk", "bucket", "start", "length", "grp", "set_key", "cluster", "_seq", "_cut", "score", "n_words",
           "held_out", "ids", "key", "bands", "text_key", "cell", "rank"]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with the usual and with clashing further columns."""
    def make(rows, clash=True):
        from pyspark.sql import functions as F
        df = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows],
                                   "doc_id long, text string, lang string, source string, n_chars long")
        return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df
    return make


@pytest.fixture(scope="session")
def words():
    """Seeded pseudo-words."""
    import random

    def make(n, seed, vocabulary=5000):
        rng = random.Random(seed)
        return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return make
