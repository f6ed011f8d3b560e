import numpy as np
import pytest

from opsdesk.llm import knn


def brute(rows, k=20):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and len(v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in ok if i % 20 == 0}:
        score = sorted((-int(np.dot(x, v)), i) for i, v in ok if i != q and len(v) == len(x))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = [(int(i), rng.normal(size=8).round(2).tolist()) for i in range(400)]
    out += [(int(i), [1.0] * 8) for i in range(400, 700)]             # a hot vector
    out += [(1000, None), (1001, [1.0, None, *[0.0] * 6]), (1002, [float("nan"), *[0.0] * 7]), (None, [1.0] * 8),
            (1003, [float("inf"), *[0.0] * 7]), (20, rng.normal(size=8).round(2).tolist()), (1040, []), (1060, [1.0, 2.0]), (7, [1.0] * 8)]
    return out


@pytest.mark.parametrize("sizes", [(32768, 2048), (64, 8)])
def test_results_equal_brute_force(spark, rows, sizes, monkeypatch):
    monkeypatch.setattr(knn, "SLICE_ROWS", sizes[0])
    monkeypatch.setattr(knn, "QUERY_ROWS", sizes[1])
    df = spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows],
                               "vec_id long, embedding array<double>, label int, cell string, slice int")
    assert sorted(map(tuple, knn.embedding_neighbours(df).collect())) == brute(rows)


def test_bounds_prune(spark):
    """Far cells are not replicated: theta lies above their upper bounds."""
    pivots = np.array([[100.0, 0], [0, 100.0], [-100.0, 0]])
    theta = knn._thresholds(pivots, np.ones(3), np.array([True, False, False]), np.ones(3), np.array([50, 50, 50]), 20, 1)
    assert theta[0] > 9000 and np.isneginf(theta[1])


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(20, [1.0, 0.5]), (21, [0.25, 1.0])], schema)
    assert [tuple(r) for r in knn.embedding_neighbours(df).collect()] == [(20, 1, 21, 64 * 16 + 32 * 64)]
    assert knn.embedding_neighbours(spark.createDataFrame([], schema)).count() == 0
    assert knn.embedding_neighbours(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
