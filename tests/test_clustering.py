import numpy as np
import pytest

from swarmlake.operators import clustering, landmarks


def table(spark, d, names):
    rows = [(names[i], names[j], float(d[i, j])) for i in range(len(d)) for j in range(len(d)) if i != j]
    return spark.createDataFrame(rows, "i string, j string, d double")


@pytest.mark.parametrize("n", [2, 3, 24])
def test_merges_against_one_by_one(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = clustering.average_linkage(table(spark, d, [f"p{i:02d}" for i in range(n)])).orderBy("step").collect()
    expected = landmarks.average_linkage(d)
    assert [tuple(r)[1:4] for r in got] == [m[:3] for m in expected]
    assert np.allclose([r["dist"] for r in got], [m[3] for m in expected])


def test_equal_distances_and_no_pairs(spark):
    """Four corners of a square: the pair of the smallest names first, then the other side."""
    x = np.array([[0, 0], [0, 1], [1, 1], [1, 0]])
    d = np.abs(x[:, None] - x[None]).sum(-1)
    got = clustering.average_linkage(table(spark, d, list("abcd"))).orderBy("step").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 2, 1.0), (2, 3, 4, 2, 1.0), (3, 5, 6, 4, 1.5)]
    assert clustering.average_linkage(spark.createDataFrame([], "i string, j string, d double")).collect() == []
