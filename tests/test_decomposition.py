import numpy as np

from swarmlake.operators import decomposition


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, x array<double>").repartition(3)


def dense_threshold(w, bound):
    """By halving on the sorted values."""
    w, low, high = np.abs(w), 0.0, np.abs(w).max()
    ratio = lambda t: np.maximum(w - t, 0).sum() / np.sqrt((np.maximum(w - t, 0) ** 2).sum())
    if ratio(0) <= bound:
        return 0.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if mid < w.max() and ratio(mid) > bound else (low, mid)
    return high


def test_threshold_against_halving(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(200, 5)), np.round(rng.normal(size=(60, 5)))])
    rows, v = points(spark, x), np.array([0.5, 0.5, 0.5, 0.1, 0.48])
    top = np.sqrt((x**2).sum())
    for bound in (1.5, 4.0, 9.0, 100.0):
        assert abs(decomposition.threshold(rows, [], v, bound, top) - dense_threshold(x @ v, bound)) < 1e-8


def test_components_meet_their_conditions(spark):
    """Each u is the bounded optimum for its v and each v for its u, orthogonal to those before; s falls."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 6)) * 0.1
    x[:30] += np.outer(rng.normal(size=30) + 2, rng.normal(size=6))
    x[40:60] += np.outer(rng.normal(size=20) - 2, rng.normal(size=6))
    got, found = decomposition.sparse_components(points(spark, x), 2, 4.0, 1e-10)
    u = np.zeros((150, 2))
    for r in got.collect():
        u[r["vec_id"]] = r["u"]
    rest = x.copy()
    assert found[0].s >= found[1].s > 0 and abs(found[0].v @ found[1].v) < 1e-6
    for k, c in enumerate(found):
        assert np.linalg.norm(u[:, k]) < 1 + 1e-9 and np.abs(u[:, k]).sum() < 4 + 1e-6
        best = decomposition.soft(rest @ c.v, dense_threshold(rest @ c.v, 4.0))
        assert np.allclose(u[:, k], best / np.linalg.norm(best), atol=1e-6)
        toward = rest.T @ u[:, k]
        for other in found[:k]:
            toward -= other.v * (other.v @ toward)
        assert np.allclose(c.v, toward / np.linalg.norm(toward), atol=1e-3) and abs(u[:, k] @ rest @ c.v - c.s) < 1e-9
        rest = rest - c.s * np.outer(u[:, k], c.v)


def test_scores_against_dense_decomposition(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 7)) * rng.uniform(0.1, 3, size=(120, 1))
    shares = [0.0, 0.3, 0.8]
    got = {r["left_out"]: r for _, r in decomposition.submatrix_scores(points(spark, x), shares, 2).iterrows()}
    sd = x.std(axis=1, ddof=1)
    for q in shares:
        some = x[sd >= np.quantile(sd, q)]
        s = np.linalg.svd(some - some.mean(axis=1, keepdims=True), compute_uv=False)
        assert got[q]["rows"] == len(some) and abs(got[q]["score"] - (s[:2] ** 2).sum() / (s**2).sum()) < 1e-9 and abs(got[q]["singular"] - s[0]) < 1e-9
