import numpy as np
import pytest

from swarmlake.operators import landmarks, manifold


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, x array<double>")


def brute_graph(x, k):
    d = np.sqrt(np.round(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0), 8))
    np.fill_diagonal(d, np.inf)
    keep = d <= np.sort(d, axis=1)[:, min(k, len(x) - 1) - 1][:, None]
    near = np.where(keep, d, np.inf)
    near = np.minimum(near, near.T)
    np.fill_diagonal(near, 0)
    np.fill_diagonal(d, 0)
    return near, d


def as_matrix(edges, n):
    out = np.full((n, n), np.inf)
    np.fill_diagonal(out, 0)
    for r in edges.collect():
        out[r["i"], r["j"]] = r["d"]
    return out


@pytest.mark.parametrize("k, block", [(2, 4096), (4, 11)])
def test_nearest_graph_against_all_pairs(spark, monkeypatch, k, block):
    monkeypatch.setattr(manifold, "BLOCK", block)
    monkeypatch.setattr(manifold, "CHUNK", block)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(30, 3)), rng.normal(size=(25, 3)) + 30, np.round(rng.normal(size=(15, 3)) * 2)])
    x = np.unique(x, axis=0)
    cells = manifold.Cells(manifold.nodes(points(spark, x)), 9)
    edges = manifold.nearest_graph(cells, k)
    near, full = brute_graph(x, k)
    assert np.allclose(as_matrix(edges, len(x)), near)
    whole = landmarks.all_paths(landmarks.connected(near, full))
    joined = manifold.connected(edges, cells)
    sources = [r["node"] for r in manifold.far_apart(manifold.nodes(points(spark, x)), 5)]
    assert len(set(sources)) == 5 and sources[0] == 0
    for r in manifold.paths(joined, manifold.nodes(points(spark, x)), sources).collect():
        assert np.allclose(r["d"], whole[r["node"], sources])


def test_isomap_of_a_bent_strip(spark):
    """Along the strip, the first coordinate is the length; equal points have one place."""
    t = np.linspace(0.5, 3.5, 60)
    x = np.stack([t * np.cos(2 * t), t * np.sin(2 * t), np.zeros_like(t)], axis=1)
    x = np.concatenate([x, x[:3]])
    got = {r["vec_id"]: r["place"] for r in manifold.isomap(points(spark, x), 4, 1, 8).collect()}
    place = np.array([got[i][0] for i in range(len(x))])
    length = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(x[:60], axis=0), axis=1))])
    assert abs(np.corrcoef(place[:60], length)[0, 1]) > 0.999
    assert (place[60:] == place[:3]).all()


def test_few_points(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0]])
    assert np.allclose(as_matrix(manifold.nearest_graph(manifold.Cells(manifold.nodes(points(spark, x))), 5), 2), [[0, 1], [1, 0]])
