from pathlib import Path

import numpy as np
import pytest

from swarmlake.operators import manifold, models, pairs


def table(spark, x, fitness=None):
    fitness = np.arange(len(x)) / 7 if fitness is None else fitness
    return spark.createDataFrame([(i, [float(v) for v in row], float(f)) for i, (row, f) in enumerate(zip(x, fitness))], "vec_id long, x array<double>, fitness double")


def distances(x, digits=8):
    d = np.round(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0), digits)
    np.fill_diagonal(d, np.inf)
    return d


@pytest.fixture
def shuffled(spark):
    """Bytes written to shuffles since the test began."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    return lambda: total() - before


def test_graph_without_copies_of_points_in_shuffles(spark, shuffled):
    """points far from all cells met each cell as a copy."""
    x = np.random.default_rng(5).normal(size=(1500, 32))
    edges = manifold.nearest_graph(manifold.Cells(manifold.nodes(table(spark, x))), 3).collect()
    assert shuffled() < 6 * x.nbytes
    d = distances(x)
    near = d <= np.sort(d, axis=1)[:, 2:3]
    want = {(i, j): np.sqrt(d[i, j]) for i, j in zip(*np.nonzero(near | near.T))}
    got = {(r["i"], r["j"]): r["d"] for r in edges}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))


def test_packed_coordinates_are_the_same(spark):
    """Ten-thousandths take two bytes, others eight; both come back as they were, in rows of few points."""
    for x, short in ((np.round(np.random.default_rng(1).normal(size=(50, 4)), 4), True), (np.random.default_rng(2).normal(size=(50, 4)), False), (np.full((3, 2), 4.0), False)):
        rows = pairs.packed(table(spark, x), {"fitness": "<f8"}, block=7).collect()
        assert {r["short"] for r in rows} == {short} and max(len(r["ids"]) // 8 for r in rows) <= 7
        blocks = [pairs.Block(r.asDict(), {"fitness": "<f8"}) for r in rows]
        ids = np.concatenate([b.ids for b in blocks])
        assert sorted(ids) == list(range(len(x)))
        assert (np.concatenate([b.x for b in blocks]) == x[ids]).all() and np.allclose(np.concatenate([b.of["fitness"] for b in blocks])[:, 0], ids / 7)


def test_paths_in_turns_leave_few_tables(spark, monkeypatch):
    """each round left its tables, and sent the lengths of all edges at once."""
    monkeypatch.setattr(manifold, "EDGES", 70, raising=False)
    n, rng = 40, np.random.default_rng(4)
    d = np.full((n, n), np.inf)
    for i, j in zip(rng.integers(0, n, 70), rng.integers(0, n, 70)):
        if i != j:
            d[i, j] = d[j, i] = np.round(rng.random(), 3)
    edges = spark.createDataFrame([(int(i), int(j), float(d[i, j])) for i, j in zip(*np.nonzero(np.isfinite(d)))], "i long, j long, d double")
    rows = spark.range(n).withColumnRenamed("id", "node")
    left = lambda: len(list(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("table-*")))
    before = left()
    got = {r["node"]: r["d"] for r in manifold.paths(edges, rows, [0, 7, 9]).collect()}
    assert left() - before <= 3
    labels = {r["node"]: r["label"] for r in manifold.components(edges, rows).collect()}
    assert left() - before <= 4
    np.fill_diagonal(d, 0)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    assert all(np.allclose(got[i], d[i, [0, 7, 9]]) for i in range(n))
    assert labels == {i: int(np.flatnonzero(np.isfinite(d[i]))[0]) for i in range(n)}


def test_isomap_places_meet_points_by_hashes(spark, shuffled):
    """all coordinates of all points went through a last join."""
    x = np.random.default_rng(6).normal(size=(400, 64))
    x = np.concatenate([x, x[:9]])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = manifold.isomap(table(spark, x), 4, 2, 5).select("vec_id", "place")
        past = shuffled()
        got = {r["vec_id"]: r["place"] for r in placed.collect()}
        assert shuffled() - past < x.nbytes / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(got) == list(range(len(x))) and all(len(p) == 2 for p in got.values())
    assert all(got[400 + i] == got[i] for i in range(9))


def in_small_blocks(monkeypatch, run):
    """What ``run`` gives in rows of many points, and of few, over several parts."""
    whole = run()
    monkeypatch.setattr(pairs, "BLOCK", 16)
    monkeypatch.setattr(pairs, "TILE", 5)
    return whole, run()


def close(a, b):
    return a.keys() == b.keys() and all(np.allclose(np.array(a[k], dtype=float), np.array(b[k], dtype=float), rtol=1e-9, equal_nan=True) for k in a)


def clustered(n, width=3):
    """Points of which some are equally far from others, and one is far from all."""
    x = np.round(np.random.default_rng(8).normal(size=(n, width)), 1)
    x[n // 2] += 500
    return x


def test_split_errors_without_copies_of_points_in_shuffles(spark, shuffled, monkeypatch):
    """F4"""
    x = np.random.default_rng(7).normal(size=(1500, 32))
    errors = models.split_errors(table(spark, x), [0.5, 1.0], splits=3).collect()
    assert len(errors) == 2 and sum(r["best"] for r in errors) == 1
    assert shuffled() < 2 * x.nbytes
    run = lambda: {r["sigma"]: (r["mse"], r["best"]) for r in models.split_errors(table(spark, clustered(150)), [0.1, 0.2, 0.3, 0.8], splits=3).collect()}
    assert close(*in_small_blocks(monkeypatch, run))


def test_widths_without_one_without_copies_of_points_in_shuffles(spark, shuffled, monkeypatch):
    """F5"""
    x = np.random.default_rng(7).normal(size=(1500, 32))
    assert models.widths_without_one(table(spark, x), [0.5, 1.0], splits=2).count() == len(x)
    assert shuffled() < 4 * x.nbytes
    run = lambda: {r["vec_id"]: (r["sigma"], r["mse"]) for r in models.widths_without_one(table(spark, clustered(150)), [0.1, 0.2, 0.3, 0.8], splits=2).collect()}
    assert close(*in_small_blocks(monkeypatch, run))


def test_smoothed_by_all_without_copies_of_points_in_shuffles(spark, shuffled, monkeypatch):
    """F6"""
    x = np.random.default_rng(7).normal(size=(1500, 32))
    points = table(spark, x)
    assert models.smoothed_by_all(points, points, 0.5).count() == len(x)
    assert shuffled() < 2 * x.nbytes
    x, points = clustered(150), table(spark, clustered(150))
    d = distances(x)
    w = np.exp((d.min(1, keepdims=True) - d) / (2 * 0.2 * 0.2))
    want = dict(enumerate(w @ (np.arange(150) / 7) / w.sum(1)))
    for got in in_small_blocks(monkeypatch, lambda: {r["vec_id"]: r["predicted"] for r in models.smoothed_by_all(points, points, 0.2).collect()}):
        assert close(got, want)


def test_nearest_of_all_without_copies_of_points_in_shuffles(spark, shuffled, monkeypatch):
    """F7"""
    x = np.random.default_rng(7).normal(size=(1500, 32))
    points = table(spark, x)
    assert models.nearest_of_all(points, points).count() == len(x)
    assert shuffled() < 2 * x.nbytes
    x, points = clustered(150), table(spark, clustered(150))
    d = distances(x)
    want = {i: (j, d[i, j], j / 7) for i, j in enumerate(d.argmin(1))}
    asked = points.filter("vec_id % 10 = 0")
    for got in in_small_blocks(monkeypatch, lambda: {r["vec_id"]: (r["nearest"], r["d2"], r["predicted"]) for r in models.nearest_of_all(points, points).collect()}):
        assert close(got, want)
    assert close({r["vec_id"]: (r["nearest"], r["d2"], r["predicted"]) for r in models.nearest_of_all(asked, points).collect()}, {i: v for i, v in want.items() if i % 10 == 0})
