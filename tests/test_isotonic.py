import numpy as np
import pytest

from swarmlake.operators import isotonic as I

SCHEMA = "k string, x double, y double, range long"


def brute(y):
    """Largest of the smallest means: over starts up to a place, and ends from it."""
    sums = np.concatenate([[0.0], np.cumsum(y)])
    n = len(y)
    mean = np.array([[(sums[b + 1] - sums[a]) / (b + 1 - a) if b >= a else np.inf for b in range(n)] for a in range(n)])
    return [max(mean[a, i:].min() for a in range(i + 1)) for i in range(n)]


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = I.isotonic(df, ["k"], "x", "y")
    assert got.columns == ["k", "x", "y", "range", "fit"]
    got = got.collect()
    assert sorted(r["range"] for r in got) == [r[3] for r in rows]
    fit = {r["range"]: r["fit"] for r in got}
    groups = {}
    for r in rows:
        if r[1] is None or r[2] is None or not np.isfinite(r[1] * r[2]):
            assert fit[r[3]] is None
        else:
            groups.setdefault(r[0], []).append(r)
    for some in groups.values():
        some.sort(key=lambda r: (r[1], r[2]))
        assert np.allclose([fit[r[3]] for r in some], brute([r[2] for r in some]), atol=1e-9)


@pytest.mark.parametrize("limit, batch", [(1 << 16, 10000), (6, 4), (3, 16)])
def test_fit_against_all_means(spark, monkeypatch, limit, batch):
    """Rising, falling, toothed and tied values; groups with a null name; rows that take no part."""
    monkeypatch.setattr(I, "LIMIT", limit)
    monkeypatch.setattr(I, "CUTS", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = np.random.default_rng(5)
    shapes = {
        "up": [(i, i) for i in range(60)],
        "down": [(i, -i) for i in range(40)],
        "teeth": [(i, i % 12) for i in range(60)],
        None: [(int(a), int(b)) for a, b in rng.integers(0, 9, (50, 2))],
        "noise": [(i, i / 7 + rng.normal() * 2) for i in range(70)],
        "odd": [(None, 1), (1, None), (2, float("nan")), (3, float("inf")), (1, 4), (1, 4)],
    }
    rows = [(k, None if x is None else float(x), None if y is None else float(y)) for k, some in shapes.items() for x, y in some]
    try:
        check(spark, [(*r, i) for i, r in enumerate(rows)])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_no_rows_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert I.isotonic(empty, ["k"], "x", "y").collect() == []
    with pytest.raises(ValueError, match="column y"):
        I.isotonic(empty, [], "x", "y", "y")
