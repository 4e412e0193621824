from collections import Counter

import numpy as np
import pytest

from swarmlake.llm import negatives

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
SCHEMA = "vec_id long, embedding array<float>, label int, `row` string, `q` int, salt int, anchor string, score double"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x], label, "r", 1, 2, "a", 0.5) for i, x, label in rows], SCHEMA)


def brute(rows):
    some = []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(v is None or not np.isfinite(v) for v in x):
            continue
        some.append((i, [int(np.floor(256 * float(np.float32(v)))) for v in x], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for r, (i, x, label) in enumerate(some):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, s, other) for s, (j, y, other) in enumerate(some) if s != r)
        for less, j, _, _ in [s for s in scored if s[3] == label][:5]:
            fit = [s for s in scored if s[3] != label and 80 * -less <= 100 * -s[0] <= 100 * -less][:5]
            out += [(i, j, k, s[1], -less, -s[0]) for k, s in enumerate(fit, 1)]
    return Counter(out)


def found(df):
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def drawn(n, dim=12, seed=4, near=0.3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)) * near + 0.3
    return [(int(i), base[i], int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("block, chunk", [(4096, 4096), (40, 3)])
def test_mined_against_brute_force(spark, monkeypatch, block, chunk):
    """Many small blocks, and so several rounds, give what one block gives."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    monkeypatch.setattr(negatives, "TOGETHER", 2)
    rows = drawn(700)
    assert found(negatives.mined(vectors(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    """Nulls, non-finite components, ties, repeated rows and ids, short vectors, scores below zero."""
    rows = drawn(160, dim=6, seed=9)
    rows += [(100, rows[100][1], rows[100][2]), (100, rows[3][1], 1), (3, rows[3][1], rows[3][2]), (4, rows[3][1], 0), (None, rows[1][1], 1), (5, None, 1), (6, rows[1][1], None)]
    rows += [(8, [None, 1.0], 1), (9, [float("nan"), 1.0], 1), (10, [float("inf")], 1), (200, [0.5, 0.25], 2), (300, [], 1), (400, -rows[0][1], 2), (500, [0.0] * 6, 0)]
    assert found(negatives.mined(vectors(spark, rows))) == brute(rows)


def test_empty(spark):
    assert negatives.mined(vectors(spark, [])).count() == 0
    assert negatives.mined(vectors(spark, [(100, None, 1), (1, [1.0], 1)])).count() == 0
    assert negatives.mined(vectors(spark, [(100, [1.0], 1)])).count() == 0


def test_partial_scores_leave_pairs_out():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-99, 99, (20, 64)), rng.integers(-99, 99, (300, 64))
    a[:, 16:] //= 20
    b[:, 16:] //= 20
    whole = a @ b.T
    scores = negatives.PartialScores(a, b)
    for least in (np.quantile(whole, 0.99, axis=1), np.quantile(whole, 0.9, axis=1), np.full(20, -np.inf)):
        hit = scores.reach(least)
        assert (hit == (whole >= least[:, None])).all()
        assert (scores.score[hit] == whole[hit]).all()
        if np.isfinite(least[0]):
            assert (scores.stage < scores.stages).mean() > 0.5
