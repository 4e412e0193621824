"""Sparse principal components of a tall table (vec_id, x): few columns, rows spread over tasks.

Weights ``u`` of the rows have an L1 bound, weights ``v`` of the columns are orthogonal
(deflation by components found before). A step takes the best u for v, then the best v
for u. The best u under the bound is a soft threshold of X v; which one is found from
sums over bins of its absolute values, cut finer until no value is left in the bin that
holds the threshold: then it is the root of a quadratic in three sums. Nothing that
grows with the rows leaves the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialized

BINS = 512


class Component(NamedTuple):
    s: float
    v: np.ndarray
    threshold: float  # of |X v|, deflated
    length: float  # of what the threshold leaves


def _rest(df: pd.DataFrame, found: list[Component]) -> np.ndarray:
    """Rows less the components found before, whose u is taken from the rows itself, one after the other."""
    x = np.stack(df["x"].to_numpy())
    for c in found:
        x = x - c.s * np.outer(weights(x @ c.v, c), c.v)
    return x


def soft(w: np.ndarray, threshold: float) -> np.ndarray:
    return np.sign(w) * np.maximum(np.abs(w) - threshold, 0)


def weights(w: np.ndarray, c: Component) -> np.ndarray:
    return soft(w, c.threshold) / c.length


def _summed(rows: DataFrame, found: list[Component], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``of`` the deflated rows of a batch, a vector: one row a task is sent."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for df in frames:
            if len(df):
                part = of(_rest(df, found))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    parts = rows.select("x").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()  # as long as the vector
    return parts.sort_values("i")["v"].to_numpy()


def threshold(rows: DataFrame, found: list[Component], v: np.ndarray, bound: float, top: float) -> float:
    """The least threshold of |X v| that brings the L1 norm of what is left, over its L2 norm, down to ``bound``; ``top`` is at least the largest value."""
    low, high = 0.0, top * (1 + 1e-9)
    above = np.zeros(3)  # number, sum and squares of the values over ``high``
    while True:

        def binned(x: np.ndarray, low: float = low, high: float = high) -> np.ndarray:
            w = np.abs(x @ v)
            w = w[(w > low) & (w <= high)]
            at = np.minimum(((w - low) / (high - low) * BINS).astype(np.int64), BINS - 1)
            return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, w, BINS), np.bincount(at, w * w, BINS)])

        sums = _summed(rows, found, binned).reshape(3, BINS)
        edges = low + (high - low) * np.arange(BINS) / BINS
        over = above[:, None] + np.cumsum(sums[:, ::-1], axis=1)[:, ::-1]  # of the values over each lower edge
        one, two = over[1] - edges * over[0], over[2] - 2 * edges * over[1] + edges**2 * over[0]
        too_long = one**2 > bound**2 * two
        if low == 0.0 and not too_long[0]:
            return 0.0
        at = int(np.flatnonzero(too_long)[-1])  # the ratio falls as the threshold grows
        above = over[:, at + 1] if at + 1 < BINS else above
        width = (high - low) / BINS
        low, high = edges[at], edges[at] + width
        if not sums[0, at] or width <= 1e-15 * top:
            n, total, squares = over[:, at] if not sums[0, at] else above
            # (total - n t)^2 = bound^2 (squares - 2 t total + n t^2)
            a, b, c = n * n - bound**2 * n, -2 * n * total + 2 * bound**2 * total, total**2 - bound**2 * squares
            roots = np.roots([a, b, c]) if abs(a) > 1e-12 else np.array([-c / b])
            inside = [float(t.real) for t in roots if abs(t.imag) < 1e-9 and low - width <= t.real <= high + width]
            return min(max(inside[0], low), high) if inside else low


def sparse_components(points: DataFrame, k: int, bound: float, tolerance: float = 1e-6) -> tuple[DataFrame, list[Component]]:
    """``points`` with ``u``, their weights in k components of L1 norm ``bound`` and L2 norm 1 at most, and the components.

    A component of a larger s than one before it takes that one's place, and the search
    goes on from there. Each step raises s; a component ends when it does so by no more
    than ``tolerance`` of it.
    """
    rows = materialized(points.select("vec_id", "x").filter("x is not null"))
    found: list[Component] = []
    start = None
    while len(found) < k:
        ahead = np.array([c.v for c in found])
        across = lambda y, ahead=ahead: y - ahead.T @ (ahead @ y) if len(ahead) else y
        sums = _summed(rows, found, lambda x: np.append((x.T @ x).ravel(), 0.0))[:-1]
        gram = sums.reshape(int(np.sqrt(len(sums))), -1)
        if np.trace(gram) <= 1e-18:
            break
        top = float(np.sqrt(np.trace(gram)))
        if start is None:
            own = np.eye(len(gram)) - (ahead.T @ ahead if len(ahead) else 0)
            start = np.linalg.eigh(own @ gram @ own)[1][:, -1]
        v, before, component = start, -np.inf, None
        while True:
            t = threshold(rows, found, v, bound, top)

            def turned(x: np.ndarray, v: np.ndarray = v, t: float = t) -> np.ndarray:
                u = soft(x @ v, t)
                return np.append(x.T @ u, u @ u)

            sums = _summed(rows, found, turned)
            length = float(np.sqrt(sums[-1]))
            if not length:
                break
            toward = across(sums[:-1] / length)
            s_of_v = float(v @ sums[:-1]) / length
            component = Component(s_of_v, v, t, length)
            s = float(np.linalg.norm(toward))
            if s <= 0 or s_of_v - before <= tolerance * abs(s_of_v):
                break
            before, v = s_of_v, toward / s
        if component is None or component.s <= 0:
            break
        start = None
        better = [i for i, c in enumerate(found) if component.s - c.s > tolerance * c.s]
        if better:
            found, start = found[: better[0]], component.v
        else:
            found.append(component)

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                u = [weights(_rest(df, found[:i]) @ c.v, c) for i, c in enumerate(found)]
                yield pd.DataFrame({"vec_id": df["vec_id"], "u": list(np.stack(u, axis=1)) if u else [[]] * len(df)})

    return rows.mapInPandas(named, "vec_id long, u array<double>"), found


def submatrix_scores(points: DataFrame, quantiles: list[float], dimensions: int) -> pd.DataFrame:
    """How much of the squares of the most varying rows lies in ``dimensions`` axes, by the share of rows left out.

    Rows (vec_id, x) are variables over few samples. Those under each quantile of the
    standard deviations are left out; the Gram matrices of what is left add up from
    bands between thresholds, from above, and each gives its singular values.
    """
    rows = materialized(points.select("vec_id", "x").filter("x is not null"))
    n = F.size("x")
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / n
    spread = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / (n - 1))
    known = materialized(rows.select("x", spread.alias("sd"), mean.alias("mean")))
    cuts = known.agg(F.percentile("sd", F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")).first()["q"]
    band = sum((F.when(F.col("sd") >= float(c), 1).otherwise(0) for c in cuts), F.lit(0))

    def grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        for df in frames:
            for b, some in df.groupby("band"):
                x = np.stack(some["x"].to_numpy()) - some["mean"].to_numpy()[:, None]
                totals[b] = totals.get(b, 0) + np.append((x.T @ x).ravel(), len(x))
        for b, total in totals.items():
            yield pd.DataFrame({"band": b, "i": np.arange(len(total)), "v": total})

    parts = known.withColumn("band", band).select("x", "mean", "band").mapInPandas(grams, "band int, i int, v double")
    sums = parts.groupBy("band", "i").agg(F.sum("v").alias("v")).toPandas()  # thresholds x samples squared
    out, total = [], 0.0
    for b in range(len(cuts), 0, -1):
        own = sums[sums["band"] == b].sort_values("i")["v"].to_numpy()
        total = total + own if len(own) else total
        if np.ndim(total):
            gram = total[:-1].reshape(int(np.sqrt(len(total) - 1)), -1)
            values = np.sort(np.maximum(np.linalg.eigvalsh(gram), 0))[::-1]
            out.append({"left_out": quantiles[b - 1], "rows": int(total[-1]), "score": float(values[:dimensions].sum() / max(values.sum(), 1e-300)), "singular": float(np.sqrt(values[0]))})
    return pd.DataFrame(out)
