"""Maximum-likelihood codon and nucleotide frequencies of a mixture seen through errors.

At one position, the reads' observations and their qualities give the likelihood
of every codon; the frequencies maximise the mixture's likelihood on the simplex.
That problem is convex; Newton's method over an active set finds the maximum. One
group is a small matrix: equal observations are counted before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.sequences import BASES, CODONS

START = 1e-3  # share of the start that is spread evenly
WARM = 10  # rounds of expectation maximisation before the first step
RIDGE = 1e-10
DUST = 1e-13  # a frequency so small is zero: its state is out until it is taken in again
TOLERANCE = 1e-7


def error_probability(q: np.ndarray) -> np.ndarray:
    return np.minimum(10.0 ** (-q / 10.0), 0.75)


def likelihoods(seen: list[str], q: np.ndarray, states: list[str]) -> np.ndarray:
    """P(observation | state), one row a state; a masked quality 0 tells nothing of its base."""
    p = error_probability(q.astype(float))
    letters = np.array([[BASES.index(b) for b in s] for s in seen])
    state = np.array([[BASES.index(b) for b in s] for s in states])
    equal = state[:, None, :] == letters[None, :, :]
    return np.where(equal, 1 - p, p / 3).prod(axis=2)


def objective(rcc: np.ndarray, n: np.ndarray, x: np.ndarray) -> float:
    """The mean negative log-likelihood of an observation."""
    return float(-(n @ np.log(x @ rcc)) / n.sum())


def gradient(rcc: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of the objective: -1 for each state of the maximum, no less for any other."""
    return -(rcc @ (n / (x @ rcc))) / n.sum()


def projected(g: np.ndarray) -> np.ndarray:
    """A gradient without its part across the simplex."""
    return g - g.mean()


def hessian(rcc: np.ndarray, n: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (rcc * (n / (x @ rcc) ** 2)) @ rcc.T / n.sum()


def newton_direction(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The step to the least of the quadratic model on the simplex: the Hessian bordered by the sum's condition."""
    m = len(g)
    system = np.ones((m + 1, m + 1))
    system[:m, :m] = h + RIDGE * np.trace(h) / m * np.eye(m)
    system[m, m] = 0
    return np.linalg.solve(system, np.append(-g, 0))[:m]


def _without_dust(x: np.ndarray) -> np.ndarray:
    x = np.where(x > DUST, x, 0)
    return x / x.sum()


def solve(rcc: np.ndarray, n: np.ndarray, start: np.ndarray, method: str = "newton", tolerance: float = TOLERANCE, rounds: int | None = None) -> np.ndarray:
    """The maximum on the simplex by steps over the free states, Newton's or those of the projected gradient (``method``).

    A step ends where a state reaches zero, which is then left out. When the free
    states are level, the state left out that would lower the objective most is
    taken in again; if there is none, the maximum is found. The objective falls
    with each step, so this ends by itself; ``rounds`` is for the slow gradient.
    """
    x = (1 - START) * start + START / len(start)
    for _ in range(WARM):
        x = x * -gradient(rcc, n, x)
    x = _without_dust(x)
    free, stuck, step, done = x > 0, False, 1.0, 0
    while rounds is None or done < rounds:
        done += 1
        g = gradient(rcc, n, x)
        near = tolerance * np.linalg.norm(g)
        if stuck or np.abs(g[free] + 1).max() <= near:
            left_out = np.where(free, 0, g + 1)
            if left_out.min() >= -near:
                break
            free[left_out.argmin()] = True
        some = np.flatnonzero(free)
        go = newton_direction(hessian(rcc[some], n, x[some]), g[some]) if method == "newton" else -projected(g[some])
        wrong = (x[some] <= 0) & (go < 0)
        if wrong.any():
            free[some[wrong]] = False
            if stuck:
                break
            continue
        falls = go < 0
        border = (x[some][falls] / -go[falls]).min() if falls.any() else np.inf
        now = objective(rcc, n, x)
        t = min(1.0 if method == "newton" else 2 * step, border)
        moved = None
        while t * np.abs(go).max() > 1e-16:
            new = x.copy()
            new[some] = np.maximum(x[some] + t * go, 0)
            if t == border:
                new[some[falls][(x[some][falls] / -go[falls]) <= border]] = 0
            new = _without_dust(new)
            # a step to the border so short that the objective cannot tell it takes a state out nevertheless
            short = t == border and abs(t * (g[some] @ go)) < 1e-12 * max(1.0, abs(now))
            if short or objective(rcc, n, new) < now or (method == "newton" and t == 1 and np.abs(gradient(rcc, n, new)[some] + 1).max() < np.abs(g[some] + 1).max() / 2):
                moved = new
                break
            t /= 2
        if moved is None:
            if stuck:
                break
            stuck = True  # what is left is rounding; a state may still be missing
            continue
        x, step, stuck = moved, t, False
        free &= x > 0
    return x


def residual(rcc: np.ndarray, n: np.ndarray, x: np.ndarray) -> float:
    """How far the optimality conditions are from met, relative to the gradient: level over the states in use, no less elsewhere."""
    g = gradient(rcc, n, x)
    stationary = np.where(x > 1e-9, np.abs(g + 1), np.maximum(-(g + 1), 0))
    return float(stationary.max() / np.linalg.norm(g))


def estimated(counts: DataFrame, states: list[str] | None = None, keys: tuple[str, ...] = ("ref_id",), seen: str = "codon", least: float = 1e-6, method: str = "newton", rounds: int | None = None) -> DataFrame:
    """Frequencies of the states by ``keys`` and position, zeros left out, with coverage, residual and whether that is under ``least``.

    ``counts`` has the observation in ``seen`` and its qualities in q1, q2.. or, of single bases, q.
    A position without complete observations gets no rows: see ``at_all_sites``.
    """
    states = states or CODONS
    width = len(states[0])
    q = ["q"] if "q" in counts.columns else [f"q{i}" for i in range(1, width + 1)]
    types = dict(counts.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in (*keys, "position")), f"{seen} string, freq double, coverage long, residual double, converged boolean"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        quality, n = group[q].to_numpy(), group["n"].to_numpy(dtype=float)
        complete = (quality > 0).all(axis=1)
        start = np.zeros(len(states))
        np.add.at(start, [states.index(c) for c in group[seen][complete]], n[complete])
        some, x, off = np.array([], dtype=int), start, 0.0
        if start.sum():
            rcc = likelihoods(list(group[seen]), quality, states)
            x = solve(rcc, n, start / start.sum(), method, rounds=rounds)
            some, off = np.flatnonzero(x > 1e-9), residual(rcc, n, x)
        out = pd.DataFrame({seen: np.array([states[i] for i in some], dtype=object), "freq": x[some]})
        for i, k in enumerate((*keys, "position")):
            out.insert(i, k, group[k].iloc[0])
        return out.assign(coverage=int(n.sum()), residual=off, converged=off < least)

    return counts.groupBy(*keys, "position").applyInPandas(run, schema)


def at_all_sites(frequencies: DataFrame, sites: DataFrame, keys: tuple[str, ...] = ("ref_id",)) -> DataFrame:
    """Frequencies at every row of ``sites``: one without any has a row of frequency and coverage 0, which counts as converged."""
    dense = sites.select(*keys, "position").distinct().join(frequencies, [*keys, "position"], "left")
    return dense.fillna(0.0, ["freq", "residual"]).fillna(0, ["coverage"]).fillna(True, ["converged"])
