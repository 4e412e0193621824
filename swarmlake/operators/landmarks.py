"""Graphs and embeddings of landmarks, whose number is bounded by the groups they stand for.

Distances come from Spark; what remains is a matrix of landmarks, small enough for
one call of linear algebra. Points are placed against the landmarks afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import materialized
from .models import squared_distance


def distances(landmarks: DataFrame) -> DataFrame:
    """i, j, d for each pair of landmarks (name, x)."""
    a = landmarks.select(F.col("name").alias("i"), F.col("x").alias("xi"))
    b = landmarks.select(F.col("name").alias("j"), F.col("x").alias("xj"))
    return a.join(F.broadcast(b), F.col("i") != F.col("j")).select("i", "j", F.sqrt(squared_distance(F.col("xi"), F.col("xj"))).alias("d"))


def nearest_graph(pairs: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """Edges to all within ``threshold`` and to the k nearest, ties included, made symmetric."""
    ranked = pairs.withColumn("r", F.rank().over(Window.partitionBy("i").orderBy("d"))).filter((F.col("r") <= k) | (F.col("d") <= threshold))
    both = ranked.select("i", "j", "d").unionByName(ranked.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return both.groupBy("i", "j").agg(F.min("d").alias("d"))


def shortest_paths(edges: DataFrame) -> DataFrame:
    """Shortest paths, by min-plus joins that double their length until nothing gets shorter."""
    paths = materialized(edges)
    while True:
        left = paths.select("i", F.col("j").alias("via"), F.col("d").alias("d1"))
        right = paths.select(F.col("i").alias("via"), "j", F.col("d").alias("d2"))
        longer = left.join(right, "via").filter("i <> j").select("i", "j", (F.col("d1") + F.col("d2")).alias("d"))
        both = paths.select("i", "j", "d", F.col("d").alias("before")).unionByName(longer.withColumn("before", F.lit(None).cast("double")))
        after = materialized(both.groupBy("i", "j").agg(F.min("d").alias("d"), F.min("before").alias("before")))
        paths = after.select("i", "j", "d")
        if after.filter("before is null or d < before").isEmpty():
            return paths


def to_matrix(pairs: DataFrame) -> tuple[list, np.ndarray]:
    """Names in order and the distance matrix; no row is no edge."""
    rows = pairs.toPandas()
    names = sorted({*rows["i"], *rows["j"]})
    at = {n: k for k, n in enumerate(names)}
    out = np.full((len(names), len(names)), np.inf)
    np.fill_diagonal(out, 0)
    out[rows["i"].map(at), rows["j"].map(at)] = rows["d"]
    return names, out


def connected(d: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Adds the shortest edges between components until there is one."""
    d = d.copy()
    while True:
        reach = np.isfinite(d)
        for _ in range(len(d).bit_length()):
            reach = reach @ reach
        inside = reach[0]
        if inside.all():
            return d
        gap = np.where(inside[:, None] & ~inside[None, :], full, np.inf)
        i, j = np.unravel_index(np.argmin(gap), gap.shape)
        d[i, j] = d[j, i] = full[i, j]


def all_paths(d: np.ndarray) -> np.ndarray:
    d = d.copy()
    for k in range(len(d)):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    return d


def classical_scaling(d: np.ndarray, p: int) -> np.ndarray:
    """Points in p dimensions by the leading eigenpairs of the doubly centred squares; largest component positive."""
    centre = np.eye(len(d)) - 1 / len(d)
    values, vectors = np.linalg.eigh(-centre @ (d * d) @ centre / 2)
    order = np.argsort(-values)[:p]
    x = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    return x * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1, 1)


def _to_landmarks(x: Column, at: list) -> Column:
    """Distances of a point to the landmarks, as an array."""
    return F.array(*[F.sqrt(squared_distance(x, F.array(*[F.lit(float(v)) for v in landmark]))) for landmark in at])


def _weighted(values: Column, weights: np.ndarray) -> Column:
    total = lambda row: F.aggregate(F.zip_with(values, F.array(*[F.lit(float(w)) for w in row]), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    return F.array(*[total(row) for row in weights])


def placed(points: DataFrame, at: list, paths: np.ndarray, x: np.ndarray, near: int = 3) -> DataFrame:
    """Adds ``place``: a point's coordinates by the squares of its paths to the landmarks, over the nearest of them."""
    step = points.withColumn("__d", _to_landmarks(F.col("x"), at))
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in paths])
    reach = F.element_at(F.sort_array("__d"), min(near, len(at)))
    first = F.filter(F.arrays_zip(F.col("__d").alias("d"), rows.alias("row")), lambda e: e["d"] <= reach)
    step = step.withColumn("__first", first)
    path = F.transform(F.sequence(F.lit(1), F.lit(len(at))), lambda k: F.array_min(F.transform("__first", lambda e: e["d"] + F.element_at(e["row"], k))))
    mean = (paths * paths).mean(axis=0)
    beyond = F.zip_with(path, F.array(*[F.lit(float(m)) for m in mean]), lambda p, m: p * p - m)
    return step.withColumn("__b", beyond).withColumn("place", _weighted(F.col("__b"), -np.linalg.pinv(x) / 2)).drop("__d", "__first", "__b")


def placed_among(points: DataFrame, at: list, x: np.ndarray, near: int = 3) -> DataFrame:
    """Adds ``place``: the mean of the nearest landmarks' coordinates, each by the inverse of its distance."""
    step = points.withColumn("__d", _to_landmarks(F.col("x"), at))
    reach = F.element_at(F.sort_array("__d"), min(near, len(at)))
    step = step.withColumn("__w", F.transform("__d", lambda d: F.when(d <= reach, 1 / (d + 1e-9)).otherwise(0.0)))
    total = F.aggregate("__w", F.lit(0.0), lambda s, w: s + w)
    step = step.withColumn("__w", F.transform("__w", lambda w: w / total))
    return step.withColumn("place", _weighted(F.col("__w"), x.T)).drop("__d", "__w")


def cut_tree(merges: list[tuple[int, int, int, float]], n: int, clusters: int) -> list[int]:
    """The smallest member of each of n points' cluster, when ``clusters`` are left."""
    members = {k: [k - 1] for k in range(1, n + 1)}
    for step, (a, b, *_) in enumerate(merges[: max(0, n - clusters)], 1):
        members[n + step] = members.pop(a) + members.pop(b)
    of = {k: min(some) for some in members.values() for k in some}
    return [of[k] for k in range(n)]


def average_linkage(d: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Merges (a, b, size, distance); of equal distances the last pair by columns; new clusters are numbered on."""
    n = len(d)
    d, size, name = d.astype(float).copy(), np.ones(n), np.arange(1, n + 1)
    out = []
    for step in range(1, n):
        upper = np.where(np.triu(np.ones_like(d), 1) > 0, d, np.inf)
        low = upper.min()
        j, i = max((j, i) for i, j in zip(*np.nonzero(upper == low)))
        out.append((int(name[i]), int(name[j]), int(size[i] + size[j]), float(low)))
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i], d[i, i] = merged, merged, 0
        size[i] += size[j]
        name[i] = n + step
        d, size, name = np.delete(np.delete(d, j, 0), j, 1), np.delete(size, j), np.delete(name, j)
        last = len(name) - 1  # the new cluster stands last
        order = [k for k in range(last + 1) if k != i - (j < i)] + [i - (j < i)]
        d, size, name = d[np.ix_(order, order)], size[order], name[order]
    return out


def isotonic(y: np.ndarray) -> np.ndarray:
    """Non-decreasing least-squares fit by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v in y:
        blocks.append([float(v), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2 = blocks.pop()
            v1, n1 = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2])
    return np.concatenate([np.full(n, v) for v, n in blocks]) if blocks else np.empty(0)


def nonmetric_scaling(d: np.ndarray, x: np.ndarray, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Points whose distances keep the order of ``d``: isotonic fit and majorisation in turn; with the stress.

    Equal distances in ``d`` are in the order of those of the points, so no order among
    them is asked for. The stress never rises; the rounds end when it falls by no more
    than ``tolerance`` of itself.
    """
    i, j = np.triu_indices(len(d), 1)
    before = np.inf
    while True:
        x = x - x.mean(axis=0)
        x /= np.sqrt((x * x).sum(axis=1).mean())
        now = np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1))
        order = np.lexsort((now, d[i, j]))
        fit = np.empty_like(now)
        fit[order] = isotonic(now[order])
        stress = float(np.sqrt(((now - fit) ** 2).sum() / (now**2).sum()))
        if before - stress <= tolerance * max(stress, 1e-12):
            break
        before = stress
        b = np.zeros_like(d, dtype=float)
        b[i, j] = b[j, i] = -np.where(now > 0, fit / np.maximum(now, 1e-300), 0)
        np.fill_diagonal(b, -b.sum(axis=1))
        x = b @ x / len(d)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    x = x @ axes.T
    return x * np.where(x[np.abs(x).argmax(axis=0), np.arange(x.shape[1])] < 0, -1, 1), stress


def covariance(points: DataFrame, column: str = "x") -> np.ndarray:
    """Covariance of the components: each task adds up its points' products, one row of dimension squared numbers each."""

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, cross = 0, None, None
        for df in frames:
            if len(df):
                x = np.stack(df[column].to_numpy())
                n, total, cross = n + len(x), x.sum(0) + (0 if total is None else total), x.T @ x + (0 if cross is None else cross)
        if n:
            yield pd.DataFrame({"i": np.arange(len(total)), "n": n, "total": total, "cross": list(cross)})

    parts = points.select(column).filter(F.col(column).isNotNull()).mapInPandas(added, "i int, n long, total double, cross array<double>")
    at = parts.select("i", "n", "total", F.posexplode("cross").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    rows = at.toPandas()
    size = int(rows["i"].max()) + 1
    cross, total, n = np.zeros((size, size)), np.zeros(size), int(rows["n"].iloc[0])
    cross[rows["i"], rows["j"]] = rows["v"]
    total[rows["i"]] = rows["total"]
    return (cross - np.outer(total, total) / n) / (n - 1)


def talus(eigenvalues: np.ndarray) -> np.ndarray:
    """Half the drop in log2 from each eigenvalue to the next, those that are next to nothing left out."""
    values = eigenvalues[eigenvalues > 1e-9]
    return -np.diff(np.log2(values)) / 2


def as_rows(spark: SparkSession, names: list, x: np.ndarray, schema: str) -> DataFrame:
    return spark.createDataFrame([(n, *map(float, row)) for n, row in zip(names, x)], schema)
