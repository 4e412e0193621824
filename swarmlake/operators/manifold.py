"""Neighbour graphs, shortest paths and isomap over all points (vec_id, x).

Points are ordered by the nearest of a bounded sample of pivots and packed in that order, so
a packed row holds points that are near each other where any are. A row meets all others but
those that the triangle inequality excludes (``pairs``). So the graph is exact.
Paths are counted from landmarks, which are points far from each other, to all points at
once; a bounded matrix of landmarks is scaled, and all points are placed by their paths.

Equal points are one node, named by the smallest vec_id. Null points take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import dropped, materialized
from . import pairs
from .landmarks import _weighted, classical_scaling
from .models import squared_distance

PIVOTS = 64
BLOCK, CHUNK = 2048, 8192  # points in a packed row, and in a task that orders and packs them, about
EDGES = 1 << 21  # edges whose lengths from all landmarks are in a shuffle at once, about
DIGITS = 8  # of squared distances


def nodes(points: DataFrame) -> DataFrame:
    """node and x of each different point."""
    return points.filter("x is not null").groupBy("x").agg(F.min("vec_id").alias("node")).select("node", "x")


class Cells:
    """Points in the order of their nearest pivots: ``rows`` (node, x, cell, away), and packed."""

    def __init__(self, rows: DataFrame, n: int = PIVOTS):
        plain = materialized(rows.select("node", "x"))
        sample = plain.orderBy(F.xxhash64("node"), "node").limit(n).collect()  # the pivots, a bounded sample
        pivots = np.array([r["x"] for r in sample], dtype=float)

        def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in frames:
                d = to_pivots(df["x"], pivots)
                yield df.assign(cell=d.argmin(1), away=d.min(1))

        self.rows = materialized(plain.mapInPandas(keyed, "node long, x array<double>, cell int, away double"))
        self.size = self.rows.count()
        dropped(plain)
        self.packed = self.in_order(self.rows, {})

    def in_order(self, rows: DataFrame, fields: dict[str, str]) -> DataFrame:
        """Some of the rows, with other columns, packed in order."""
        ordered = rows.repartitionByRange(max(1, self.size // CHUNK), "cell", "away").sortWithinPartitions("cell", "away")
        return pairs.packed(ordered, fields, "node", BLOCK)


def to_pivots(x: pd.Series, pivots: np.ndarray) -> np.ndarray:
    a = np.stack(x.to_numpy())
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * a @ pivots.T, 0))


def nearest_graph(cells: Cells, k: int) -> DataFrame:
    """Edges (i, j, d) from each node to its k nearest, ties included, made symmetric."""
    both = pairs.met(cells.packed, cells.packed, ({}, {}), lambda left: pairs.KNearest(left, k), "i long, j long, d double")
    kept = both.join(_kth(both, k).withColumnRenamed("i", "of"), F.col("i") == F.col("of"), "left").filter(F.col("bound").isNull() | (F.col("d") <= F.col("bound"))).select("i", "j", "d")
    turned = kept.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")
    edges = materialized(kept.unionByName(turned).groupBy("i", "j").agg(F.min("d").alias("d")))
    dropped(both)
    return edges


def _kth(edges: DataFrame, k: int) -> DataFrame:
    """i and bound, the k-th least distance; no row for fewer."""
    place = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return edges.withColumn("place", place).filter(F.col("place") == k).select("i", F.col("d").alias("bound"))


def components(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """node and label, the smallest node that it is connected with."""
    before = materialized(rows.select("node", F.col("node").alias("label")))
    while True:
        labels = before.select("node", "label")
        known = labels.select(F.col("node").alias("of"), F.col("label").alias("near"))
        seen = edges.join(known, F.col("i") == F.col("of")).groupBy("j").agg(F.min("near").alias("near"))
        hooked = materialized(labels.join(seen, F.col("node") == F.col("j"), "left").select("node", "label", F.least("label", "near").alias("new")))
        up = hooked.select(F.col("node").alias("parent"), F.col("new").alias("up"))
        after = materialized(hooked.join(up, F.col("new") == F.col("parent")).select("node", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved")))
        dropped(before, hooked)
        if after.filter("moved").isEmpty():
            return after.select("node", "label")
        before = after


def connected(edges: DataFrame, cells: Cells) -> DataFrame:
    """Adds the shortest edge from each component but the largest to any other, until there is one."""
    fields, given = {"label": "<i8"}, edges
    while True:
        labels = components(edges, cells.rows)
        sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
        largest = sizes.orderBy(F.desc("n"), "label").first()
        if largest is None or sizes.limit(2).count() < 2:
            return edges
        named = cells.rows.join(labels.select(F.col("node").alias("of"), "label"), F.col("node") == F.col("of")).drop("of")
        offered = cells.in_order(named, fields)
        asked = cells.in_order(named.filter(F.col("label") != largest["label"]), fields)
        met = pairs.met(asked, offered, (fields, fields), lambda left: pairs.Nearest(left, apart="label"), "vec_id long, nearest long, d2 double")
        found = met.join(labels, F.col("vec_id") == F.col("node"))
        new = found.groupBy("label").agg(F.min(F.struct(F.sqrt("d2").alias("d"), F.least("vec_id", "nearest").alias("a"), F.greatest("vec_id", "nearest").alias("b"))).alias("e")).select("e.a", "e.b", "e.d")
        new = materialized(new.distinct())
        both = new.select(F.col("a").alias("i"), F.col("b").alias("j"), "d").unionByName(new.select(F.col("b").alias("i"), F.col("a").alias("j"), "d"))
        more = materialized(edges.unionByName(both).groupBy("i", "j").agg(F.min("d").alias("d")))
        dropped(labels, offered, asked, met, new, *([] if edges is given else [edges]))
        edges = more


def far_apart(rows: DataFrame, n: int) -> list:
    """Rows (node, x) of n landmarks: the smallest node, then always the one farthest from those before (ties: the smaller)."""
    chosen = [rows.orderBy("node").first()]
    at = lambda r: squared_distance(F.col("x"), F.array(*[F.lit(float(v)) for v in r["x"]]))
    while len(chosen) < n:
        away = F.least(*[at(r) for r in chosen]) if len(chosen) > 1 else at(chosen[0])
        last = rows.agg(F.min_by(F.struct("node", "x", away.alias("away")), F.struct(-F.round(away, DIGITS), F.col("node"))).alias("r")).first()["r"]
        if not last["away"] > 0:
            break
        chosen.append(last)
    return chosen


def paths(edges: DataFrame, rows: DataFrame, sources: list[int]) -> DataFrame:
    """node and d, its shortest paths to all ``sources``, infinite where there is none: rounds of joins until nothing gets shorter.

    Steps along edges are taken in turns, by their ends, so that the lengths on their way
    are no more than those of ``EDGES`` edges or so.
    """
    state = materialized(rows.select("node", F.array(*[F.when(F.col("node") == s, 0.0).otherwise(float("inf")) for s in sources]).alias("d"), F.col("node").isin(*sources).alias("moved")))
    places = range(len(sources))
    turns = max(1, -(-edges.count() // EDGES))
    while True:
        active = state.filter("moved").select(F.col("node").alias("of"), F.col("d").alias("from"))
        parts = []
        for turn in range(turns):
            here = lambda c: F.pmod(F.xxhash64(c), F.lit(turns)) == turn  # noqa: E731, B023
            step = edges.filter(here("j")).join(active, F.col("i") == F.col("of"))
            shorter = step.groupBy("j").agg(F.array(*[F.min(F.col("from")[k] + F.col("d")) for k in places]).alias("by"))
            least = F.when(F.col("by").isNull(), F.col("d")).otherwise(F.zip_with("d", "by", lambda a, b: F.least(a, b)))
            after = state.filter(here("node")).join(shorter, F.col("node") == F.col("j"), "left").select("node", "d", least.alias("new"))
            parts.append(materialized(after.select("node", F.col("new").alias("d"), (F.col("new") != F.col("d")).alias("moved"))))
        dropped(state)
        state = reduce(DataFrame.unionByName, parts)
        if state.filter("moved").isEmpty():
            return state.select("node", "d")


def isomap(points: DataFrame, k: int, dimensions: int = 2, landmarks: int = 12) -> DataFrame:
    """``points`` with ``place``: coordinates by paths over the graph of k nearest neighbours of all points.

    Scaling the landmarks gives the axes; every point lies where the squares of its
    paths to them put it, landmarks themselves included.
    """
    cells = Cells(nodes(points))
    rows = cells.rows
    edges = connected(nearest_graph(cells, k), cells)
    sources = [r["node"] for r in far_apart(rows, landmarks)]
    reached = paths(edges, rows, sources)
    dropped(edges, cells.packed)
    of = {r["node"]: r["d"] for r in reached.filter(F.col("node").isin(*sources)).collect()}  # one row a landmark
    between = np.array([of[s] for s in sources])
    x = classical_scaling((between + between.T) / 2, dimensions)
    mean = (between * between).mean(axis=0)
    beyond: Column = F.zip_with("d", F.array(*[F.lit(float(m)) for m in mean]), lambda p, m: p * p - m)
    placed = reached.select(F.col("node").alias("of"), _weighted(beyond, -np.linalg.pinv(x) / 2).alias("place"))
    named = rows.select("node", *[h.alias(f"is_{i}") for i, h in enumerate(_hashes())])
    placed = materialized(named.join(placed, F.col("node") == F.col("of")).select("is_0", "is_1", "place"))
    dropped(rows, reached)
    hashed = points.select("*", *[h.alias(f"at_{i}") for i, h in enumerate(_hashes())]).filter("x is not null")
    return hashed.join(placed, (F.col("at_0") == F.col("is_0")) & (F.col("at_1") == F.col("is_1"))).drop("at_0", "at_1", "is_0", "is_1")


def _hashes() -> tuple[Column, Column]:
    """Two hashes of 64 bits, by which equal points meet; points that differ share both less than once in 2^127 pairs."""
    return F.xxhash64("x"), F.xxhash64(F.lit("twice"), "x")
