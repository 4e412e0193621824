"""Fitness models on points (id, x, group, fitness): kernels, neighbours, groups.

Kernels and neighbours learn from a training set of proven size (group centres),
so each point meets few others, or a stated set of queries meets all points, block
by block; groups are plain aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import materialized
from . import pairs


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)


def differing(x: list[Column], y: list[Column]) -> Column:
    """How many of the paired columns differ."""
    return sum((F.when(a.eqNullSafe(b), 0).otherwise(1) for a, b in zip(x, y)), F.lit(0))


def centres(points: DataFrame) -> DataFrame:
    """Mean point and fitness of each group, one row a group."""
    at = points.select("label", "fitness", F.posexplode("x").alias("i", "value"))
    means = at.groupBy("label", "i").agg(F.avg("value").alias("m")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s"))
    fit = points.groupBy("label").agg(F.avg("fitness").alias("centre_fitness"))
    return means.join(fit, "label").select(F.col("label").alias("centre"), F.col("s.m").alias("centre_x"), "centre_fitness")


def to_centres(points: DataFrame, train: DataFrame) -> DataFrame:
    """Squared distance of each point to each centre; ``train`` has one row a group and goes to all tasks."""
    return points.join(F.broadcast(train)).withColumn("d2", squared_distance(F.col("x"), F.col("centre_x")))


def nearest(distances: DataFrame) -> DataFrame:
    """Fitness of the nearest centre; ties: the smallest name."""
    return distances.groupBy("vec_id").agg(F.min_by(F.struct("centre", "centre_fitness"), F.struct("d2", "centre")).alias("n")).select("vec_id", F.col("n.centre").alias("centre"), F.col("n.centre_fitness").alias("predicted"))


def kernel_smoothed(distances: DataFrame, sigma: float) -> DataFrame:
    """Gaussian weights of the distances less the least of them."""
    least = distances.groupBy("vec_id").agg(F.collect_list(F.struct("d2", "centre_fitness")).alias("c")).withColumn("low", F.array_min("c.d2"))
    weight = lambda e: F.exp((F.col("low") - e["d2"]) / (2 * sigma * sigma))
    total = lambda f: F.aggregate("c", F.lit(0.0), lambda s, e: s + f(e))
    return least.select("vec_id", (total(lambda e: weight(e) * e["centre_fitness"]) / total(weight)).alias("predicted"))


def kernel_errors(points: DataFrame, distances: DataFrame, sigmas: list[float]) -> DataFrame:
    """Mean squared error of the kernel of each width; the least of them is the width to use."""
    wide = distances.groupBy("vec_id").agg(F.collect_list(F.struct("d2", "centre_fitness")).alias("c")).withColumn("low", F.array_min("c.d2"))
    each = wide.join(points.select("vec_id", "fitness"), "vec_id").withColumn("sigma", F.explode(F.array(*[F.lit(s) for s in sigmas])))
    weight = lambda e: F.exp((F.col("low") - e["d2"]) / (2 * F.col("sigma") * F.col("sigma")))
    total = lambda f: F.aggregate("c", F.lit(0.0), lambda s, e: s + f(e))
    error = total(lambda e: weight(e) * e["centre_fitness"]) / total(weight) - F.col("fitness")
    return each.groupBy("sigma").agg(F.avg(error * error).alias("mse"))


FITNESS = {"fitness": "<f8"}


def _both(queries: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    offered = pairs.packed(points, FITNESS)
    return offered if queries is points else pairs.packed(queries, FITNESS), offered


def nearest_of_all(queries: DataFrame, points: DataFrame) -> DataFrame:
    """The nearest other point of each query and its fitness; ties of the squared distance, to 8 digits: the smallest id."""
    met = pairs.met(*_both(queries, points), (FITNESS, FITNESS), lambda left: pairs.Nearest(left, also="fitness"), "vec_id long, nearest long, d2 double, predicted double")
    return met.groupBy("vec_id").agg(F.min(F.struct("d2", "nearest", "predicted")).alias("n")).select("vec_id", "n.nearest", "n.d2", "n.predicted")


def smoothed_by_all(queries: DataFrame, points: DataFrame, sigma: float) -> DataFrame:
    """Gaussian weights of all other points; parts of them add up on the scale of the nearest."""
    met = pairs.met(*_both(queries, points), (FITNESS, FITNESS), lambda left: pairs.Smoothed(left, sigma), "vec_id long, low double, weight double, total double")
    found = met.groupBy("vec_id").agg(F.min("low").alias("least"), F.collect_list(F.struct("low", "weight", "total")).alias("parts"))
    scale = lambda p: F.exp((F.col("least") - p["low"]) / (2 * sigma * sigma))
    total = lambda f: F.aggregate("parts", F.lit(0.0), lambda s, p: s + p[f] * scale(p))
    return found.select("vec_id", (total("total") / total("weight")).alias("predicted"))


SHEET = "x double, y double, low double, weight double, total double, near double"


def landscape(points: DataFrame, xs: list[float], ys: list[float], sigma: float, transparency: float = 0.05) -> DataFrame:
    """Kernel fitness ``z`` at each place (x, y) of a grid, ``alpha`` and ``cover``, the share of it to be shown.

    ``points`` are (x, y, fitness). ``alpha`` is log10 of the summed weights of all
    points, of a width of ``transparency`` times the grid's shorter side: the grid ends
    where it falls. A task adds up its points for all places, on the scale of the nearest,
    and sends one row a place; rows of several tasks add up on their common scale. A point
    that cannot weigh in any digit beside the nearest so far is left out.
    """
    narrow = transparency * min(max(xs) - min(xs), max(ys) - min(ys))
    places = np.array([(x, y) for x in xs for y in ys], dtype=float)
    cut = 80.0 * max(sigma, narrow) ** 2  # beyond the least squared distance: weights under e-40

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low = np.full(len(places), np.inf)
        sums = np.zeros((3, len(places)))  # weights, weighted fitness, narrow weights
        for df in frames:
            for a in range(0, len(df), 1024):
                some = df.iloc[a : a + 1024]
                at, fitness = some[["x", "y"]].to_numpy(dtype=float), some["fitness"].to_numpy(dtype=float)
                d = (places[:, None, 0] - at[:, 0]) ** 2 + (places[:, None, 1] - at[:, 1]) ** 2
                new = np.minimum(low, d.min(1))
                reach = np.flatnonzero((d - new[:, None] <= cut).any(axis=0))
                with np.errstate(invalid="ignore"):
                    scale = [np.where(np.isfinite(low), np.exp((new - low) / (2 * s * s)), 0) for s in (sigma, narrow)]
                wide, close = (np.exp((new[:, None] - d[:, reach]) / (2 * s * s)) for s in (sigma, narrow))
                sums = np.stack([sums[0] * scale[0] + wide.sum(1), sums[1] * scale[0] + wide @ fitness[reach], sums[2] * scale[1] + close.sum(1)])
                low = new
        if np.isfinite(low).all():
            yield pd.DataFrame({"x": places[:, 0], "y": places[:, 1], "low": low, "weight": sums[0], "total": sums[1], "near": sums[2]})

    known = points.select("x", "y", "fitness").filter("x is not null and y is not null and fitness is not null")
    parts = materialized(known.mapInPandas(added, SHEET))
    least = parts.groupBy(F.col("x").alias("gx"), F.col("y").alias("gy")).agg(F.min("low").alias("least"))
    met = parts.join(least, (F.col("x") == F.col("gx")) & (F.col("y") == F.col("gy")))
    on = lambda s: F.exp((F.col("least") - F.col("low")) / (2 * s * s))
    sheet = met.groupBy("x", "y", "least").agg(*[F.sum(F.col(c) * on(s)).alias(c) for c, s in (("weight", sigma), ("total", sigma), ("near", narrow))])
    alpha = (F.log("near") - F.col("least") / (2 * narrow * narrow)) / float(np.log(10.0))
    shown = sheet.select("x", "y", (F.col("total") / F.col("weight")).alias("z"), alpha.alias("alpha"))
    return shown.withColumn("cover", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("alpha") + 1.5)))


def in_test(split: Column, vec_id: Column, share: float) -> Column:
    """Whether a point is tested, not trained on, in a split: by a hash, so about ``share`` of the points are."""
    return F.substring(F.md5(F.concat_ws("-", F.lit("split"), split, vec_id).cast("binary")), 1, 8) < F.lit(f"{int(share * (1 << 32)):08x}")


def powers(e: np.ndarray, widths: list[float]) -> Iterator[tuple[int, np.ndarray]]:
    """The place of each width and exp(e / width), the widest first, in an array that the next one may use; a quarter of a width takes a fourth power."""
    order = sorted(range(len(widths)), key=lambda k: -widths[k])
    w = None
    for before, k in zip([None, *order], order):
        if before is not None and widths[before] == 4 * widths[k]:
            w *= w
            w *= w
        else:
            w = np.exp(e / widths[k])
        yield k, w


class SplitSums:
    """Of each tested point of each split: the nearest trained point, and for each width the weights of all others.

    The weights are on the scale of ``low2``, the second least squared distance so far,
    so they are exact however far the others are.
    """

    def __init__(self, left: pairs.Block, sigmas: list[float]):
        self.left, self.widths = left, [2 * s * s for s in sigmas]
        self.rows = [np.flatnonzero(tests) for tests in left.of["tests"].T]
        make = lambda n: {"low": np.full(n, np.inf), "nearest": np.zeros(n, dtype=np.int64), "near_fit": np.zeros(n), "low2": np.full(n, np.inf)}
        self.of = [make(len(r)) | {c: np.zeros((len(r), len(sigmas))) for c in ("rest", "rest_fit")} for r in self.rows]

    def add(self, right: pairs.Block) -> None:
        untrained = np.where(right.of["tests"].T > 0, np.inf, 0.0)
        shared = np.isin(self.left.ids, right.ids)
        for t in pairs.tiles(len(self.left.ids)):
            cuts = [np.searchsorted(r, (t.start, t.stop)) for r in self.rows]
            asked = np.unique(np.concatenate([r[a:b] for r, (a, b) in zip(self.rows, cuts)]))
            if not len(asked):
                continue
            d = np.round(pairs.squared(self.left, asked, right), pairs.DIGITS)
            if shared[asked].any():
                d[self.left.ids[asked, None] == right.ids] = np.inf
            for s, (a, b) in enumerate(cuts):
                if b > a:
                    self._merge(self.of[s], slice(a, b), d[np.searchsorted(asked, self.rows[s][a:b])] + untrained[s], right)

    def _merge(self, of: dict[str, np.ndarray], at: slice, d: np.ndarray, right: pairs.Block) -> None:
        fitness, each = right.of["fitness"][:, 0], np.arange(len(d))
        j = d.argmin(1)
        low, near, fit = d[each, j].copy(), right.ids[j], fitness[j]
        d[each, j] = np.inf
        low2 = d.min(1)
        closer = (low < of["low"][at]) | ((low == of["low"][at]) & (near < of["nearest"][at]))
        # the farther one of the two nearest goes to the rest
        other, other_fit = np.where(closer, of["low"][at], low), np.where(closer, of["near_fit"][at], fit)
        new2 = np.minimum(np.minimum(of["low2"][at], low2), other)
        np.subtract(np.where(np.isfinite(low2), low2, 0)[:, None], d, out=d)
        both = np.stack([np.ones(len(fitness)), fitness], axis=1)
        for k, w in powers(d, self.widths):
            rest = w @ both
            old, new, one = (pairs.decay(new2, x, self.widths[k]) for x in (of["low2"][at], low2, other))
            of["rest"][at, k] = of["rest"][at, k] * old + rest[:, 0] * new + one
            of["rest_fit"][at, k] = of["rest_fit"][at, k] * old + rest[:, 1] * new + one * other_fit
        of["low2"][at] = new2
        for name, value in (("low", low), ("nearest", near), ("near_fit", fit)):
            of[name][at] = np.where(closer, value, of[name][at])

    def found(self) -> dict[str, np.ndarray]:
        some = [np.isfinite(of["low"]) for of in self.of]
        columns = {"vec_id": [self.left.ids[r] for r in self.rows], "split": [np.full(len(r), s, dtype=np.int32) for s, r in enumerate(self.rows)], "truth": [self.left.of["fitness"][r, 0] for r in self.rows]}
        columns |= {c: [of[c] for of in self.of] for c in self.of[0]}
        return {c: np.concatenate([x[k] for x, k in zip(v, some)]) for c, v in columns.items()}


TESTED = FITNESS | {"tests": "u1"}
SUMS = "vec_id long, split int, truth double, low double, nearest long, near_fit double, low2 double, rest array<double>, rest_fit array<double>"


def _dealt(points: DataFrame, splits: int, share: float) -> DataFrame:
    """Packed points with a flag for each split in which they are tested."""
    flags = F.transform(F.sequence(F.lit(0), F.lit(splits - 1)), lambda s: in_test(s, F.col("vec_id"), share).cast("byte"))
    return pairs.packed(points.withColumn("tests", flags), TESTED)


def split_sums(dealt: DataFrame, sigmas: list[float]) -> DataFrame:
    """A row for each tested point and split: vec_id, split, truth, low and nearest, and arrays, a value a width.

    ``weight`` and ``total`` are the sums of all weights, and of weighted fitness, on the scale of the
    nearest trained point; ``without_nearest`` is what is predicted without that point.
    """
    met = pairs.met(dealt, dealt, (TESTED, TESTED), lambda left: SplitSums(left, sigmas), SUMS)
    parts = met.groupBy("vec_id", "split").agg(F.first("truth").alias("truth"), F.collect_list(F.struct("low", "nearest", "near_fit", "low2", "rest", "rest_fit")).alias("parts"))
    first = parts.withColumn("of", F.array_min("parts"))
    own = lambda p: p["nearest"] == F.col("of.nearest")
    first = first.withColumn("least2", F.array_min(F.transform("parts", lambda p: F.when(own(p), p["low2"]).otherwise(p["low"]))))
    weights, totals, without = [], [], []
    for k, sigma in enumerate(sigmas):
        on_scale = lambda d, width=2 * sigma * sigma: F.when(d == float("inf"), 0.0).otherwise(F.exp((F.col("least2") - d) / width))
        rest = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["rest"][k] * on_scale(p["low2"]) + F.when(own(p), 0.0).otherwise(on_scale(p["low"])))  # noqa: B023
        rest_fit = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["rest_fit"][k] * on_scale(p["low2"]) + F.when(own(p), 0.0).otherwise(p["near_fit"] * on_scale(p["low"])))  # noqa: B023
        near = F.when(F.col("least2") == float("inf"), 0.0).otherwise(F.exp((F.col("of.low") - F.col("least2")) / (2 * sigma * sigma)))
        weights.append(1 + rest * near)
        totals.append(F.col("of.near_fit") + rest_fit * near)
        without.append(F.when(rest > 0, rest_fit / rest))
    return first.select("vec_id", "split", "truth", F.col("of.low").alias("low"), F.col("of.nearest").alias("nearest"), F.array(*weights).alias("weight"), F.array(*totals).alias("total"), F.array(*without).alias("without_nearest"))


def _errors(sums: DataFrame, sigmas: list[float]) -> DataFrame:
    """vec_id, split, sigma (its place) and e, the squared error, of each tested point."""
    error = lambda k: F.col("total")[k] / F.col("weight")[k] - F.col("truth")
    return sums.select("vec_id", "split", F.posexplode(F.array(*[error(k) * error(k) for k in range(len(sigmas))])).alias("sigma", "e"))


def _named(df: DataFrame, sigmas: list[float]) -> DataFrame:
    return df.withColumn("sigma", F.element_at(F.array(*[F.lit(s) for s in sigmas]), F.col("sigma") + 1))


def split_errors(points: DataFrame, sigmas: list[float], splits: int = 100, share: float = 0.1) -> DataFrame:
    """Mean squared error of each width over repeated random sub-sampling, and whether it is the least (ties: the smaller width)."""
    of_split = _errors(split_sums(_dealt(points, splits, share), sigmas), sigmas).groupBy("split", "sigma").agg(F.avg("e").alias("mse"))
    errors = materialized(_named(of_split.groupBy("sigma").agg(F.avg("mse").alias("mse")), sigmas))  # one row a width
    best = errors.agg(F.min(F.struct("mse", "sigma")).alias("best"))  # one row
    return errors.join(F.broadcast(best)).select("sigma", "mse", (F.col("sigma") == F.col("best.sigma")).alias("best"))


class TakenOut:
    """For each point, split in which it is trained on, and width: the squared errors of the tested points without it."""

    def __init__(self, left: pairs.Block, sigmas: list[float]):
        self.left, self.widths = left, [2 * s * s for s in sigmas]
        shape = (*left.of["tests"].shape, len(sigmas))
        self.sums, self.counts = np.zeros(shape), np.zeros(shape, dtype=np.int64)

    def add(self, right: pairs.Block) -> None:
        truth, splits, n = right.of["truth"][:, 0], self.sums.shape[1], len(self.widths)
        weights, totals, without = (right.of[c].reshape(-1, splits, n) for c in ("weight", "total", "without_nearest"))
        for t in pairs.tiles(len(self.left.ids)):
            d = np.round(pairs.squared(self.left, t, right), pairs.DIGITS)
            for s in range(splits):
                u = np.flatnonzero(np.isfinite(right.of["low"][:, s]))
                j = np.flatnonzero(self.left.of["tests"][t, s] == 0)
                if not len(u) or not len(j):
                    continue
                at, fitness = j + t.start, self.left.of["fitness"][j + t.start]
                e = right.of["low"][u, s] - d[np.ix_(j, u)]
                nearest = np.nonzero(self.left.ids[at, None] == right.of["nearest"][u, s])
                for k, w in powers(e, self.widths):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        predicted = (totals[u, s, k] - w * fitness) / (weights[u, s, k] - w)
                    predicted[nearest] = without[u, s, k][nearest[1]]
                    predicted -= truth[u]
                    predicted *= predicted
                    known = np.isfinite(predicted)
                    self.sums[at, s, k] += np.where(known, predicted, 0).sum(1)
                    self.counts[at, s, k] += known.sum(1)

    def found(self) -> dict[str, np.ndarray]:
        n = len(self.left.ids)
        return {"vec_id": self.left.ids, "sums": self.sums.reshape(n, -1), "counts": self.counts.reshape(n, -1)}


def widths_without_one(points: DataFrame, sigmas: list[float], splits: int = 100, share: float = 0.1) -> DataFrame:
    """For each point, the width of least error over the splits when that point is left out: vec_id, sigma, mse.

    Left out of the tests, its own error is taken from the mean; left out of the training,
    its weight is taken from each tested point's sums, or, where it is the nearest and the
    difference would be rounding, the sums without it are used. A split in which it is the
    only tested point, or leaves nothing to train on, does not count.
    """
    dealt = _dealt(points, splits, share)
    sums = materialized(split_sums(dealt, sigmas))
    errors = _errors(sums, sigmas)
    totals = errors.groupBy("split", "sigma").agg(F.sum("e").alias("sum"), F.count("*").alias("n"))  # splits x widths
    tested = errors.join(F.broadcast(totals), ["split", "sigma"]).filter("n > 1").select("vec_id", "split", "sigma", ((F.col("sum") - F.col("e")) / (F.col("n") - 1)).alias("mse"))
    # the sums of each tested point, a value a split (and width); no number where it is not tested
    of_split = sums.groupBy("vec_id").agg(F.first("truth").alias("truth"), F.map_from_entries(F.collect_list(F.struct("split", F.struct("low", "nearest", "weight", "total", "without_nearest")))).alias("of"))
    each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(splits - 1)), f)
    none = F.array(*[F.lit(None).cast("double")] * len(sigmas))
    at = lambda c, other: each(lambda s: F.coalesce(F.try_element_at("of", s)[c], other))
    stats = of_split.select(
        "vec_id", "truth", each(lambda s: F.try_element_at("of", s)["low"]).alias("low"), at("nearest", F.lit(0)).alias("nearest"),
        *[F.flatten(at(c, none)).alias(c) for c in ("weight", "total", "without_nearest")],
    )
    fields = {"truth": "<f8", "low": "<f8", "nearest": "<i8", "weight": "<f8", "total": "<f8", "without_nearest": "<f8"}
    asked = pairs.packed(points.select("vec_id", "x").join(stats, "vec_id"), fields)
    met = pairs.met(dealt, asked, (TESTED, fields), lambda left: TakenOut(left, sigmas), "vec_id long, sums array<double>, counts array<long>")
    n = splits * len(sigmas)
    added = met.groupBy("vec_id").agg(F.collect_list(F.arrays_zip("sums", "counts")).alias("parts"))
    total = lambda k, c: F.aggregate("parts", F.lit(0).cast("double" if c == "sums" else "long"), lambda s, p: s + p[k][c])
    means = F.array(*[F.when(total(k, "counts") > 0, total(k, "sums") / total(k, "counts")) for k in range(n)])
    trained = added.select("vec_id", F.posexplode(means).alias("place", "mse")).filter("mse is not null")
    trained = trained.select("vec_id", F.expr(f"cast(place div {len(sigmas)} as int)").alias("split"), (F.col("place") % len(sigmas)).alias("sigma"), "mse")
    mean = tested.unionByName(trained).groupBy("vec_id", "sigma").agg(F.avg("mse").alias("mse"))
    least = _named(mean, sigmas).groupBy("vec_id").agg(F.min(F.struct("mse", "sigma")).alias("m"))
    return least.select("vec_id", "m.sigma", "m.mse")


def categorical_nearest(queries: DataFrame, known: DataFrame, columns: list[str], key: str) -> DataFrame:
    """The mean fitness of all rows of ``known`` that differ from a query in the fewest ``columns``: key, differing, ties, predicted.

    Rows within r differing columns agree in one of r + 1 groups of columns, so such a
    group's values name where they meet; r grows until each query has found its nearest,
    and only those without go on. Equal rows of ``known`` are one, and a query is not
    compared with its own key. Nulls are values. Rows that agree in no column with any
    other differ in all: those take the mean of all others.
    """
    own = F.struct(*columns)
    asked = materialized(queries.select(F.col(key), own.alias("x")))
    rows = materialized(known.groupBy(own.alias("y")).agg(F.sum("fitness").alias("total"), F.count("fitness").alias("n")))
    mine = known.select(F.col(key).alias("own"), own.alias("own_y"), F.col("fitness").alias("own_fitness")).filter("own is not null and own_fitness is not null")
    mine = mine.groupBy("own", "own_y").agg(F.sum("own_fitness").alias("own_total"), F.count("*").alias("own_n"))
    out = []
    for radius in range(len(columns)):
        groups = [columns[i :: radius + 1] for i in range(radius + 1)]
        named = lambda of: F.array(*[F.xxhash64(F.lit(i), *[F.col(of)[c] for c in g]) for i, g in enumerate(groups)])  # noqa: E731, B023
        left = asked.withColumn("name", F.explode(named("x")))
        right = rows.withColumn("name", F.explode(named("y")))
        d = differing([F.col("x")[c] for c in columns], [F.col("y")[c] for c in columns])
        met = left.join(right, "name").withColumn("d", d).filter(F.col("d") <= radius).dropDuplicates([key, "y"])
        met = met.join(mine, (F.col(key) == F.col("own")) & F.col("y").eqNullSafe(F.col("own_y")), "left").select(key, "d", "total", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("own_total", "own_n")])
        sums = met.groupBy(key, "d").agg(F.sum(F.col("total") - F.col("own_total")).alias("total"), F.sum(F.col("n") - F.col("own_n")).alias("n")).filter("n > 0")
        found = materialized(sums.groupBy(key).agg(F.min(F.struct("d", "total", "n")).alias("m")).select(key, "m.*"))
        out.append(found)
        asked = materialized(asked.join(found, key, "left_anti"))
        if asked.isEmpty():
            break
    else:
        every = rows.agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        rest = asked.join(F.broadcast(every)).join(mine, F.col(key) == F.col("own"), "left")
        out.append(rest.select(key, F.lit(len(columns)).alias("d"), (F.col("total") - F.coalesce("own_total", F.lit(0.0))).alias("total"), (F.col("n") - F.coalesce("own_n", F.lit(0))).alias("n")).filter("n > 0"))
    return reduce(DataFrame.unionByName, out).select(key, F.col("d").alias("differing"), F.col("n").alias("ties"), (F.col("total") / F.col("n")).alias("predicted"))


def group_means(points: DataFrame, leave_one_out: bool = False) -> DataFrame:
    """Mean fitness of a point's group, without its own if asked; null for a group of one."""
    sums = points.groupBy("label").agg(F.sum("fitness").alias("s"), F.count("fitness").alias("n"))
    joined = points.join(sums, "label")
    out = F.when(F.col("n") > 1, (F.col("s") - F.col("fitness")) / (F.col("n") - 1)) if leave_one_out else F.col("s") / F.col("n")
    return joined.select("vec_id", "label", out.alias("predicted"))


def variance_unexplained(pairs: DataFrame) -> DataFrame:
    """Squared errors of ``predicted`` over squared deviations of ``truth``, rows without either left out."""
    some = pairs.filter("predicted is not null and truth is not null")
    errors = F.sum((F.col("predicted") - F.col("truth")) * (F.col("predicted") - F.col("truth")))
    return some.agg((errors / (F.var_pop("truth") * F.count("*"))).alias("unexplained"), F.count("*").alias("n"))
