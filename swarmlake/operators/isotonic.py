"""Isotonic regression over distributed rows: pooled by ranges, then cut apart at thresholds.

Adjacent violators pool in any order, so each range of rows pools on its own and only
its blocks go on. Groups with many blocks are then cut into segments that do not depend
on each other: where the sum of (y - t) has its minimum, the fit crosses t. Between
two cuts the fit lies between their thresholds, so blocks of a range below or above
both count as one. Rounds of cuts go on until each segment is small enough for a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import materialized

#: Blocks of a segment that one task pools.
LIMIT = 1 << 16
#: Thresholds of a round.
CUTS = 63

BLOCK = "g string, seg decimal(38, 0), r0 long, p0 long, r1 long, s double, n double"


def pooled(s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First members, sums and weights of the blocks into which adjacent violators pool; equal means pool too."""
    at, sums, weights = [], [], []
    for k, (a, b) in enumerate(zip(s.tolist(), n.tolist())):
        while sums and sums[-1] * b >= a * weights[-1]:
            a, b, k = a + sums.pop(), b + weights.pop(), at.pop()
        at.append(k)
        sums.append(a)
        weights.append(b)
    return np.array(at, dtype=np.int64), np.array(sums), np.array(weights)


def _runs(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where rows of equal keys start and end."""
    if len(keys[0]):
        new = np.zeros(len(keys[0]) - 1, dtype=bool)
        for k in keys:
            new |= k[1:] != k[:-1]
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(keys[0])]
        yield from zip(edges, edges[1:])


def _placed(rows: DataFrame) -> DataFrame:
    """Rows (g, x, y, row) in order, with the range they are in, and the place there of the first row of their block."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for piece, batch in enumerate(b for b in batches if b.num_rows):
            g, y = batch.column("g").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)
            block = np.empty(len(y), dtype=np.int64)
            for a, b in _runs(g):
                at, _, _ = pooled(y[a:b], np.ones(b - a))
                block[a:b] = a + np.repeat(at, np.diff([*at, b - a]))
            same = lambda v: pa.array(np.full(len(y), v, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, same(part), same(piece), pa.array(block)], [*batch.schema.names, "part", "piece", "block"])

    schema = rows.schema.add("part", "long").add("piece", "long").add("block", "long")
    found = materialized(rows.repartitionByRange("g", "x", "y").sortWithinPartitions("g", "x", "y").mapInArrow(place, schema))
    sizes = found.groupBy("part").agg((F.max("piece") + 1).alias("pieces"))  # one row a task
    before = F.coalesce(F.sum("pieces").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("range", F.col("before") + F.col("piece")).drop("part", "piece", "before")


def _ranges(blocks: DataFrame) -> DataFrame:
    """Blocks in order, pooled within each batch, with the batch's number ``q``."""

    def pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        for piece, df in enumerate(f for f in frames if len(f)):
            for a, b in _runs(df["g"].to_numpy(), df["seg"].to_numpy()):
                yield _pool(df.iloc[a:b]).assign(q=(part << 32) + piece)

    return blocks.repartitionByRange("g", "seg", "r0", "p0").sortWithinPartitions("g", "seg", "r0", "p0").mapInPandas(pool, BLOCK + ", q long")


def _pool(df: pd.DataFrame) -> pd.DataFrame:
    at, s, n = pooled(df["s"].to_numpy(), df["n"].to_numpy())
    last = np.append(at[1:], len(df)) - 1
    return df.iloc[at][["g", "seg", "r0", "p0"]].assign(r1=df["r1"].to_numpy()[last], s=s, n=n)


def _minima(blocks: DataFrame) -> DataFrame:
    """For each range and threshold: sums of the range, and where in it the sum of (y - t) is least, and that minimum."""

    def least(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["r0", "p0"])
        t = np.asarray(df["t"].iloc[0], dtype=float)
        s, n = df["s"].to_numpy(), df["n"].to_numpy()
        at = np.searchsorted(s / n, t, "left")
        total = lambda v: np.concatenate([[0.0], np.cumsum(v)])
        first = df.iloc[np.minimum(at, len(df) - 1)]
        inside = at < len(df)
        return pd.DataFrame({
            "g": df["g"].iloc[0], "seg": df["seg"].iloc[0], "q": df["q"].iloc[0], "k": np.arange(len(t)), "low": total(s)[at] - t * total(n)[at], "sum": s.sum() - t * n.sum(),
            "r": np.where(inside, first["r0"], df["r1"].iloc[-1]), "p": np.where(inside, first["p0"], np.iinfo(np.int64).max),
        })

    return blocks.groupBy("g", "seg", "q").applyInPandas(least, "g string, seg decimal(38, 0), q long, k int, low double, sum double, r long, p long")


def _cut(blocks: DataFrame) -> DataFrame:
    """One round: blocks of a segment in smaller ones, those out of a segment's bounds as one for each range."""
    ranged = materialized(_ranges(blocks))
    mean = F.col("s") / F.col("n")
    bounds = materialized(ranged.groupBy("g", "seg").agg(F.percentile_approx(mean, [(k + 1) / (CUTS + 1) for k in range(CUTS)], 2000).alias("t")))
    lows = materialized(_minima(ranged.join(bounds, ["g", "seg"])))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("g", "seg", "k").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    # The start of a segment is as good a place as any in it: its sum is 0.
    options = lows.select("g", "seg", "k", (before + F.col("low")).alias("low"), F.struct("r", "p").alias("at"))
    best = options.groupBy("g", "seg", "k").agg(F.min(F.struct("low", "at")).alias("m"))
    place = F.when(F.col("m.low") < 0, F.col("m.at")).otherwise(F.struct(F.lit(-1).cast("long").alias("r"), F.lit(-1).cast("long").alias("p")))
    ordered = best.select("g", "seg", "k", F.max(place).over(Window.partitionBy("g", "seg").orderBy("k")).alias("at"))
    cuts = ordered.groupBy("g", "seg").agg(F.sort_array(F.collect_list(F.struct("k", "at"))).alias("cuts"))  # CUTS of them
    told = ranged.join(bounds.join(cuts, ["g", "seg"]), ["g", "seg"])
    passed = F.size(F.filter("cuts", lambda c: c["at"] <= F.struct(F.col("r0").alias("r"), F.col("p0").alias("p"))))
    told = told.withColumn("j", passed)
    below = (F.col("j") > 0) & (mean < F.try_element_at("t", F.greatest("j", F.lit(1))))
    above = (F.col("j") < CUTS) & (mean > F.try_element_at("t", F.col("j") + 1))
    side = F.when(below, -1).when(above, 1).otherwise(0)
    parted = told.select("g", (F.col("seg") * (CUTS + 1) + F.col("j")).cast("decimal(38, 0)").alias("seg"), "q", "r0", "p0", "r1", "s", "n", side.alias("side"))
    own = F.when(F.col("side") == 0, F.struct("r0", "p0"))
    one = parted.groupBy("g", "seg", "q", "side", own.alias("own")).agg(F.min(F.struct("r0", "p0")).alias("a"), F.max("r1").alias("r1"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return one.select("g", "seg", "a.r0", "a.p0", "r1", "s", "n")


def isotonic(rows: DataFrame, group: list[str], x: str, y: str, name: str = "fit") -> DataFrame:
    """Adds the non-decreasing least-squares fit of ``y`` over ``x`` within each group.

    Rows of equal x are in the order of their y, so no order is asked for among them,
    and rows of equal x and y have one fit. Null, in a column of ``group``, is a value as any other.
    Rows whose x or y is null or no finite number take no part; their fit is null. No rows
    give no rows; other columns stay as they are. Exact up to rounding of sums.
    """
    if name in rows.columns:
        raise ValueError(f"there is a column {name}")
    key = F.to_json(F.struct(*[F.col(c) for c in group])) if group else F.lit("")
    packed = rows.select(key.alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.struct("*").alias("row"))
    finite = lambda c: F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False))
    packed = packed.withColumn("some", finite("x") & finite("y"))
    placed = _placed(packed.filter("some").drop("some"))
    base = materialized(placed.groupBy("g", "range", "block").agg(F.sum("y").alias("s"), F.count("*").cast("double").alias("n")))
    left = base.select("g", F.lit(0).cast("decimal(38, 0)").alias("seg"), F.col("range").alias("r0"), F.col("block").alias("p0"), F.col("range").alias("r1"), "s", "n")
    small = []
    while True:
        sizes = materialized(left.groupBy("g", "seg").agg(F.count("*").alias("size")))
        large = sizes.filter(F.col("size") > LIMIT)
        small.append(left.join(large, ["g", "seg"], "left_anti"))
        if large.isEmpty():
            break
        left = materialized(_cut(left.join(large.select("g", "seg"), ["g", "seg"], "left_semi")))
    ends = [s.groupBy("g", "seg").applyInPandas(lambda df: _pool(df.sort_values(["r0", "p0"])), BLOCK) for s in small]
    final = ends[0]
    for e in ends[1:]:
        final = final.unionByName(e)
    spread = final.select("r0", "p0", (F.col("s") / F.col("n")).alias("fit"), F.explode(F.sequence("r0", "r1")).alias("range"))
    starts = spread.select("range", F.when(F.col("range") == F.col("r0"), F.col("p0")).otherwise(-1).alias("start"), F.col("r0").alias("since"), "fit")

    def met(blocks: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        fits = fits.sort_values(["start", "since"])
        at = np.searchsorted(fits["start"].to_numpy(), blocks["block"].to_numpy(), "right") - 1
        return blocks[["range", "block"]].assign(fit=fits["fit"].to_numpy()[at])

    fits = base.select("range", "block").groupBy("range").cogroup(starts.groupBy("range")).applyInPandas(met, "range long, block long, fit double")
    fitted = placed.select("range", "block", "row").join(fits, ["range", "block"])
    none = packed.filter(~F.col("some")).select("row.*", F.lit(None).cast("double").alias(name))
    return fitted.select("row.*", F.col("fit").alias(name)).unionByName(none)
