"""Hard negatives by threshold joins with suffix-norm bounds (operator 12).

Vectors become integers, floor(256 x), with the components that hold most of the
table's squares first. Anchors meet the other vectors in blocks. In a block, slabs of
components are the lists of an inverted index: a pair's score is added up slab by slab,
and what the rest can add is at most the product of the two suffix norms. A vector
stands in the lists of a slab only for anchors with which it may still reach their
threshold; all components behind that are covered by the bound and never looked at.
Thresholds begin high and are lowered until every window of an anchor is full or its
lower end is reached; sums that were left resume where they stopped.

Positives of an anchor are the first of its label, so anchors meet blocks of their label
alone. A window belongs to an anchor and a positive: the first ``NEGATIVES`` rows of other
labels with a score from 80 to 100 percent of the positive's. Blocks are visited in
rounds of 1, 15, 240, .. of them: after each, the last of a full window is the threshold
below which the next round need not look, so what is sent stays near the square root of
the number of blocks for each window. All of this is exact: every row of other labels is
met or excluded by the bound.

Rows with a null vec_id, label or vector, or a null or non-finite component, take no part.
Shorter vectors are filled up with zeros. Rows may repeat: each is an anchor, a positive
and a negative of its own, and "other rows" are all but the very row; equal scores go by
vec_id. A negative positive_score has an empty window. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, materialize

POSITIVES = 5
NEGATIVES = 5
EVERY = 100
BLOCK = 4096  # rows in a block, about
CHUNK = 4096  # anchors that meet a block in one task, about
TOGETHER = 512  # of them at once
SLAB = 16  # components whose products are added up together
GROWTH = 16
STEPS = 4
FALL = (0.5, 0.35, 0.25, 0.15, 0.0)  # of the product of norms: thresholds for positives
EXACT = 2.0**52


def prepared(vectors: DataFrame) -> DataFrame:
    """row, vec_id, label and q of the rows that take part: labels as stated, components in the order of their squares."""
    wide = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    clean = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    took = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(clean, F.lit(False)))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = took.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), wide.alias("q"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(batch.num_rows)), *batch.columns], ["row", "vec_id", "label", "q"])
            row += batch.num_rows

    numbered = materialize(rows.mapInArrow(number, "row long, vec_id long, label long, q array<long>"), "vectors")
    squares = numbered.select(F.posexplode("q").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("double") * F.col("v")).alias("s"))
    order = [r["i"] for r in squares.orderBy(F.desc("s"), "i").collect()]  # as many as a vector is long
    turned = F.transform(F.array(*[F.lit(i) for i in order]), lambda i: F.coalesce(F.get("q", i), F.lit(0))) if order else F.col("q")
    out = materialize(numbered.select("row", "vec_id", "label", turned.alias("q")), "turned-vectors")
    drop(numbered)
    return out


class PartialScores:
    """Inner products of rows ``a`` and ``b``, added up as far as thresholds ask for."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.stages = max(1, -(-a.shape[1] // SLAB))
        fill = ((0, 0), (0, self.stages * SLAB - a.shape[1]))
        self.rest_a, self.rest_b = (self._suffix_norms(np.pad(m, fill).astype(float)) for m in (a, b))
        exact = self.rest_a[:, 0].max(initial=0) * self.rest_b[:, 0].max(initial=0) < EXACT
        self.a, self.b = (np.pad(m, fill).astype(float if exact else np.int64) for m in (a, b))
        self.score = np.zeros((len(a), len(b)), dtype=self.a.dtype)
        self.stage = np.zeros(self.score.shape, dtype=np.int16)
        self.bound = self._room(0, slice(None), slice(None))

    def _suffix_norms(self, m: np.ndarray) -> np.ndarray:
        squares = (m * m).reshape(len(m), self.stages, SLAB).sum(axis=2)
        return np.append(np.sqrt(np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]), np.zeros((len(m), 1)), axis=1)

    def _room(self, stage: int, i, j) -> np.ndarray:
        return np.outer(self.rest_a[i, stage], self.rest_b[j, stage]) * (1 + 1e-9) + 1e-6

    def reach(self, least: np.ndarray) -> np.ndarray:
        """Which pairs have a score of ``least`` (by row of a) or more; theirs are whole then."""
        for k in range(self.stages):
            live = (self.stage == k) & (self.bound >= least[:, None])
            i, j = np.flatnonzero(live.any(axis=1)), np.flatnonzero(live.any(axis=0))
            if not len(i):
                continue
            part, block = slice(k * SLAB, (k + 1) * SLAB), np.ix_(i, j)
            some = live[block]
            if 8 * some.sum() > some.size:
                more = np.where(some, self.a[i, part] @ self.b[j, part].T, 0)
                self.score[block] += more
                self.bound[block] = np.where(some, self.score[block] + self._room(k + 1, i, j), self.bound[block])
            else:
                i, j = np.nonzero(live)
                self.score[i, j] += np.einsum("ij,ij->i", self.a[i, part], self.b[j, part])
                self.bound[i, j] = self.score[i, j] + self.rest_a[i, k + 1] * self.rest_b[j, k + 1] * (1 + 1e-9) + 1e-6
            self.stage[live] = k + 1
        return (self.stage == self.stages) & (self.score >= least[:, None])


def _renamed(*columns: str) -> list[Column]:
    """Under names that the other side of a cogroup does not have."""
    return [F.col(c).alias(f"to_{c}") for c in columns]


def matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.int64) for x in column])


def best_of(anchors: pd.DataFrame, others: pd.DataFrame, k: int) -> pd.DataFrame:
    """The first k other rows of each anchor."""
    out = []
    ids, rows, b = others["to_vec_id"].to_numpy(), others["to_row"].to_numpy(), matrix(others["to_q"])
    for at in range(0, len(anchors), TOGETHER):
        some = anchors.iloc[at : at + TOGETHER]
        scores, own = PartialScores(matrix(some["q"]), b), some["row"].to_numpy()
        not_self = own[:, None] != rows
        most = scores.rest_a[:, 0] * scores.rest_b[:, 0].max()
        for fall in (*FALL, None):
            least = most * fall if fall is not None else np.full(len(some), -np.inf)
            hit = scores.reach(least) & not_self
            if (hit.sum(axis=1) >= np.minimum(k, not_self.sum(axis=1))).all():
                break
        for i in range(len(some)):
            j = np.flatnonzero(hit[i])
            j = j[np.lexsort((rows[j], ids[j], -scores.score[i, j]))[:k]]
            out.append(pd.DataFrame({"anchor": own[i], "positive": rows[j], "positive_id": ids[j], "score": scores.score[i, j].astype(np.int64)}))
    return pd.concat(out)


def positives(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """(anchor, ord, positive_id, score): the first k other rows of the same label of each anchor."""
    is_anchor = F.col("vec_id") % every == 0
    sizes = vectors.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"), F.ceil(F.count(F.when(is_anchor, 1)) / CHUNK).cast("int").alias("chunks"))
    sizes = materialize(sizes.filter("chunks > 0"), "label-sizes")
    of = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = vectors.filter(is_anchor).join(sizes, "label").select("label", each("salts").alias("salt"), of("chunks").alias("chunk"), "row", "q")
    offered = vectors.join(sizes, "label").select(F.col("label").alias("to_label"), of("salts").alias("to_salt"), each("chunks").alias("to_chunk"), *_renamed("row", "vec_id", "q"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({c: pd.Series(dtype=np.int64) for c in ("anchor", "positive", "positive_id", "score")})
        return best_of(left, right, k)

    met = asked.groupBy("label", "salt", "chunk").cogroup(offered.groupBy("to_label", "to_salt", "to_chunk")).applyInPandas(run, "anchor long, positive long, positive_id long, score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "positive")
    return met.withColumn("ord", F.row_number().over(first)).filter(F.col("ord") <= k).select("anchor", "ord", "positive_id", "score")


def windows_filled(anchors: pd.DataFrame, others: pd.DataFrame, k: int, low: int, high: int) -> pd.DataFrame:
    """The first k rows in each window of each anchor (row, label, q, windows)."""
    out = []
    ids, rows, labels, b = others["to_vec_id"].to_numpy(), others["to_row"].to_numpy(), others["to_label"].to_numpy(), matrix(others["to_q"])
    by_id = np.lexsort((rows, ids))
    ids, rows, labels, b = ids[by_id], rows[by_id], labels[by_id], b[by_id]
    for at in range(0, len(anchors), TOGETHER):
        some = anchors.iloc[at : at + TOGETHER]
        scores = PartialScores(matrix(some["q"]), b)
        n = max(len(w) for w in some["windows"])
        floor, top = np.full((len(some), n), np.inf), np.full((len(some), n), -np.inf)
        for i, windows in enumerate(some["windows"]):
            for j, w in enumerate(windows):
                bottom = -(-low * w["score"] // 100)  # whole numbers: low * score <= 100 * x
                floor[i, j] = bottom if w["least"] is None else max(bottom, w["least"])
                top[i, j] = high * w["score"] // 100
        used = floor <= top
        some_left = used.any(axis=1)
        end, start = (np.where(used, x, np.inf).min(axis=1) for x in (floor, top))
        start, end = np.where(some_left, start, 0), np.where(some_left, end, 0)
        other = some["label"].to_numpy()[:, None] != labels
        held = np.zeros(other.shape, dtype=bool)
        for step in range(STEPS + 1):
            least = np.where(some_left, start + (end - start) * step / STEPS, np.inf)
            held |= scores.reach(least) & other
            for i in np.flatnonzero(some_left):
                sure = scores.score[i, held[i]]
                some_left[i] = any(used[i, j] and least[i] > floor[i, j] and ((sure >= floor[i, j]) & (sure <= top[i, j])).sum() < k for j in range(n))
            if not some_left.any():
                break
        for i, windows in enumerate(some["windows"]):
            j = np.flatnonzero(held[i])
            j = j[np.argsort(-scores.score[i, j], kind="stable")]
            found = scores.score[i, j].astype(np.int64)
            for at_w, w in enumerate(windows):
                inside = np.flatnonzero((found >= floor[i, at_w]) & (found <= top[i, at_w]))[:k]
                if len(inside):
                    out.append(pd.DataFrame({"anchor": some["row"].iloc[i], "ord": w["ord"], "negative": rows[j[inside]], "negative_id": ids[j[inside]], "negative_score": found[inside]}))
    return pd.concat(out) if out else _no_negatives()


def _no_negatives() -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype=np.int64) for c in ("anchor", "ord", "negative", "negative_id", "negative_score")})


def mined(vectors: DataFrame, every: int = EVERY, k: int = POSITIVES, negatives: int = NEGATIVES, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores, for each positive of each anchor."""
    rows = prepared(vectors)
    pairs = materialize(positives(rows, every, k), "positives")
    total = rows.count()
    blocks, chunks = (max(1, -(-n // size)) for n, size in ((total, BLOCK), (rows.filter(F.col("vec_id") % every == 0).count(), CHUNK)))
    of = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    schema = "anchor long, ord int, negative long, negative_id long, negative_score long"
    first = Window.partitionBy("anchor", "ord").orderBy(F.desc("negative_score"), "negative_id", "negative")
    found, a = None, 0
    while a < blocks:
        z = min(blocks, max(1, a * GROWTH))
        windows = pairs.withColumn("least", F.lit(None).cast("long"))
        if found is not None:
            last = found.filter(F.col("rank") == negatives).select("anchor", "ord", F.col("negative_score").alias("least"))
            windows = pairs.join(last, ["anchor", "ord"], "left")
        windows = windows.groupBy(F.col("anchor").alias("of")).agg(F.collect_list(F.struct("ord", "score", "least")).alias("windows"))  # k of them
        asked = rows.join(windows, F.col("row") == F.col("of")).select(F.explode(F.sequence(F.lit(a), F.lit(z - 1))).alias("block"), of(chunks).alias("chunk"), "row", "label", "q", "windows")
        offered = rows.withColumn("to_block", of(blocks)).filter(F.col("to_block").between(a, z - 1))
        offered = offered.select("to_block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("to_chunk"), *_renamed("row", "vec_id", "label", "q"))

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            return windows_filled(left, right, negatives, low, high) if len(left) and len(right) else _no_negatives()

        met = asked.groupBy("block", "chunk").cogroup(offered.groupBy("to_block", "to_chunk")).applyInPandas(run, schema)
        if found is not None:
            met = met.unionByName(found.drop("rank"))
        after = materialize(met.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives), "negatives")
        if found is not None:
            drop(found)
        found, a = after, z
    ids = rows.filter(F.col("vec_id") % every == 0).select(F.col("row").alias("of"), F.col("vec_id").alias("anchor_id"))
    named = found.join(pairs, ["anchor", "ord"]).join(ids, F.col("anchor") == F.col("of"))
    return named.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
