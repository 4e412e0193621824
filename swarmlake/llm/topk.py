"""Exact top-k inner products over a pivot-distance index (operator 9).

Vectors become integers, floor(256 x). One more coordinate gives all candidates
the same norm, so the largest inner product is the smallest distance. Each
candidate is keyed by its nearest pivot and its distance to it; rings of equal
width around a pivot are cut by a salt into blocks of bounded size. A query
first looks into its nearest rings, which gives it k scores; then into every
ring that the triangle inequality and the bisecting planes between pivots do
not exclude. Pivots are a bounded sample; every vector is indexed.

Vectors that are null or hold null or non-finite components take no part.
Shorter vectors are filled up with zeros. Ties go to the smaller vec_id. Repeated
vec_ids are rows of their own: each such query has its own k rows, in which a repeated
candidate stands as often as it is in the table, and a query skips its own row only. A
null vec_id is no query and no candidate. Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

PIVOTS = 64
RINGS = 32
BLOCK = 1024  # vectors in a block, about
QUERIES = 512  # queries that meet a block in one task, about
EXACT = 2.0**52


def quantized(vectors: DataFrame) -> DataFrame:
    """row, a number, vec_id and the components floor(256 x) of the vectors that take part."""
    wide = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    clean = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    took = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(clean, F.lit(False)))
    rows = took.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("q"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(batch.num_rows)), *batch.columns], ["row", "vec_id", "q"])
            row += batch.num_rows

    return rows.mapInArrow(number, "row long, vec_id long, q array<long>")


def _matrix(column, dim: int) -> np.ndarray:
    rows = [np.asarray(x, dtype=np.int64) for x in column]
    out = np.zeros((len(rows), dim), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    bound = np.sqrt((a.astype(float) ** 2).sum(1).max()) * np.sqrt((b.astype(float) ** 2).sum(1).max())
    return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64) if bound < EXACT else a @ b.T


class Index:
    """Pivots in the space with one more coordinate, and the key of a vector."""

    def __init__(self, pivots: np.ndarray, norm2: float, width: float):
        self.pivots, self.norm2, self.width = pivots.astype(float), norm2, width
        self.lift = np.sqrt(np.maximum(norm2 - (self.pivots**2).sum(1), 0))

    def distances(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        v = v.astype(float)
        own = (v**2).sum(1)
        lift = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.norm2 - own, 0))
        total = own if query else np.full(len(v), self.norm2)
        d2 = total[:, None] + self.norm2 - 2 * (v @ self.pivots.T + lift[:, None] * self.lift)
        return np.sqrt(np.maximum(d2, 0))

    def ring(self, distance: np.ndarray) -> np.ndarray:
        return np.minimum(distance / self.width, RINGS - 1).astype(np.int64)


def keyed(vectors: DataFrame, index: Index, dim: int) -> DataFrame:
    """Nearest pivot, distance and ring of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = index.distances(_matrix(batch.column("q").to_pylist(), dim))
            pivot = d.argmin(1)
            near = d[np.arange(len(d)), pivot]
            columns = [batch.column("row"), batch.column("vec_id"), batch.column("q"), pa.array(pivot, pa.int32()), pa.array(near), pa.array(index.ring(near), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["row", "vec_id", "q", "pivot", "distance", "ring"])

    return vectors.mapInArrow(run, "row long, vec_id long, q array<long>, pivot int, distance double, ring int")


def bounds(directory: pd.DataFrame, index: Index, q: np.ndarray) -> np.ndarray:
    """Largest inner product that a ring (column) can hold for a query (row)."""
    d = index.distances(q, query=True)
    near = d.min(1, keepdims=True)
    pivot, low, high = (directory[c].to_numpy() for c in ("pivot", "low", "high"))
    to = d[:, pivot]
    gap = np.maximum(np.maximum(to - high, low - to), (to - near) / 2)
    gap = np.maximum(gap - 1e-6 * (1 + to), 0)  # room for rounding
    return ((q.astype(float) ** 2).sum(1)[:, None] + index.norm2 - gap**2) / 2 + 1e-6 * (1 + index.norm2)


def visits(queries: DataFrame, directory: pd.DataFrame, index: Index, dim: int, k: int, first: bool) -> DataFrame:
    """Rings that each query looks into: at first the nearest that hold k others, then all that may reach its k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                b = bounds(directory, index, _matrix(part.column("q").to_pylist(), dim))
                if first:
                    order = np.argsort(-b, axis=1, kind="stable")
                    held = np.cumsum(directory["n"].to_numpy()[order], axis=1)
                    take = np.zeros(b.shape, dtype=bool)
                    np.put_along_axis(take, order, np.concatenate([np.zeros((len(b), 1)), held[:, :-1]], axis=1) <= k, axis=1)
                else:
                    kth = part.column("kth").to_numpy(zero_copy_only=False).astype(float)
                    take = np.isnan(kth)[:, None] | (b >= kth[:, None])
                row, ring = np.nonzero(take)
                cells = directory.iloc[ring]
                columns = [part.column("query").take(pa.array(row)), pa.array(cells["pivot"].to_numpy(), pa.int32()), pa.array(cells["ring"].to_numpy(), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["query", "pivot", "ring"])

    return queries.mapInArrow(run, "query long, pivot int, ring int")


def scored(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, dim: int, k: int) -> DataFrame:
    """The k best of each block for each query that looks into its ring."""
    salts = blocks.select("pivot", "ring", "salt").distinct()
    met = pairs.join(salts, ["pivot", "ring"])
    per_block = met.groupBy("pivot", "ring", "salt").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("chunks"))
    asked = met.join(per_block, ["pivot", "ring", "salt"]).join(queries.select("query", "q"), "query")
    # of the type that the other side has: a cogroup deals both sides by the hashes of their own types
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")).cast("int"))
    offered = blocks.join(per_block, ["pivot", "ring", "salt"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = ["pivot", "ring", "salt", "chunk"]
    offered = offered.select(*(F.col(c).alias(f"to_{c}") for c in key), "row", "vec_id", F.col("q").alias("to_q"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype("int64")
        right = right.sort_values("vec_id", kind="stable")
        ids, rows = right["vec_id"].to_numpy(), right["row"].to_numpy()
        products = _products(_matrix(left["q"], dim), _matrix(right["to_q"], dim))
        out = []
        for query, row in zip(left["query"].to_numpy(), products):
            others = np.flatnonzero(rows != query)
            best = others[np.argsort(-row[others], kind="stable")[:k]]
            out.append(pd.DataFrame({"query": query, "vec_id": ids[best], "score": row[best]}))
        return pd.concat(out).astype("int64")

    return asked.groupBy(*key).cogroup(offered.groupBy(*(f"to_{c}" for c in key))).applyInPandas(run, "query long, vec_id long, score long")


def search(vectors: DataFrame, k: int = 5, every: int = 50, pivots: int = PIVOTS) -> DataFrame:
    """The k highest inner products of each vec_id divisible by ``every``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    base = materialize(quantized(vectors), "vectors")
    facts = base.agg(F.max(F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm2"), F.max(F.size("q")).alias("dim")).first()
    if facts["dim"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, norm2 = max(1, facts["dim"]), facts["norm2"]
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    index = Index(_matrix([r["q"] for r in sample], dim), norm2, max(2 * np.sqrt(norm2) / RINGS, 1e-9))
    placed = materialize(keyed(base, index, dim), "keyed-vectors")
    # at most pivots x RINGS rows
    rings = placed.groupBy("pivot", "ring").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n"))
    directory = rings.toPandas().sort_values(["pivot", "ring"]).reset_index(drop=True)
    salts = spark.createDataFrame(directory[["pivot", "ring"]].assign(salts=-(-directory["n"] // BLOCK))).select(F.col("pivot").cast("int"), F.col("ring").cast("int"), "salts")
    salted = placed.join(F.broadcast(salts), ["pivot", "ring"])
    blocks = materialize(salted.select("row", "vec_id", "q", "pivot", "ring", F.pmod(F.xxhash64("row"), "salts").cast("int").alias("salt")), "vector-blocks")
    queries = materialize(base.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "q"), "queries")
    seen = materialize(visits(queries, directory, index, dim, k, True), "first-visits")
    near = materialize(scored(seen, queries, blocks, dim, k), "near-scores")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    # by what was written: bounds computed again, in other batches, may round to another order
    unseen = visits(queries.join(kth, "query", "left"), directory, index, dim, k, False).join(seen, ["query", "pivot", "ring"], "left_anti")
    rest = scored(unseen, queries, blocks, dim, k)
    found = near.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.join(queries.select("query", "query_id"), "query").select("query_id", "rank", "vec_id", "score")
