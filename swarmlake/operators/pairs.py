"""All pairs of two tables of points, block by block, without copies of points in a shuffle.

Points are packed: a row holds up to ``BLOCK`` of them as bytes. A task keeps a few
packed rows of queries, reads the packed points one row after another (a Cartesian
product) and folds each into what it knows of its queries. So disk and shuffle hold each
point once, however many pairs there are, and memory is bounded by a task's queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import materialized

BLOCK, BYTES = 2048, 1 << 20  # points in a packed row, and bytes of their coordinates as doubles, at most
TILE = 256  # queries whose distances to a block are in memory at once
PAIRS = 8  # pairs of packed rows in an Arrow batch
DIGITS = 8  # of squared distances
SLACK = 2e-8  # more than rounding to DIGITS moves two of them
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Block:
    """Unpacked points: ``ids``, ``x``, ``squares`` of their lengths, and ``of``, their other columns."""

    def __init__(self, row: dict, fields: dict[str, str]):
        self.name = row["name"]
        self.ids = np.frombuffer(row["ids"], "<i8")
        n = len(self.ids)
        x = np.frombuffer(row["x"], "<i2") / 1e4 if row["short"] else np.frombuffer(row["x"], "<f8")
        self.x = x.reshape(n, -1)
        self.squares = (self.x * self.x).sum(1)
        self.of = {f: np.frombuffer(row[f], t).reshape(n, -1) for f, t in fields.items()}

    def by_id(self) -> Block:
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.x, self.squares = self.ids[order], self.x[order], self.squares[order]
        self.of = {f: v[order] for f, v in self.of.items()}
        return self


def squared(left: Block, rows: slice | np.ndarray, right: Block) -> np.ndarray:
    """Squared distances of some rows of ``left`` to all of ``right``, not rounded."""
    d = left.x[rows] @ right.x.T
    d *= -2
    d += right.squares
    d += left.squares[rows, None]
    return np.maximum(d, 0, out=d)


def tiles(n: int) -> Iterator[slice]:
    for a in range(0, n, TILE):
        yield slice(a, min(a + TILE, n))


def packed(points: DataFrame, fields: dict[str, str], key: str = "vec_id", block: int | None = None) -> DataFrame:
    """Packed rows of ``points`` (key, x, fields), in their order within partitions; written once.

    ``fields`` are other columns with their numpy types: numbers, or arrays of one length.
    Coordinates that are whole ten-thousandths take two bytes each, all others eight. Points
    without a key or coordinates take no part.
    """
    most = block or BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, waiting, n = 0, [], 0

        def row(table: pa.Table) -> pa.RecordBatch:
            x = _matrix(table.column("x"), "<f8")
            q = np.rint(x * 1e4)
            short = bool((np.abs(q) < 32768).all() and (q / 1e4 == x).all())
            made = {"name": TaskContext.get().partitionId() * (1 << 32) + seq, "ids": _matrix(table.column(key), "<i8").tobytes(), "x": (q.astype("<i2") if short else x).tobytes(), "short": short}
            made |= {f: _matrix(table.column(f), t).tobytes() for f, t in fields.items()}
            return pa.RecordBatch.from_pylist([made], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            width = max(1, len(batch.column("x").flatten()) // batch.num_rows)
            size = max(1, min(most, BYTES // (8 * width)))
            waiting, n = [*waiting, batch], n + batch.num_rows
            if n >= size:
                table = pa.Table.from_batches(waiting)
                full = n - n % size
                for a in range(0, full, size):
                    yield row(table.slice(a, size))
                    seq += 1
                waiting, n = table.slice(full).to_batches(), n - full
        if n:
            yield row(pa.Table.from_batches(waiting))

    out = pa.schema([("name", pa.int64()), ("ids", pa.binary()), ("x", pa.binary()), ("short", pa.bool_()), *[(f, pa.binary()) for f in fields]])
    schema = "name long, ids binary, x binary, short boolean" + "".join(f", {f} binary" for f in fields)
    known = points.select(key, "x", *fields).filter(F.col(key).isNotNull() & F.col("x").isNotNull())
    tasks = max(1, points.select(key).count() // (4 * most))  # a task's last row may be a small one
    return materialized(known.coalesce(tasks).mapInArrow(run, schema))


def _matrix(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """The values of a column of numbers, or of arrays of one length; nulls as NaN."""
    column = column.combine_chunks()
    n, nested = len(column), pa.types.is_list(column.type)
    values = (column.flatten() if nested else column).to_numpy(zero_copy_only=False).astype(dtype)
    if nested and n and len(values) != n * len(column[0]):
        raise ValueError("points differ in length")
    return values.reshape(n, -1)


@contextmanager
def _small_batches(spark: SparkSession):
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(PAIRS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def met(asked: DataFrame, offered: DataFrame, fields: tuple[dict[str, str], dict[str, str]], fold: Callable[[Block], object], schema: str) -> DataFrame:
    """What ``fold`` finds of the queries of each packed row of ``asked`` over the rows of ``offered``; written.

    ``fold(left)`` has ``add(right)`` for one row of points after another, and ``found()``, columns by
    name. Few queries meet the points in several parts: then there is a row for each of them.
    """
    spark = asked.sparkSession
    rows, cores = asked.count(), spark.sparkContext.defaultParallelism
    parts = max(1, -(-rows // 2), min(rows, 4 * cores))
    left = asked.select(*[F.col(c).alias(f"a_{c}") for c in asked.columns]).repartitionByRange(parts, "a_name")
    right = offered.coalesce(max(1, -(-2 * cores // parts)))
    pairs = right.crossJoin(left.hint("shuffle_replicate_nl"))  # the first side is read once a task, the second is kept
    asked_fields, offered_fields = fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds, right = {}, None
        for batch in batches:
            names = zip(batch.column("name").to_pylist(), batch.column("a_name").to_pylist())
            for i, (name, mine) in enumerate(names):
                if mine not in folds:
                    folds[mine] = fold(Block({c[2:]: batch.column(c)[i].as_py() for c in batch.schema.names if c.startswith("a_")}, asked_fields))
                if right is None or right.name != name:
                    right = Block({c: batch.column(c)[i].as_py() for c in batch.schema.names if not c.startswith("a_")}, offered_fields).by_id()
                folds[mine].add(right)
        for each in folds.values():
            columns = each.found()
            for a in range(0, len(next(iter(columns.values()))), 1 << 16):
                yield pa.RecordBatch.from_pydict({c: pa.array(list(v[a : a + (1 << 16)])) if np.ndim(v) > 1 else pa.array(v[a : a + (1 << 16)], from_pandas=True) for c, v in columns.items()})

    with _small_batches(spark):
        return materialized(pairs.mapInArrow(run, schema))


class Nearest:
    """The nearest point of each query that differs from it in ``apart`` (ids, or a column); ties: the smallest id."""

    def __init__(self, left: Block, apart: str = "ids", also: str | None = None):
        n = len(left.ids)
        self.left, self.apart, self.also = left, apart, also
        self.low, self.near, self.value = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.full(n, np.nan)

    def add(self, right: Block) -> None:
        mine, theirs = ((b.ids if self.apart == "ids" else b.of[self.apart][:, 0]) for b in (self.left, right))
        some = np.isin(mine, theirs)  # queries with points here that do not count
        for t in tiles(len(mine)):
            d = squared(self.left, t, right)
            if some[t].any():
                d[mine[t, None] == theirs] = np.inf
            low = d.min(1)
            at = np.flatnonzero(np.isfinite(low) & (low <= self.low[t] + SLACK))
            if not len(at):
                continue
            d = np.round(d[at], DIGITS)
            j = d.argmin(1)
            d, ids, at = d[np.arange(len(at)), j], right.ids[j], at + t.start
            better = (d < self.low[at]) | ((d == self.low[at]) & (ids < self.near[at]))
            at, j = at[better], j[better]
            self.low[at], self.near[at] = d[better], ids[better]
            if self.also:
                self.value[at] = right.of[self.also][j, 0]

    def found(self) -> dict[str, np.ndarray]:
        some = np.isfinite(self.low)
        columns = {"vec_id": self.left.ids, "nearest": self.near, "d2": self.low} | ({"predicted": self.value} if self.also else {})
        return {c: v[some] for c, v in columns.items()}


class Smoothed:
    """Gaussian weights of all points but the query itself, on the scale of the nearest so far."""

    def __init__(self, left: Block, sigma: float):
        n = len(left.ids)
        self.left, self.width = left, 2 * sigma * sigma
        self.low, self.weight, self.total = np.full(n, np.inf), np.zeros(n), np.zeros(n)

    def add(self, right: Block) -> None:
        some, fitness = np.isin(self.left.ids, right.ids), right.of["fitness"][:, 0]
        for t in tiles(len(self.low)):
            d = np.round(squared(self.left, t, right), DIGITS)
            if some[t].any():
                d[self.left.ids[t, None] == right.ids] = np.inf
            low = np.minimum(self.low[t], d.min(1))
            scale = decay(low, self.low[t], self.width)
            np.subtract(np.where(np.isfinite(low), low, 0)[:, None], d, out=d)
            d /= self.width
            w = np.exp(d, out=d)
            self.weight[t], self.total[t], self.low[t] = self.weight[t] * scale + w.sum(1), self.total[t] * scale + w @ fitness, low

    def found(self) -> dict[str, np.ndarray]:
        some = np.isfinite(self.low)
        return {c: v[some] for c, v in {"vec_id": self.left.ids, "low": self.low, "weight": self.weight, "total": self.total}.items()}


def decay(low: np.ndarray, at: np.ndarray, width: float) -> np.ndarray:
    """The weight at a squared distance on the scale of ``low``, which is not above it; 0 at infinity."""
    return np.where(np.isfinite(at), np.exp((np.where(np.isfinite(at), low, 0) - np.where(np.isfinite(at), at, 0)) / width), 0.0)


class KNearest:
    """The k nearest other points of each query, ties included.

    The query's own block bounds its k-th distance; blocks farther than that by the
    triangle inequality, from their centre and radius, are not met.
    """

    def __init__(self, left: Block, k: int):
        n = len(left.ids)
        self.left, self.k = left, k
        self.bound = np.full(n, np.inf)  # at least the k-th least squared distance
        self.least = np.full((n, k), np.inf)
        self.i, self.j, self.d = [], [], []
        if n > k:
            for t in tiles(n):
                d = squared(left, t, left)
                d[left.ids[t, None] == left.ids] = np.inf
                self.bound[t] = np.round(np.partition(d, k - 1, axis=1)[:, k - 1], DIGITS)

    def add(self, right: Block) -> None:
        centre = right.x.mean(0)
        reach = np.sqrt(((right.x - centre) ** 2).sum(1).max())
        gap = np.sqrt(((self.left.x - centre) ** 2).sum(1)) - reach
        rows = np.flatnonzero(gap <= np.sqrt(self.bound + SLACK) * (1 + 1e-9) + 1e-6)
        some = np.isin(self.left.ids, right.ids)
        for t in tiles(len(rows)):
            at = rows[t]
            d = squared(self.left, at, right)
            if some[at].any():
                d[self.left.ids[at, None] == right.ids] = np.inf
            i, j = np.nonzero(d <= (self.bound[at] + SLACK)[:, None])
            if not len(i):
                continue
            d = np.round(d[i, j], DIGITS)
            keep = np.isfinite(d)
            i, j, d = i[keep], j[keep], d[keep]
            self.i.append(at[i])
            self.j.append(right.ids[j])
            self.d.append(d)
            self._narrow(at[i], d)
        if sum(map(len, self.d)) > 4 * self.k * len(self.bound) + (1 << 16):
            self._settle()

    def _narrow(self, i: np.ndarray, d: np.ndarray) -> None:
        """Takes the least of new distances among the k least of their rows."""
        order = np.lexsort((d, i))
        i, d = i[order], d[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.zeros(0, dtype=int)
        place = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        which, some = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(i)])), place < self.k
        new = np.full((len(first), self.k), np.inf)
        new[which[some], place[some]] = d[some]
        at = i[first]
        self.least[at] = np.sort(np.concatenate([self.least[at], new], axis=1), axis=1)[:, : self.k]
        self.bound[at] = np.minimum(self.bound[at], self.least[at, self.k - 1])

    def _settle(self) -> None:
        i, j, d = (np.concatenate(v) if v else np.zeros(0, dtype=t) for v, t in ((self.i, np.int64), (self.j, np.int64), (self.d, float)))
        keep = d <= self.bound[i]
        self.i, self.j, self.d = [i[keep]], [j[keep]], [d[keep]]

    def found(self) -> dict[str, np.ndarray]:
        self._settle()
        return {"i": self.left.ids[self.i[0]], "j": self.j[0], "d": np.sqrt(self.d[0])}
