"""SimHash near-duplicates through sharded BK-trees (operator 2).

Fingerprints that differ in at most ``radius`` bits agree in one of radius + 1
groups of bits, so the bits of each group name a shard in which every such pair
meets. A shard of over ``SHARD`` fingerprints is cut again, by groups of the bits
that its name leaves open: each cut deals a fingerprint out radius + 1 times, never
to all others. What ``CUTS`` cuts leave too large is a dense cluster, of which
chunks meet two by two. So a tree fits in a task, and the sum of the trees may grow
with the corpus: a tree is not sent to all tasks but meets, in one task, the
fingerprints whose bits lead to it.

A shard's fingerprints form a BK-tree, whose children are keyed by the integer
distance to their parent; each fingerprint first looks for those before it,
following only the keys within the radius, and then becomes a node. A task emits
a spanning forest of the links that it finds, not all pairs; components of the
forests are those of the links.

Null, empty and blank texts have fingerprint zero, linked like any other. Rows
without a doc_id link nothing and have no component; with ``unnamed`` they link as
all others, and theirs is the smallest doc_id that they reach, null where there is
none. Repeated doc_ids and texts are rows of their own: links are between
fingerprints, and a repeated doc_id is in the component of each of its texts. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import byte_values, slices
from .components import components
from .scratch import drop, materialize

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
SHARD = 2048
CUTS = 3


def shingle_hashes(text: bytes, width: int = SHINGLE, seed: int = SEED) -> list[int]:
    words = text.lower().split()  # of bytes: A-Z only, and cut at ASCII white space
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return [digest(b" ".join(words), seed)] if words else []
    return [digest(s, seed) for s in map(b" ".join, zip(*(words[i:] for i in range(width))))]


def fingerprints(texts: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Bits set in over half of a text's shingle hashes."""
    hashes = [shingle_hashes(t, width) for t in texts]
    n = np.array([len(h) for h in hashes], dtype=np.int64)
    flat = np.fromiter((x for h in hashes for x in h), dtype="<u8", count=int(n.sum()))
    out = np.zeros(len(texts), dtype="<u8")
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.cumsum(n) - n
        for i in full:  # one sum over each text's rows
            ones = bits[starts[i] : starts[i] + n[i]].sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > n[i], bitorder="little").view("<u8")[0]
    return out


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            fp = fingerprints(byte_values(batch.column("text"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Points of a metric; a node's children are keyed by their integer Hamming distance to it."""

    def __init__(self) -> None:
        self.points: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, point: int, radius: int) -> Iterator[int]:
        """Numbers of the nodes within the radius, by the edges that may lead to one."""
        stack = [0] if self.points else []
        while stack:
            node = stack.pop()
            distance = (point ^ self.points[node]).bit_count()
            if distance <= radius:
                yield node
            stack += [child for key, child in self.children[node].items() if distance - radius <= key <= distance + radius]

    def add(self, point: int) -> None:
        node, new = 0, len(self.points)
        self.points.append(point)
        self.children.append({})
        while node != new:
            node = self.children[node].setdefault((point ^ self.points[node]).bit_count(), new)


class Forest:
    """Disjoint sets of numbers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether they were apart."""
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def shard_links(points: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct points, as pairs of their places."""
    tree, forest, found = BKTree(), Forest(len(points)), []
    for i, point in enumerate(points):
        found += [(j, i) for j in tree.near(point, radius) if forest.join(i, j)]
        tree.add(point)
    return found


def bit_groups(mask: int, radius: int) -> list[int]:
    """``mask`` with each of radius + 1 groups of the bits that it leaves open."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _dealt(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """(mask, value, fp): each fingerprint for each finer mask of its own."""
    finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(g)) for g in bit_groups(m, radius)]))])
    each = rows.select("fp", F.explode(finer[F.col("mask")]).alias("mask"))
    return each.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def chunk_pairs(rows: DataFrame, n: str, by: str, size: int) -> DataFrame:
    """Adds ``low`` and ``high``, two chunks that meet, to rows of groups of ``n`` rows: chunks hold about ``size``."""
    chunks = F.ceil(F.col(n) / size).cast("int")
    own = F.pmod(F.xxhash64(by), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(own, j).alias("low"), F.greatest(own, j).alias("high")))
    return rows.withColumn("pair", F.explode(pairs)).withColumn("low", F.col("pair.low")).withColumn("high", F.col("pair.high")).drop("pair", n)


def shards(points: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(mask, value, low, high, fp): every fingerprint in groups of bounded size, such that those within the radius meet in one."""
    masks, settled, whole = [0], [], F.lit(0)
    rows = points.select("fp", F.lit(0).cast("long").alias("mask"))
    for _ in range(CUTS):
        dealt = _dealt(rows, masks, radius)
        full = materialize(dealt.groupBy("mask", "value").agg(F.count("*").alias("n")).filter(F.col("n") > shard), "full-shards")
        masks = [m % (1 << 64) for (m,) in full.select("mask").distinct().collect()]  # (radius + 1) ** CUTS at most
        small = dealt.join(full, ["mask", "value"], "left_anti") if masks else dealt
        settled.append(small.withColumn("low", whole).withColumn("high", whole))
        if not masks:
            break
        met = dealt.join(full, ["mask", "value"])
        rows = met.select("fp", "mask")
    else:
        settled.append(chunk_pairs(met, "n", "fp", shard))
    return reduce(DataFrame.unionByName, settled).select("mask", "value", "low", "high", "fp")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut only between different values of the first ``keys`` columns."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        if not len(columns[0]):
            continue
        last = np.ones(len(columns[0]), dtype=bool)
        for k in columns[:keys]:
            last &= k == k[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        held = [c[cut:] for c in columns]
        if cut:
            yield [c[:cut] for c in columns]
    if held is not None and len(held[0]):
        yield held


def groups(columns: list[np.ndarray]) -> list[tuple[int, int]]:
    """Where groups of two rows and more of equal keys begin and end."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in columns], axis=0)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(new))
    some = ends - starts > 1
    return list(zip(starts[some].tolist(), ends[some].tolist()))


def links(points: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that span each class of links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *key, fp in runs(batches, 4):
            places, found = fp.view(np.uint64).tolist(), []
            for a, z in groups(key):
                found += [(a + i, a + j) for i, j in shard_links(places[a:z], radius)]
            ends = np.array(found, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(fp[ends[:, 0]]), pa.array(fp[ends[:, 1]])], ["a", "b"])

    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["mask", "value", "low", "high"]
    dealt = shards(points, radius, shard).repartition(n, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, unnamed: bool = False) -> DataFrame:
    """doc_id, fp and component_id of every document; ``unnamed`` ones, without a doc_id, link if asked for."""
    table = materialize(fingerprinted(docs), "fingerprints")
    named = table if unnamed else table.filter("doc_id is not null")
    points = materialize(named.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    labels = components(links(points, radius))
    linked = materialize(points.join(labels, F.col("fp") == F.col("node")).select("fp", "least", "label"), "linked")
    firsts = linked.groupBy("label").agg(F.min("least").alias("first"))
    of_linked = linked.join(firsts, "label").select(F.col("fp").alias("of"), "first")
    # a fingerprint without links is a class of its own
    classes = materialize(of_linked.unionByName(points.join(linked, "fp", "left_anti").select(F.col("fp").alias("of"), F.col("least").alias("first"))), "classes")
    drop(points)
    drop(linked)
    own = F.col("first") if unnamed else F.when(F.col("doc_id").isNotNull(), F.col("first"))
    return table.join(classes, F.col("fp") == F.col("of"), "left").select("doc_id", "fp", own.alias("component_id"))
