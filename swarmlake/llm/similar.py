"""Texts of similar word shingles: SimHash near-duplicates beyond a few bits (operator 2 in the pipeline).

A text is its set of ``width``-word shingles (fewer words: the whole sequence),
lower-cased (A-Z). Two texts are near-duplicates if the Jaccard similarity of their
sets is at least ``least``; at 0.8, SimHashes of 64 bits differ in ten bits on
average, so no group of bits need agree. Shards are therefore named by shingles: a
text is in those of its ``NAMES`` smallest shingle hashes, which two texts of
similarity 0.8 share but for a chance of 0.2 ** NAMES. In a shard the SimHashes
form a BK-tree; each text meets those within ``RADIUS`` bits. Counts of a text's
shingles in ``SPREAD`` buckets bound what two texts can share, so most pairs that are
not similar end there; only texts with a partner left send their shingles, and to
the first shard alone of those where the two meet. A shard of over ``SHARD`` texts is named more closely, by
one more of a text's smallest hashes (sets of fewer hashes are never similar to
others); one that ``CUTS`` hashes leave too large is cut in chunks, every two of
which meet. So texts that share a frequent passage and no more part company.

That finds nearly all links, but by chance and by the radius not all. What is missed is
found exactly: of two similar sets, ordered by the frequency of their hashes (in
``SLOTS`` counters over all texts; any order that is one for all texts is exact), the
rarest fifths hold a common hash. So all texts are named by each hash of theirs, and
names under which texts of different classes stand are looked at again: by size, by
how many hashes can follow in both, by the bucket counts, and by the sets themselves.
Names whose texts are in one class already, which are nearly all, end as one row.

Texts of equal sets are one text in all this, so copies cost a row each. Texts
without words are equal. Every row is judged for itself: null and repeated doc_ids
and rows are rows like others; of a class, the row with the smallest doc_id stays
(null last; the first by position among equals). Other columns are carried along,
whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .backoff import tokens
from .batches import distinct, mixed, numbered, renamed, slices, word_hash
from .components import components
from .scratch import drop, materialize
from .simhash import BKTree, Forest, chunk_pairs, groups, runs

WIDTH = 5
LEAST = 0.8
NAMES = 6
CUTS = 3
RADIUS = 22
SHARD = 2048
SPREAD = 128
SLOTS = 1 << 16


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    coded, counts = tokens(texts)
    hashes = np.fromiter((word_hash(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    word = hashes[coded.indices.to_numpy()] if len(hashes) else hashes
    at = 0
    for n in counts.tolist():
        some, wide = word[at : at + n], min(width, n)
        at += n
        if not n:
            yield some
            continue
        shingle = some[: n - wide + 1]
        for k in range(1, wide):
            shingle = mixed(shingle, some[k : n - wide + 1 + k])
        yield distinct(shingle)


def simhash(shingles: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingles), bitorder="little").view("<u8")[0])


def sketched(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """row, doc_id, what tells its set from others, its SimHash, its smallest hashes, its shingles' number and their counts by bucket.

    One more row a task, of a negative number, has the counts of all its hashes by slot in ``spread``.
    """

    columns = ["row", "doc_id", "same", "fp", "names", "size", "spread"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(SLOTS, dtype=np.int64)
        for batch in slices(batches, "text", 4 << 20):
            same, fp, names, size, spread = [], [], [], [], []
            for found in shingle_sets(batch.column("text"), width):
                slots += np.bincount((found % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS) if len(found) > SLOTS // 8 else 0
                if len(found) <= SLOTS // 8:
                    np.add.at(slots, (found % np.uint64(SLOTS)).astype(np.int64), 1)
                same.append(int(mixed(found, found[::-1]).sum(dtype=np.uint64)) ^ len(found))
                fp.append(simhash(found))
                names.append(found[:NAMES].view(np.int64).tolist())
                low = _low(found)
                size.append(len(low))
                spread.append(np.minimum(np.bincount((low % SPREAD).astype(np.int64), minlength=SPREAD), 255).astype(np.uint8).tobytes())
            signed = lambda x: pa.array(np.array(x, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), signed(same), signed(fp), pa.array(names, pa.list_(pa.int64())), pa.array(size, pa.int64()), pa.array(spread, pa.binary())], columns)
        nothing = pa.array([None], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([-1 - TaskContext.get().partitionId()]), nothing, nothing, nothing, pa.array([None], pa.list_(pa.int64())), nothing, pa.array([slots.tobytes()], pa.binary())], columns)

    return rows.mapInArrow(run, "row long, doc_id long, same long, fp long, names array<long>, size long, spread binary")


def shards(texts: DataFrame, shard: int = SHARD) -> DataFrame:
    """(name, low, high, rep, fp, whole): texts in shards of bounded size.

    ``low`` and ``high`` are the chunks that meet; ``whole`` shards are those named by one hash, where all its texts meet.
    """
    settled = []
    rows = texts.select("rep", "fp", F.col("names").alias("left"), F.lit(0).cast("long").alias("name"))
    for cut in range(CUTS):
        # one more hash; ascending, so a name stands for a set of hashes
        dealt = rows.select("rep", "fp", "left", "name", F.posexplode("left").alias("at", "hash"))
        dealt = dealt.select("rep", "fp", F.expr("slice(left, at + 2, size(left))").alias("left"), F.xxhash64("name", "hash").alias("name"))
        counts = materialize(dealt.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1"), "shard-sizes")
        full = counts.filter(F.col("n") > shard)
        small = counts.filter(F.col("n") <= shard).select("name")
        zero = F.lit(0)
        settled.append(dealt.join(small, "name", "left_semi").select("name", zero.alias("low"), zero.alias("high"), "rep", "fp", F.lit(cut == 0).alias("whole")))
        if full.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        met = dealt.join(full, "name")
        rows = met.select("rep", "fp", "left", "name")
    return reduce(DataFrame.unionByName, [*settled, chunk_pairs(met, "n", "rep", shard).select("name", "low", "high", "rep", "fp", F.lit(False).alias("whole"))])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def _sorted(rows: DataFrame, keys: tuple[str, ...] = ("name", "low", "high")) -> DataFrame:
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)


def described(placed: DataFrame, sketches: DataFrame) -> DataFrame:
    """Adds the whole shards that a text is in, and its shingles' number and counts by bucket."""
    homes = F.collect_list(F.when(F.col("whole"), F.col("name"))).over(Window.partitionBy("rep"))
    return placed.withColumn("homes", homes).drop("whole").join(sketches.select(F.col("row").alias("rep"), "size", "spread"), "rep")


def may_reach(least: float, size: np.ndarray, spread: np.ndarray, i: int, others: list[int]) -> list[int]:
    """Those of the rows ``others`` whose similarity to row ``i`` may be ``least``: no bucket can share more than its lesser count."""
    some = np.array(others)
    common = np.minimum(spread[some], spread[i])
    shared = np.where((common == 255).any(axis=1), np.minimum(size[some], size[i]), common.sum(axis=1, dtype=np.int64))
    return some[shared >= least * (size[some] + size[i] - shared)].tolist()


def neighbours(placed: DataFrame, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """The rows of shards that may be similar to another there, and do not meet it in a whole shard of a smaller name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *key, rep, fp, size, spread, homes in runs(batches, 3):
            near = np.zeros(len(rep), dtype=bool)
            buckets = np.frombuffer(b"".join(spread), dtype=np.uint8).reshape(-1, SPREAD)
            for start, end in groups(key):
                tree, name, own = BKTree(), key[0][start], [set(h) for h in homes[start:end]]
                for i, point in enumerate(fp[start:end].view(np.uint64).tolist()):
                    met = list(tree.near(point, radius))
                    for j in may_reach(least, size[start:end], buckets[start:end], i, met) if met else met:
                        if not (near[start + i] and near[start + j]) and min(own[i] & own[j], default=name) >= name:
                            near[start + i] = near[start + j] = True
                    tree.add(point)
            yield pa.RecordBatch.from_arrays([pa.array(c[near]) for c in (*key, rep, fp)], ["name", "low", "high", "rep", "fp"])

    return _sorted(placed.select("name", "low", "high", "rep", "fp", "size", "spread", "homes")).mapInArrow(run, "name long, low int, high int, rep long, fp long")


def links(near: DataFrame, sets: DataFrame, least: float = LEAST, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between texts ``rep`` of similarity ``least`` and more, which span each class; ``sets`` has their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *key, rep, fp, data in runs(batches, 3):
            a, b = [], []
            for start, end in groups(key):
                points = fp[start:end].view(np.uint64).tolist()
                shingles = [np.frombuffer(x, dtype=np.uint32) for x in data[start:end]]
                tree, forest = BKTree(), Forest(len(points))
                for i, point in enumerate(points):
                    for j in tree.near(point, radius):
                        if forest.root(i) == forest.root(j) or not least <= len(shingles[j]) / len(shingles[i]) <= 1 / least:
                            continue
                        if similarity(shingles[i], shingles[j]) >= least:
                            forest.join(i, j)
                            a.append(rep[start + i])
                            b.append(rep[start + j])
                    tree.add(point)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _sorted(near.join(sets, "rep").select("name", "low", "high", "rep", "fp", "shingles")).mapInArrow(run, "a long, b long")


def slot_counts(rows: DataFrame) -> np.ndarray:
    """The sum of the tasks' counts by slot: SLOTS numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("spread").to_pylist():
                n = np.frombuffer(packed, dtype=np.int64)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["slot", "n"])

    found = rows.select("spread").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SLOTS, dtype=np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return out


def prefixes(texts: DataFrame, counts: np.ndarray, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(token, rep, at, size): the rarest hashes of each text, as many as must hold one that any similar text has among its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            tokens, sizes, taken = [], [], []
            for found in shingle_sets(batch.column("text"), width):
                n = len(found)
                k = n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0
                order = np.lexsort((found, counts[(found % np.uint64(SLOTS)).astype(np.int64)]))[:k]
                tokens.append(found[order])
                sizes.append(n)
                taken.append(k)
            at = np.concatenate([np.arange(k) for k in taken]) if taken else np.empty(0)
            token = np.concatenate(tokens).view(np.int64) if tokens else np.empty(0, dtype=np.int64)
            rep = np.repeat(batch.column("row").to_numpy(), taken)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(rep), pa.array(at.astype(np.int32)), pa.array(np.repeat(sizes, taken).astype(np.int32))], ["token", "rep", "at", "size"])

    return texts.mapInArrow(run, "token long, rep long, at int, size int")


def may_pair(least: float, size: np.ndarray, at: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Those of ``others`` whose sizes are near enough to i's, and with enough hashes after the common one, were it their first."""
    n, m = size[i], size[others]
    need = np.ceil(least / (1 + least) * (n + m) - 1e-9)
    can = np.minimum(n - at[i], m - at[others])
    return others[(np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9) & (can >= need)]


def crossing(tokens: DataFrame, labels: DataFrame, sketches: DataFrame, least: float = LEAST, shard: int = SHARD) -> DataFrame | None:
    """(name, rep, label): texts of several classes under names, which may be similar to another there; each pair meets under one name.

    Texts of about a size share a name: ``step`` is the size on the scale of ``least``, and
    a text is also a guest at the next step.
    """
    node = labels.select(F.col("node").alias("of"), F.col("label"))
    named = materialize(tokens.join(node, F.col("rep") == F.col("of"), "left").select("token", "rep", "at", "size", F.coalesce("label", "rep").alias("label")), "named-texts")
    step = F.floor(F.log("size") / (-np.log(least) * 1.0001)).cast("int")
    both = named.groupBy("token").agg(F.min("label").alias("first"), F.max("label").alias("last")).filter("first < last").select("token")
    mixed = named.join(both, "token").withColumn("own", step).withColumn("step", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    mixed = mixed.select(F.xxhash64("token", "step").alias("name"), "rep", "label", "at", "size", "step", (F.col("own") == F.col("step")).alias("fresh"))
    mixed = materialize(mixed, "mixed-names")
    drop(named)
    if mixed.isEmpty():
        return None
    counts = mixed.groupBy("name").agg(F.count("*").alias("n"), F.min("label").alias("first"), F.max("label").alias("last"), F.max("fresh").alias("some"))
    counts = counts.filter("first < last and some").select("name", "n")
    placed = chunk_pairs(mixed.join(counts, "name"), "n", "rep", shard)
    placed = placed.join(sketches.select(F.col("row").alias("of"), F.col("size").alias("low_size"), "spread"), F.col("rep") == F.col("of"))
    keys = ["name", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *key, rep, label, at, size, fresh, low_size, spread in runs(batches, 3):
            near = np.zeros(len(rep), dtype=bool)
            buckets = np.frombuffer(b"".join(spread), dtype=np.uint8).reshape(-1, SPREAD)
            for start, end in groups(key):
                cut = slice(start, end)
                labelled, new = label[cut], fresh[cut]
                for i in range(1, end - start):
                    others = np.flatnonzero((labelled[:i] != labelled[i]) & (new[:i] | new[i]) & ~(near[start : start + i] & near[start + i]))
                    others = may_pair(least, size[cut], at[cut], i, others)
                    if len(others):
                        for j in may_reach(least, low_size[cut], buckets[cut], i, others):
                            near[start + i] = near[start + j] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[near]) for c in (*key, rep, label)], [*keys, "rep", "label"])

    found = _sorted(placed.select(*keys, "rep", "label", "at", "size", "fresh", "low_size", "spread")).mapInArrow(run, "name long, low int, high int, rep long, label long")
    found = materialize(found.select(F.xxhash64(*keys).alias("name"), "rep", "label"), "crossing")
    drop(mixed)
    once = materialize(met_once(found, sketches, least), "crossing")
    drop(found)
    return once


def met_once(near: DataFrame, sketches: DataFrame, least: float = LEAST) -> DataFrame:
    """Those rows (name, rep, label) that have to meet another under this name: a pair meets under the smallest name of both."""
    homes = near.groupBy(F.col("rep").alias("of")).agg(F.collect_set("name").alias("homes"))  # as many as a text has rare hashes
    bounds = sketches.select(F.col("row").alias("at_row"), "size", "spread")
    placed = near.join(homes, F.col("rep") == F.col("of")).join(bounds, F.col("rep") == F.col("at_row")).select("name", "rep", "label", "size", "spread", "homes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rep, label, size, spread, homes_of in runs(batches, 1):
            kept = np.zeros(len(rep), dtype=bool)
            buckets = np.frombuffer(b"".join(spread), dtype=np.uint8).reshape(-1, SPREAD)
            for start, end in groups([name]):
                cut, own = slice(start, end), [set(h) for h in homes_of[start:end]]
                for i in range(1, end - start):
                    others = np.flatnonzero((label[cut][:i] != label[start + i]) & ~(kept[start : start + i] & kept[start + i]))
                    n, m = size[start + i], size[cut][others]
                    others = others[np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9]
                    if len(others):
                        for j in may_reach(least, size[cut], buckets[cut], i, others):
                            if not (kept[start + i] and kept[start + j]) and min(own[i] & own[j]) == name[start]:
                                kept[start + i] = kept[start + j] = True
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (name, rep, label)], ["name", "rep", "label"])

    return _sorted(placed, ("name",)).mapInArrow(run, "name long, rep long, label long")


def cross_links(near: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """Edges (a, b) between similar texts of different classes, which span what they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, rep, label, data in runs(batches, 1):
            a, b = [], []
            for start, end in groups([name]):
                shingles = [np.frombuffer(x, dtype=np.uint32) for x in data[start:end]]
                size = np.array([len(x) for x in shingles])
                classes, number = np.unique(label[start:end], return_inverse=True)
                forest = Forest(len(classes))
                for i in range(1, end - start):
                    fits = np.minimum(size[:i], size[i]) >= least * np.maximum(size[:i], size[i]) - 1e-9
                    for j in np.flatnonzero((number[:i] != number[i]) & fits).tolist():
                        if forest.root(number[i]) != forest.root(number[j]) and similarity(shingles[i], shingles[j]) >= least:
                            forest.join(number[i], number[j])
                            a.append(rep[start + i])
                            b.append(rep[start + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _sorted(near.join(sets, "rep").select("name", "rep", "label", "shingles"), ("name",)).mapInArrow(run, "a long, b long")


def bitmaps(ids: DataFrame) -> DataFrame:
    """The numbers ``row`` as (bucket, bits): one bit a number, 32,768 numbers a bucket."""
    dealt = ids.select("row", F.bitmap_bucket_number("row").alias("bucket")).repartition("bucket")
    return materialize(dealt.groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits")), "bitmaps")


def chosen(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """Those of ``rows`` whose number ``row`` is in ``bits``.

    Numbers of rows are dense, so a bit does for each, and texts need not move to
    meet them until there are 64 times as many as Spark would broadcast as numbers.
    """
    at = F.bitmap_bit_position(rows["row"])
    byte = F.conv(F.hex(F.substring(bits["bits"], F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    same = F.bitmap_bucket_number(rows["row"]) == bits["bucket"]
    return rows.join(bits, same & (F.getbit(byte, (at % 8).cast("int")) == 1), "left_semi")


def keep_one(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """One row of ``docs`` for each class of near-duplicates, with its columns as they are."""
    plain, names = numbered(docs)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row + np.arange(batch.num_rows))], [*batch.schema.names, "row"])
            row += batch.num_rows

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema), "row long"])
    rows = materialize(plain.mapInArrow(number, schema), "numbered")
    of = lambda c: F.col(names[docs.columns.index(c)])
    texts = rows.select("row", of("doc_id").cast("long").alias("doc_id"), of("text").alias("text"))
    every = materialize(sketched(texts, width), "sketches")
    sketches, counts = every.filter("row >= 0"), slot_counts(every.filter("row < 0"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    classes = materialize(sketches.groupBy("same").agg(F.min(order).alias("first"), F.min(F.struct("row", "fp", "names")).alias("of")).select("first", "of.row", "of.fp", "of.names"), "texts")

    def sets_of(near: DataFrame) -> DataFrame:
        def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 4 << 20):
                found = [_low(x).astype(np.uint32).tobytes() for x in shingle_sets(batch.column("text"), width)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.binary())], ["rep", "shingles"])

        asked = bitmaps(near.select(F.col("rep").alias("row")))
        out = materialize(chosen(texts.select("row", "text"), asked).mapInArrow(shingles, "rep long, shingles binary"), "sets")
        drop(asked)
        return out

    placed = shards(classes.select(F.col("row").alias("rep"), "fp", "names"))
    near = materialize(neighbours(described(placed, sketches), least), "neighbours")
    sets = sets_of(near)
    edges = materialize(links(near, sets, least), "links")
    drop(sets)
    drop(near)
    labels = components(edges)
    one_each = bitmaps(classes.select("row"))
    tokens = prefixes(chosen(texts.select("row", "text"), one_each), counts, width, least)
    missed = crossing(tokens, labels, sketches, least)
    drop(one_each)
    if missed is not None and not missed.isEmpty():
        sets = sets_of(missed)
        more = materialize(cross_links(missed, sets, least), "links")
        drop(sets)
        if not more.isEmpty():
            drop(labels)
            labels = components(edges.unionByName(more))
        drop(more)
    drop(edges)
    drop(every)
    met = classes.join(labels, F.col("row") == F.col("node"), "left")
    stays = met.groupBy(F.coalesce("label", "row").alias("label")).agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    kept = bitmaps(stays)
    drop(classes)
    drop(labels)
    return renamed(chosen(rows, kept), names, docs.columns)


def _low(hashes: np.ndarray) -> np.ndarray:
    return distinct(hashes & np.uint64(0xFFFFFFFF))
