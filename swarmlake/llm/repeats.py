"""Removal of long repeated byte strings by a family of sparse suffix arrays (operator 13).

Of each text's suffixes only those at anchors are kept: for every string of ``LONG``
bytes, the place in it whose first ``GRAM`` bytes have the least hash among those with
``CORE`` bytes after them inside the string (the first of equals). The choice depends on
the string alone, so equal strings have the same anchor, and about one suffix in 137 is
left. An array holds its suffixes ordered by the fingerprint of their first ``CORE``
bytes, so suffixes that share these lie together; the order of the bytes themselves is
of no use here and is not kept.

A new batch gets its own array. Merge-scans of it, within itself and against every level
of the family, give the fingerprints that stand at two places or more: only there can
long matches be. Levels of equal size then merge, so an index of n batches has at most
log2(n) + 1 levels, and a suffix is written again as often. Matches are then settled for
the whole family: the bytes around an anchor are compared in blocks of places where a
string may start. If all that a block's strings cover (its hull) occurs twice, each of
them does; if what they have in common (its core) occurs once, none does; other blocks
are cut, at last to one place, where both are the string itself. Of equal hulls one goes
on, so a passage that many texts share costs a row at its inside, and its ends a few.
Comparisons are by two 64-bit hashes, of the anchor's core and of the hull.

Equal texts are one text: of ``LONG`` bytes and more, all of such a text goes. Null and
empty texts have no bytes and lose none; texts, doc_ids and rows may repeat or be null,
each row is judged for itself. Other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import byte_values, slices
from .scratch import drop, materialize
from .similar import bitmaps, chosen

LONG = 400
CORE = 128
GRAM = 8
AROUND = LONG - CORE  # an anchor is at most so far behind the start of its string
BATCHES = 4
WIDTHS = (16, 1)  # of the blocks that a block is cut into, places
PIECE = 1 << 20  # places looked at together
EMPTY = hashlib.sha256(b"").hexdigest()


def grams(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    out = np.empty(n, dtype=np.uint64)
    for i in range(GRAM):
        some = data[i : i + (n - i + GRAM - 1) // GRAM * GRAM]
        out[i::GRAM] = np.frombuffer(some.tobytes(), dtype="<u8")
    return (out * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of the least; of equals the first. Windows of a power of two double."""
    low, at, span = values, np.arange(len(values), dtype=np.int32), 1

    def joined(step: int) -> tuple[np.ndarray, np.ndarray]:
        right = low[step:] < low[: len(low) - step]
        return np.minimum(low[step:], low[: len(low) - step]), np.where(right, at[step:], at[: len(at) - step])

    while 2 * span <= width:
        low, at = joined(span)
        span *= 2
    if span < width:
        low, at = joined(width - span)
    return at


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and the first and last start of the strings it stands for, of each anchor of the texts ``data[starts:ends]``."""
    found = []
    array = np.frombuffer(data, dtype=np.uint8)
    for begin in range(0, len(data) - LONG + 1, PIECE):
        end = min(begin + PIECE, len(data) - LONG + 1)  # starts of strings
        place = begin + least_places(grams(array[begin : end + AROUND + GRAM - 1]), AROUND + 1)[: end - begin].astype(np.int64)
        start = np.arange(begin, end)
        text = np.searchsorted(starts, start, side="right") - 1
        inside = start + LONG <= ends[text]
        start, place, text = start[inside], place[inside], text[inside]
        if len(start):
            new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])))
            found.append((text[new], place[new], start[new], start[np.append(new[1:], len(start)) - 1]))
    if not found:
        return (np.empty(0, dtype=np.int64),) * 4
    text, place, first, last = (np.concatenate(x) for x in zip(*found))
    new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))  # one may stand for strings of two pieces
    return text[new], place[new], first[new], last[np.append(new[1:], len(place)) - 1]


ENTRY = np.dtype([("core", "<i8"), ("hull", "<i8"), ("pos", "<u4"), ("near", "<u2"), ("far", "<u2"), ("cut", "<u1")])


def entries_of(data: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's anchors: fingerprints of core and hull, place, least and largest distance from the start of a string to it."""
    text, place, first, last = anchors(data, starts, ends)
    out = np.zeros(len(text), dtype=ENTRY)
    out["pos"], out["near"], out["far"] = place - starts[text], place - last, place - first
    out["cut"] = (place - AROUND < starts[text]) | (place + LONG > ends[text])
    digest, view = xxhash.xxh3_64_intdigest, memoryview(data)
    places, whole = place.tolist(), (out["cut"] == 0).tolist()
    out["core"] = np.array([digest(view[p : p + CORE]) for p in places], dtype=np.uint64).view(np.int64)
    out["hull"] = np.array([digest(view[p - AROUND : p + LONG], 1) if w else 0 for p, w in zip(places, whole)], dtype=np.uint64).view(np.int64)
    bounds = np.searchsorted(text, np.arange(len(starts) + 1))
    for a, b in zip(bounds, bounds[1:]):
        yield out[a:b]


def numbered(docs: DataFrame) -> DataFrame:
    """row, doc_id and text; written, so that a row keeps its number."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(batch.num_rows)), *batch.columns], ["row", "doc_id", "text"])
            row += batch.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(number, "row long, doc_id long, text string"), "numbered")


def sketched(rows: DataFrame) -> DataFrame:
    """row, doc_id, n_bytes, the digest of each text and its anchors, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            texts = byte_values(batch.column("text"))
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            ends = np.cumsum(sizes)
            data = b"".join(texts)
            packed = [e.tobytes() for e in entries_of(data, ends - sizes, ends)]
            digests = [hashlib.sha256(t).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], ["row", "doc_id", "n_bytes", "digest", "anchors"])

    return rows.mapInArrow(run, "row long, doc_id long, n_bytes long, digest binary, anchors binary")


def suffixes(sketches: DataFrame) -> DataFrame:
    """(core, hull, row, pos, near, far, cut): the anchors as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "anchors", 4 << 20):
            packed = batch.column("anchors").to_pylist()
            all_of = np.frombuffer(b"".join(packed), dtype=ENTRY)
            row = np.repeat(batch.column("row").to_numpy(), [len(p) // ENTRY.itemsize for p in packed])
            signed = lambda name, kind: pa.array(all_of[name].astype(kind))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([signed("core", np.int64), signed("hull", np.int64), pa.array(row), signed("pos", np.int64), signed("near", np.int32), signed("far", np.int32), pa.array(all_of["cut"] == 1)], ["core", "hull", "row", "pos", "near", "far", "cut"])

    return sketches.select("row", "anchors").mapInArrow(run, "core long, hull long, row long, pos long, near int, far int, cut boolean")


class SuffixFamily:
    """Levels of sparse suffix arrays; level k holds 2^k batches or nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.levels: dict[int, DataFrame] = {}
        self.repeated: list[DataFrame] = []  # fingerprints found twice, by batch

    def _array(self, entries: DataFrame) -> DataFrame:
        """``entries`` in the order of their fingerprints; equal ones by place, so that a frequent one spreads over ranges."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["core", "row", "pos"]
        return materialize(entries.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order), "suffix-array")

    def add(self, batch: DataFrame) -> DataFrame:
        """Takes up a batch of suffixes; gives the fingerprints that it shares with itself or with a level."""
        array = self._array(batch)
        counts = materialize(array.groupBy("core").agg(F.count("*").alias("n")), "suffix-counts")
        found = counts.filter("n > 1").select("core")
        for level in self.levels.values():
            found = found.unionByName(counts.select("core").join(level, "core", "left_semi"))
        found = materialize(found.distinct(), "repeated")
        drop(counts)
        self.repeated.append(found)
        k = 0
        while k in self.levels:
            older = self.levels.pop(k)
            merged = self._array(older.unionByName(array))
            drop(older)
            drop(array)
            array, k = merged, k + 1
        self.levels[k] = array
        return found

    def matches(self) -> DataFrame:
        """core of all fingerprints at two places or more."""
        out = self.repeated[0]
        for more in self.repeated[1:]:
            out = out.unionByName(more)
        return out.distinct()

    def close(self) -> None:
        for df in [*self.levels.values(), *self.repeated]:
            drop(df)


def settled(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The strings (row, start, end) that occur twice, and the blocks to cut.

    A block (core, low, common, hull, row, pos, high, near, far, open) is of the starts
    ``low`` to ``high`` before an anchor ``core`` at ``pos``; ``common`` and ``hull``
    are the fingerprints of its core and its hull, which is null where the text ends
    within it. Closed blocks stand for others, which are settled.
    """
    own = F.coalesce("hull", F.xxhash64("row", "pos"))
    named = blocks.withColumn("own", own).withColumn("whole", F.col("hull").isNotNull())
    key = ["core", "low", "common", "own", "whole"]
    one = F.min(F.struct("row", "pos", "high", "near", "far")).alias("one")
    # hulls that are cut are single, but for a chance hit of the name they have been given
    kinds = materialize(named.groupBy(*key).agg(F.count("*").alias("n"), F.max("open").alias("open"), one), "hulls")
    twice = kinds.filter("whole and n > 1 and open").select(*key)
    marks = named.filter("open and whole").join(twice, key, "left_semi").select("row", (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + LONG).alias("end"))
    left = F.col("open") & (~F.col("whole") | (F.col("n") == 1))
    several = kinds.groupBy("core", "low", "common").agg(F.count("*").alias("hulls"), F.max(left).alias("left")).filter("hulls > 1 and left").select("core", "low", "common")
    on = kinds.join(several, ["core", "low", "common"], "left_semi").select("core", "low", "one.*", left.alias("open"))
    return marks, on


def blocks_of(rows: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """The blocks ``asked``, cut to ``width`` starts, of which those that the anchor stands for, with their fingerprints."""
    by_text = asked.groupBy("row").agg(F.collect_list(F.struct("core", "pos", "low", "high", "near", "far", "open")).alias("asks"))  # as many as a text's bytes at most
    bits = bitmaps(by_text.select("row"))
    texts = chosen(rows.select("row", "text"), bits).join(by_text.withColumnRenamed("row", "of"), F.col("row") == F.col("of")).select("row", "text", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches, "text", 1 << 20):
            out: list[list] = [[] for _ in range(10)]
            for row, text, asks in zip(batch.column("row").to_pylist(), byte_values(batch.column("text")), batch.column("asks").to_pylist()):
                view, n = memoryview(text), len(text)
                for ask in asks:
                    core, pos, near, far = ask["core"], ask["pos"], ask["near"], ask["far"]
                    for low in range(ask["low"], ask["high"] + 1, width):
                        high = min(low + width - 1, ask["high"])
                        if low > far or high < near:
                            continue
                        cut = pos - high < 0 or pos - low + LONG > n
                        common = digest(view[max(pos - low, 0) : pos - high + LONG], 2)
                        hull = None if cut else digest(view[pos - high : pos - low + LONG], 3)
                        for column, value in zip(out, (core, low, common, hull, row, pos, high, near, far, ask["open"])):
                            column.append(value)
                if len(out[0]) > 50_000:
                    yield packed(out)
                    out = [[] for _ in range(10)]
            if out[0]:
                yield packed(out)

    def packed(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.uint64(), pa.uint64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
        arrays = [pa.array(c, k) for c, k in zip(out, kinds)]
        arrays = [a.view(pa.int64()) if a.type == pa.uint64() else a for a in arrays]
        return pa.RecordBatch.from_arrays(arrays, ["core", "low", "common", "hull", "row", "pos", "high", "near", "far", "open"])

    found = materialize(texts.mapInArrow(run, "core long, low int, common long, hull long, row long, pos long, high int, near int, far int, open boolean"), "blocks")
    drop(bits)
    return found


def repeated_strings(rows: DataFrame, sketches: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(row, start, end) of strings of LONG bytes and more in which every byte is in one that also starts elsewhere; they may overlap."""
    spark = rows.sparkSession
    family = SuffixFamily(spark)
    for k in range(batches):
        family.add(suffixes(sketches.filter(F.pmod(F.xxhash64("digest"), F.lit(batches)) == k)))
    own = F.when(~F.col("cut"), F.col("hull"))
    first = suffixes(sketches).join(family.matches(), "core", "left_semi").select("core", F.lit(0).alias("low"), F.col("core").alias("common"), own.alias("hull"), "row", "pos", F.lit(AROUND).alias("high"), "near", "far", F.lit(True).alias("open"))
    blocks = materialize(first, "blocks")
    family.close()
    found = []
    for width in (*WIDTHS, 0):
        marks, on = settled(blocks)
        found.append(materialize(marks, "marks"))
        if width:
            on = materialize(on, "open-blocks")
            drop(blocks)
            blocks = blocks_of(rows, on, width)
            drop(on)
    drop(blocks)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def union_of(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def kept_parts(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """row, kept, n_removed and n_spans of the texts that lose bytes; ``kept`` is what is left, in bytes."""
    by_text = materialize(marks.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")
    bits = bitmaps(by_text.select("row"))
    texts = chosen(rows.select("row", "text"), bits).join(by_text.withColumnRenamed("row", "of"), F.col("row") == F.col("of")).select("row", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            kept, removed, runs = [], [], []
            for text, spans in zip(byte_values(batch.column("text")), batch.column("spans").to_pylist()):
                gone = union_of([(s["start"], s["end"]) for s in spans])
                cuts = [0, *(x for span in gone for x in span), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                removed.append(sum(b - a for a, b in gone))
                runs.append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], ["row", "kept", "n_removed", "n_spans"])

    return texts.mapInArrow(run, "row long, kept binary, n_removed long, n_spans long")


def removed(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``."""
    rows = numbered(docs)
    sketches = materialize(sketched(rows), "sketches")
    texts = sketches.groupBy("digest").agg(F.min("row").alias("row"), F.count("*").alias("n"), F.max("n_bytes").alias("n_bytes"))
    texts = materialize(texts, "texts")
    ones = bitmaps(texts.filter(F.col("n_bytes") >= LONG).select("row"))
    marks = repeated_strings(rows, materialize(chosen(sketches.select("row", "digest", "anchors"), ones), "distinct-sketches"), batches)
    copies = bitmaps(sketches.join(texts.filter((F.col("n") > 1) & (F.col("n_bytes") >= LONG)).select("digest"), "digest", "left_semi").select("row"))
    parts = materialize(kept_parts(rows, marks).select(F.col("row").alias("of"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "parts")
    plain = sketches.select("row", "doc_id", "n_bytes", F.lower(F.hex("digest")).alias("sha256"))
    whole = chosen(plain, copies).select(F.col("row").alias("copy"))
    met = plain.join(parts, F.col("row") == F.col("of"), "left").join(whole, F.col("row") == F.col("copy"), "left")
    gone = F.col("copy").isNotNull()
    return met.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
