"""Token files coded by a static range asymmetric numeral system (operator 5).

File format: a Parquet table of blocks, in ascending doc_id order within a file
and from file to file (column ``range``). A block codes the ids of whole
documents on interleaved lanes with one frequency table shared by all blocks (a
one-row table beside them). Each block
carries its checkpoint (position of its first id in the range, lane states), the
bounds of its documents, and a CRC-32 of its words and of its ids, so any block
is decoded and verified alone.

Null and empty texts hold the end id only. Repeated doc_ids stand for themselves,
in the order of their digests. Null doc_ids come first. Other columns are
ignored; an empty table gives no blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import slices
from .scratch import drop, materialize
from .tokens import encoder

SCALE = 20  # bits of a frequency table's total
LOW = 1 << 31  # smallest lane state; words have 32 bits
BLOCK = 1 << 19  # ids in a block, about
LANES = 1 << 11

TOKENS = "range int, doc_id long, n_tokens long, ids binary"
PLACED = TOKENS + ", place long, ids_before long"
BLOCKS = "range int, block int, doc_ids array<long>, counts array<long>, n_ids long, lanes int, states binary, words binary, words_crc32 long, ids_crc32 long, ids_before long"


def scaled(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies that sum to 2**scale, each id at least 1."""
    total = 1 << scale
    room = total - len(counts)
    freq = 1 + np.floor(counts * (room / max(1, int(counts.sum())))).astype(np.int64)
    freq[int(np.argmax(freq))] += total - int(freq.sum())
    return freq


class Coder:
    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.scale = np.uint64(scale)
        self.mask = np.uint64((1 << scale) - 1)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.limit = np.uint64((LOW >> scale) << 32)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
        """Lane states and 32-bit words; id i lies on lane i % lanes."""
        lanes = max(1, min(lanes, len(ids)))
        state = np.full(lanes, LOW, dtype=np.uint64)
        freq, start, out = self.freq[ids], self.start[ids], []
        for a in range((len(ids) - 1) // lanes * lanes, -1, -lanes):
            f, s = freq[a : a + lanes], start[a : a + lanes]
            x = state[: len(f)]
            over = x >= self.limit * f
            out.append((x[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(over, x >> np.uint64(32), x)
            q = x // f
            state[: len(f)] = (q << self.scale) + (x - q * f) + s
        return state, np.concatenate(out[::-1]) if out else np.empty(0, dtype="<u4")

    def decode(self, n: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        lanes = len(states)
        ids, state, at = np.empty(n, dtype=np.uint32), states.astype(np.uint64), 0
        wide = words.astype(np.uint64)
        for a in range(0, n, lanes):
            m = min(lanes, n - a)
            x = state[:m]
            slot = x & self.mask
            symbol = self.symbol[slot.astype(np.int64)]
            ids[a : a + m] = symbol
            x = self.freq[symbol] * (x >> self.scale) + slot - self.start[symbol]
            low = np.flatnonzero(x < np.uint64(LOW))
            x[low] = (x[low] << np.uint64(32)) | wide[at : at + len(low)]
            at += len(low)
            state[:m] = x
        return ids


def ranges(docs: DataFrame, n: int) -> list[int]:
    """Bounds that cut the doc_ids into about ``n`` ranges of equal counts; bounds only steer the deal, any would do."""
    if n < 2:
        return []
    found = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("b")).first()["b"]
    return sorted(set(found or []))


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int]) -> DataFrame:
    """Ids of each document with the end id, and the range of its doc_id (null: the first)."""
    limits = np.array(bounds, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = _width(tokenizer)
        for batch in slices(batches, "text"):
            ids, counts = encoder(tokenizer).encode(batch.column("text"))
            marked = np.insert(ids.astype(width), np.cumsum(counts), end_id)
            cuts = np.concatenate([[0], np.cumsum(counts + 1)]).tolist()
            blobs = [marked[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            doc = batch.column("doc_id")
            known = pc.fill_null(doc, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            rng = pa.array(np.searchsorted(limits, known), pa.int32())
            yield pa.RecordBatch.from_arrays([rng, doc, pa.array(counts + 1, pa.int64()), pa.array(blobs, pa.binary())], ["range", "doc_id", "n_tokens", "ids"])

    return docs.mapInArrow(run, TOKENS)


def placed(tokens: DataFrame) -> DataFrame:
    """Adds the numbers of documents and of ids before each in its range, where whole ranges lie in order in one task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, n_docs, n_ids = None, 0, 0
        for batch in slices(batches, "ids"):
            own = batch.column("range").to_numpy()
            n = batch.column("n_tokens").to_numpy()
            place, before = np.empty(len(n), dtype=np.int64), np.empty(len(n), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(n)]
            for a, b in zip(cuts, cuts[1:]):
                if own[a] != rng:
                    rng, n_docs, n_ids = own[a], 0, 0
                place[a:b] = n_docs + np.arange(b - a)
                before[a:b] = n_ids + np.cumsum(n[a:b]) - n[a:b]
                n_docs, n_ids = n_docs + b - a, n_ids + int(n[a:b].sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(before)], [*batch.schema.names, "place", "ids_before"])

    return tokens.mapInArrow(run, PLACED)


def _width(tokenizer: str) -> str:
    return "<u2" if len(encoder(tokenizer).token_bytes) <= 1 << 16 else "<u4"


def frequencies(tokens: DataFrame, tokenizer: str) -> np.ndarray:
    """How often each id stands in all documents; at most a vocabulary of rows reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(encoder(tokenizer).token_bytes)
        total, width = np.zeros(size, dtype=np.int64), _width(tokenizer)
        for batch in slices(batches, "ids"):
            data = b"".join(batch.column("ids").to_pylist())
            total += np.bincount(np.frombuffer(data, dtype=width), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["id", "n"])

    found = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(encoder(tokenizer).token_bytes), dtype=np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    return counts


def blocks(tokens: DataFrame, tokenizer: str, freq: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Coded blocks of placed tokens, of which each task holds runs in order; a block is named by the place of its first document."""
    shared = tokens.sparkSession.sparkContext.broadcast(freq)  # as long as the vocabulary

    schema = pa.schema(
        [
            ("range", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
            ("n_ids", pa.int64()), ("lanes", pa.int32()), ("states", pa.binary()), ("words", pa.binary()),
            ("words_crc32", pa.int64()), ("ids_crc32", pa.int64()), ("ids_before", pa.int64()),
        ]
    )

    def code(coder: Coder, rng: int, number: int, before: int, docs: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        ids = np.concatenate(parts)
        states, words = coder.encode(ids)
        payload = words.tobytes()
        row = [
            rng, number, docs, [len(p) for p in parts], len(ids), len(states), states.astype("<u8").tobytes(), payload,
            zlib.crc32(payload), zlib.crc32(ids.astype("<u4").tobytes()), before,
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, width = Coder(shared.value), _width(tokenizer)
        rng, number, before, held, due = None, 0, 0, 0, 0
        docs: list = []
        parts: list[np.ndarray] = []
        for batch in slices(batches, "ids"):
            for r, doc, blob, place, start in zip(*(batch.column(c).to_pylist() for c in ("range", "doc_id", "ids", "place", "ids_before"))):
                ids = np.frombuffer(blob, dtype=width)
                if docs and (r != rng or place != due or held + len(ids) > block):
                    yield code(coder, rng, number, before, docs, parts)
                    docs, parts = [], []
                if not docs:
                    rng, number, before, held = r, place, start, 0
                docs.append(doc)
                parts.append(ids)
                held, due = held + len(ids), place + 1
        if docs:
            yield code(coder, rng, number, before, docs, parts)

    return tokens.mapInArrow(run, BLOCKS)


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> str:
    """Writes the token files of ``docs`` (doc_id, text) under ``path``: blocks and the shared table."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = ranges(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = tokenized(docs, tokenizer, end_id, bounds).repartitionById(len(bounds) + 1, F.col("range"))
    ordered = dealt.sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), F.crc32("ids"))
    tokens = materialize(placed(ordered), "tokens")
    table = scaled(frequencies(tokens, tokenizer))
    spark.createDataFrame([(table.astype("<i8").tobytes(),)], "freq binary").coalesce(1).write.parquet(f"{path}/table")
    # a range's file may be read back by several tasks; each document has brought its place along
    blocks(tokens, tokenizer, table).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    drop(tokens)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of token files, each block decoded and verified alone: doc_id, start, n_tokens, ids, ids_crc32."""
    coded = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    table = spark.read.parquet(f"{path}/table").first()["freq"]
    shared = spark.sparkContext.broadcast(np.frombuffer(table, dtype="<i8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in slices(batches, "words"):
            for row in batch.to_pylist():
                if zlib.crc32(row["words"]) != row["words_crc32"]:
                    raise ValueError(f"range {row['range']}, block {row['block']}: damaged words")
                ids = coder.decode(row["n_ids"], np.frombuffer(row["states"], dtype="<u8"), np.frombuffer(row["words"], dtype="<u4"))
                wide = ids.astype("<u4")
                if zlib.crc32(wide) != row["ids_crc32"]:
                    raise ValueError(f"range {row['range']}, block {row['block']}: wrong ids")
                cuts = np.concatenate([[0], np.cumsum(row["counts"])])
                blobs = [wide[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["start"] + cuts[:-1], pa.int64()),
                        pa.array(row["counts"], pa.int64()),
                        pa.array(blobs, pa.binary()),
                        pa.array([zlib.crc32(x) for x in blobs], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    # as many rows as there are ranges
    sums = coded.groupBy("range").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = coded.join(F.broadcast(base), "range").withColumn("start", F.col("base") + F.col("ids_before"))
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
