"""Best-fit packing by the linear grouping scheme (operator 10).

Documents become token pieces of at most ``capacity``; pieces fill as few
sequences as can be found. Only the histogram of piece lengths, at most
``capacity`` rows, reaches the driver, which plans whole classes of equal
lengths at once: lengths over ``capacity / SMALL`` are rounded up within groups
of equal cardinality, a linear program over configurations of the few rounded
sizes is solved by column generation, the true lengths take their slots, and
short pieces go where they fit best, as do the pieces of sequences that this
leaves with free room. The plan is a list of runs: so many pieces
of a length, by rank, to so many sequences. Tasks then look up each piece.

Null and empty texts are one piece holding the end id. Repeated rows are pieces
of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import slices
from .scratch import materialize
from .tokens import encoder

#: Pieces of capacity / SMALL or less are short: they are packed last.
SMALL = 8
GROUPS = 64
#: Tokens that a sequence of a solved configuration may leave free and yet stay as it is.
FREE = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece, with the writing task and the rank among that task's pieces of equal length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in slices(batches, "text"):
            ids, counts = encoder(tokenizer).encode(batch.column("text"))
            ends = np.cumsum(counts)
            wide = np.insert(ids.astype("<u4"), ends, end_id)
            total = counts + 1
            begin = np.cumsum(total) - total
            n_pieces = -(-total // capacity)
            doc = np.repeat(np.arange(len(total)), n_pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            stop = total[doc] - (n_pieces[doc] - 1 - piece) * capacity
            start = np.maximum(stop - capacity, 0)
            length = stop - start
            crc = [zlib.crc32(wide[a:b]) for a, b in zip((begin[doc] + start).tolist(), (begin[doc] + stop).tolist())]
            order = np.argsort(length, kind="stable")
            firsts = np.flatnonzero(np.diff(length[order], prepend=-1))
            rank = np.empty(len(doc), dtype=np.int64)
            rank[order] = np.arange(len(doc)) - np.repeat(firsts, np.diff(np.append(firsts, len(doc))))
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(doc), part), pa.int32()),
                    pa.array(rank, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns over a few sizes and how often to use each: column generation, rounded down, the rest by decreasing fit."""
    k = len(sizes)
    need = np.array(demand, dtype=np.float64)
    columns = np.diag([float(capacity // s) for s in sizes])
    x = need / np.diag(columns)
    for _ in range(40 * k):
        inverse = np.linalg.inv(columns)
        price = np.maximum(np.ones(k) @ inverse, 0)
        pattern = _knapsack(sizes, price, capacity)
        if pattern @ price <= 1 + 1e-7:
            break
        direction, x = inverse @ pattern, inverse @ need
        ratio = np.where(direction > 1e-9, x / np.maximum(direction, 1e-9), np.inf)
        columns[:, int(np.argmin(ratio))] = pattern
    x = np.linalg.solve(columns, need)
    times = np.floor(np.maximum(x, 0) + 1e-9).astype(np.int64)
    made = (columns @ times).astype(np.int64)
    plan = [(columns[:, j].astype(np.int64), int(times[j])) for j in range(k) if times[j]]
    rest = np.maximum(np.array(demand) - made, 0)
    while rest.any():
        left, pattern = capacity, np.zeros(k, dtype=np.int64)
        for j in range(k - 1, -1, -1):
            pattern[j] = min(rest[j], left // sizes[j])
            left -= pattern[j] * sizes[j]
        use = int(min(rest[j] // pattern[j] for j in range(k) if pattern[j]))
        plan.append((pattern, use))
        rest -= use * pattern
    return plan


def _knapsack(sizes: list[int], price: np.ndarray, capacity: int) -> np.ndarray:
    """The dearest multiset of sizes that fits: by how many are taken, all rooms at once."""
    best, chosen = [np.zeros(capacity + 1)], []
    for _ in range(capacity // min(sizes)):
        now, take = best[-1].copy(), np.full(capacity + 1, -1)
        for j, (size, worth) in enumerate(zip(sizes, price)):
            value = best[-1][: capacity + 1 - size] + worth
            better = value > now[size:]
            now[size:][better] = value[better]
            take[size:][better] = j
        best.append(now)
        chosen.append(take)
    pattern, room = np.zeros(len(sizes)), capacity
    for take in reversed(chosen):
        j = take[room]
        if j >= 0:
            pattern[j] += 1
            room -= sizes[j]
    return pattern


def linear_grouping(histogram: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) runs, ascending, cut into groups of about equal cardinality; a length may fall in two groups."""
    total = sum(histogram.values())
    share = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = [[]]
    room = share
    for length in sorted(histogram):
        n = histogram[length]
        while n:
            use = min(n, room)
            out[-1].append((length, use))
            n, room = n - use, room - use
            if not room:
                out.append([])
                room = share
    return [g for g in out if g]


Bundles = dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]]


def plan_runs(histogram: dict[int, int], capacity: int, small: int = SMALL, groups: int = GROUPS) -> list[tuple[int, ...]]:
    """Runs (length, first rank, pieces a sequence, sequences, first sequence, offset)."""
    bundles: Bundles = {}  # by free room: how many sequences hold which (length, times)
    if histogram.get(capacity):
        _add(bundles, 0, histogram[capacity], ((capacity, 1),))
    large = {s: n for s, n in histogram.items() if capacity // small < s < capacity}
    if large:
        rounded: dict[int, list[tuple[int, int]]] = {}
        for g in linear_grouping(large, groups):
            rounded.setdefault(g[-1][0], []).extend(g)
        sizes = sorted(rounded)
        supply = [list(rounded[s]) for s in sizes]
        plan = configurations(sizes, [sum(n for _, n in rounded[s]) for s in sizes], capacity)
        for pattern, times in plan:
            slots = [_draw(supply[j], times) for j in range(len(sizes)) for _ in range(int(pattern[j]))]
            for count, lengths in _align(slots, times):
                items = tuple((s, 1) for s in lengths if s)
                if items:
                    _add(bundles, capacity - sum(s for s, _ in items), count, items)
    short = {s: n for s, n in histogram.items() if s <= capacity // small and s < capacity}
    bundles = _refit(bundles, short, capacity)
    runs, used, sequence = [], dict.fromkeys(histogram, 0), 0
    for room in sorted(bundles):
        for count, items in bundles[room]:
            offset = 0
            for size, each in items:
                runs.append((size, used[size], each, count, sequence, offset))
                used[size] += each * count
                offset += size * each
            sequence += count
    return runs


def _add(bundles: Bundles, room: int, count: int, items: tuple[tuple[int, int], ...]) -> None:
    if count:
        bundles.setdefault(room, []).append((count, items))


def _best_fit(bundles: Bundles, histogram: dict[int, int], capacity: int) -> None:
    """Longest first, each to the sequence with the least room that takes it; equal pieces and sequences at once."""
    for size in sorted(histogram, reverse=True):
        n = histogram[size]
        rooms = sorted(r for r in bundles if r >= size)
        while n:
            while rooms and not bundles.get(rooms[0]):
                rooms.pop(0)
            room = rooms[0] if rooms else capacity
            each = room // size
            count, items = bundles[room].pop() if rooms else (-(-n // each), ())
            full = min(count, n // each)
            lower = room - each * size
            _add(bundles, lower, full, (*items, (size, each)))
            n -= full * each
            if full < count:
                rest = count - full
                if n and n < each:
                    _add(bundles, room - n * size, 1, (*items, (size, n)))
                    rest, n = rest - 1, 0
                if items:
                    _add(bundles, room, rest, items)


def _refit(bundles: Bundles, short: dict[int, int], capacity: int, free: int = FREE) -> Bundles:
    """Adds the short pieces: sequences with at most ``free`` tokens left stay, the others' pieces are fitted with them."""
    kept: Bundles = {r: list(b) for r, b in bundles.items() if r <= free}
    again = dict(short)
    for room, some in bundles.items():
        for count, items in some if room > free else ():
            for size, each in items:
                again[size] = again.get(size, 0) + each * count
    _best_fit(kept, again, capacity)
    return kept


def _draw(supply: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The next ``n`` lengths of a group, longest first, as runs; 0 where none is left."""
    out = []
    while n and supply:
        size, have = supply.pop()
        use = min(n, have)
        out.append((size, use))
        n -= use
        if have > use:
            supply.append((size, have - use))
    if n:
        out.append((0, n))
    return out


def _align(slots: list[list[tuple[int, int]]], times: int) -> Iterator[tuple[int, list[int]]]:
    """Cuts the slots of a configuration where any of their lengths changes."""
    ends = [np.cumsum([n for _, n in s]) for s in slots]
    cuts = np.unique(np.concatenate([*ends, [times]]))
    for a, b in zip(np.concatenate([[0], cuts[:-1]]), cuts):
        yield int(b - a), [s[int(np.searchsorted(e, a, "right"))][0] for s, e in zip(slots, ends)]


def assign(ranked: DataFrame, runs: list[tuple[int, ...]]) -> DataFrame:
    """Looks up each piece's sequence and offset by its length and rank; ``runs`` depends on the capacity alone."""
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)
    keys = table[:, 0] << 44 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = table[np.searchsorted(keys, length << 44 | rank, "right") - 1] if len(table) else np.zeros((0, 6), dtype=np.int64)
            within = rank - at[:, 1]
            sequence, offset = at[:, 4] + within // at[:, 2], at[:, 5] + within % at[:, 2] * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, PACKED)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the sequence and offset of each."""
    table = materialize(pieces(docs, tokenizer, capacity, end_id), "pieces")
    counts = materialize(table.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = table.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    return assign(ranked, plan_runs(histogram, capacity))
