"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts each batch so that ``column`` has about ``max_bytes`` in a slice; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        groups = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64)) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        del batch
        pa.default_memory_pool().release_unused()  # workers live on after a task


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns under numbered names, which clash with none."""
    names = [f"__{i}" for i in range(len(df.columns))]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)]), names


def renamed(df: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """The columns ``names`` under the names ``columns``."""
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, columns)])


def word_hash(word: bytes, seed: int = 42) -> int:
    return xxhash.xxh64_intdigest(word, seed)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair of hashes, by order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, ascending, by sorting."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), dtype=bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return ordered[new]
