"""Byte-level BPE encoding and decoding by monoid tree reduction (operator 8).

A text is halved until a half has at most ``leaf`` characters; leaves are
encoded by the ranks. Two neighbours are joined by encoding a window around
their border again: it starts and ends at places where a match of the split
pattern begins whatever stands around it (white space after other characters, a
change between letters, digits and signs), so the tokens outside the window are
final. A window without such a place grows until it has one or reaches the end
of the half. A split pattern that does not begin a match at all such places, in any
string of a few characters, is refused. Decoding concatenates bytes up the same tree.

Null and empty texts have no ids. Repeated rows stand for themselves; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices

LEAF = 512
WINDOW = 64
#: One or more characters of each kind that split patterns tell apart; a pattern is tried on all short strings of them.
KINDS = ["a", "é", "1", "!", "'", "s", " ", "\n", "\t"]

# The white space of every engine here is also \s of regex; the characters on which they differ start no place.
_PLACE = regex.compile(
    r"(?<=[^\s\x1c-\x1f])(?=[ \t\n\r])"
    r"|(?<=\p{L})(?=[^\s\x1c-\x1f\p{L}])"
    r"|(?<=\p{N})(?=[^\s\x1c-\x1f\p{N}])"
    r"|(?<=[^\s\x1c-\x1f\p{L}\p{N}'])(?=[\p{L}\p{N}])"
)


def check_places(pattern: str, longest: int = 4) -> None:
    """Raises where the pattern goes on over a place at which texts are cut."""
    split = regex.compile(pattern)
    for n in range(2, longest + 1):
        for some in product(KINDS, repeat=n):
            text = "".join(some)
            starts = {m.start() for m in split.finditer(text)}
            if any(m.start() not in starts for m in _PLACE.finditer(text)):
                raise ValueError(f"the split pattern begins no match where {text!r} is cut")


class TreeCodec:
    def __init__(self, path: str, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        check_places(pattern)
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token = {rank: token for token, rank in ranks.items()}
        self.size = np.zeros(max(self.token) + 1, dtype=np.int64)
        for rank, token in self.token.items():
            self.size[rank] = len(token)
        self.leaf, self.window = leaf, window

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf:
            return self.plain.encode_ordinary(text[a:b])
        m = (a + b) // 2
        return self._join(text, a, m, b, self._encode(text, a, m), self._encode(text, m, b))

    def _join(self, text: str, a: int, m: int, b: int, left: list[int], right: list[int]) -> list[int]:
        start, stop = self._place_before(text, a, m), self._place_after(text, m, b)
        keep, skip = len(left), 0
        out, inside = len(text[start:m].encode()), len(text[m:stop].encode())
        while out > 0:
            keep -= 1
            out -= self.size[left[keep]]
        while inside > 0:
            inside -= self.size[right[skip]]
            skip += 1
        return left[:keep] + self.plain.encode_ordinary(text[start:stop]) + right[skip:]

    def _place_before(self, text: str, a: int, m: int) -> int:
        width = self.window
        while m - width > a:
            # one character before the window may be looked at, none after the half
            found = [x.start() for x in _PLACE.finditer(text, m - width, m)]
            found = [p for p in found if m - width < p < m]
            if found:
                return found[-1]
            width *= 2
        found = [x.start() for x in _PLACE.finditer(text, a, m) if a < x.start() < m]
        return found[-1] if found else a

    def _place_after(self, text: str, m: int, b: int) -> int:
        width = self.window
        while True:
            end = min(b, m + width)
            # a place next to the border itself is no place of the right half
            found = next((x.start() for x in _PLACE.finditer(text, m, end) if m < x.start() < end), None)
            if found is not None:
                return found
            if end == b:
                return b
            width *= 2

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.token.__getitem__, ids))
        m = len(ids) // 2
        return self.decode(ids[:m]) + self.decode(ids[m:])


_CODECS: dict[tuple[str, str], TreeCodec] = {}


def codec(path: str, pattern: str) -> TreeCodec:
    """This worker's codec, made once."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = TreeCodec(path, pattern)
    return _CODECS[key]


def encode_texts(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Ids of each text as little-endian unsigned 32-bit integers, and digests of them and of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches, "text", 4 << 20):
            n, blobs, id_sha, text_sha = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = c.encode(text or "")
                blob = np.array(ids, dtype="<u4").tobytes()
                n.append(len(ids))
                blobs.append(blob if with_ids else None)
                id_sha.append(hashlib.sha256(blob).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(blobs, pa.binary()), pa.array(id_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Bytes of each row's ``ids``; null ids give empty bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in slices(batches, "ids", 4 << 20):
            data = [c.decode(np.frombuffer(x or b"", dtype="<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")
