"""BAM files as a Spark data source: ``spark.read.format("bam").load(path)``.

Register it once with ``spark.dataSource.register(BamDataSource)``. A file is read
as a stream of compressed blocks, so memory does not grow with it, in splits of
``splitBytes`` compressed bytes, one task each. A split's first record is looked for:
its first block by headers that lead to each other, the record by fields that fit,
beginning some blocks before the split; the records from there must arrive at the
record that the split itself finds, else the file is read from its start to be sure.
With the options ``ref``, ``start`` and ``end`` (1-based, closed) and a ``.bai`` beside
the file, only the chunks that may hold such reads are read, one task a chunk; without
an index the whole file is. Reads that do not overlap are left out.

A file must end with an empty block, and each block's checksum must be right, so a file
that has been cut anywhere raises an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "qname string, flag int, ref_id int, ref_name string, pos int, mapq int, bin int, cigar string, next_ref_id int, next_ref_name string, "
    "next_pos int, tlen int, seq string, qual array<int>, tags map<string,string>, has_sa boolean"
)
# Fixed values of the format.
OPS = "MIDNSHP=X"
LETTERS = "=ACMGRSVTWYHKDBN"
SCALARS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
MAGIC = b"\x1f\x8b\x08\x04"
HEAD = 18  # bytes of a block's header up to its size
END = 28  # bytes of an empty block
LARGEST = 16 << 20
LARGEST_BLOCK = 1 << 16
CHAIN = 6  # blocks, or records, that must follow each other
BACK = 1 << 18  # compressed bytes before a split from which its first record is looked for
SPLIT = 32 << 20
BATCH = 5000


class Blocks:
    """Bytes of a BGZF file from a virtual offset on."""

    def __init__(self, handle, offset: int = 0):
        self.handle = handle
        handle.seek(offset >> 16)
        self.data, self.at, self.start, self.next = b"", 0, offset >> 16, offset >> 16
        if not self._block() and offset:
            raise ValueError("no BGZF block at the offset")
        self.at = offset & 0xFFFF
        if self.at > len(self.data):
            raise ValueError("offset beyond its BGZF block")

    def _block(self) -> bool:
        head = self.handle.read(HEAD)
        if not head:
            self.data, self.at, self.start = b"", 0, self.next
            return False
        size, before = block_size(head, self.handle)
        packed = self.handle.read(size - before)
        if len(packed) != size - before or len(packed) < 8:
            raise ValueError("BGZF block cut off")
        self.start, self.next = self.next, self.next + size
        self.data, self.at = zlib.decompress(packed[:-8], wbits=-15), 0
        if struct.unpack("<II", packed[-8:]) != (zlib.crc32(self.data), len(self.data)):
            raise ValueError("BGZF block with a wrong checksum")
        return True

    @property
    def position(self) -> int:
        return self.start << 16 | self.at if self.at < len(self.data) else self.next << 16

    def ready(self) -> bool:
        """Goes on to the next block that holds bytes, if this one has none left; False at the end."""
        while self.at == len(self.data):
            if not self._block():
                return False
        return True

    def read(self, n: int) -> bytes:
        parts = []
        while n and self.ready():
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def record(self) -> bytes:
        """The next record without its length."""
        head = self.read(4)
        size = struct.unpack("<i", head)[0] if len(head) == 4 else -1
        data = self.read(size) if 0 <= size <= LARGEST else b""
        if len(data) != size:
            raise ValueError("broken record")
        return data


def block_size(head: bytes, handle) -> tuple[int, int]:
    """Size of the block that begins with ``head``, and how much of it has been read then."""
    if len(head) < HEAD:
        raise ValueError("BGZF block cut off")
    if head[:4] != MAGIC:
        raise ValueError("no BGZF block")
    extra = struct.unpack_from("<H", head, 10)[0]
    fields, i = head[12:] + handle.read(max(extra - 6, 0)), 0
    while i + 4 <= min(extra, len(fields)):
        length = struct.unpack_from("<H", fields, i + 2)[0]
        if fields[i : i + 2] == b"BC" and length == 2 and i + 6 <= len(fields):
            return struct.unpack_from("<H", fields, i + 4)[0] + 1, 12 + max(extra, 6)
        i += 4 + length
    raise ValueError("no BGZF block")


def check_end(handle, size: int) -> None:
    """Raises unless the file ends with an empty block."""
    handle.seek(max(size - END, 0))
    tail = handle.read(END)
    if len(tail) < END or tail[:4] != MAGIC or tail[12:] != b"BC\2\0\x1b\0\3" + b"\0" * 9:
        raise ValueError("the file has no end block: it has been cut off")


def next_block(handle, at: int, size: int) -> int | None:
    """Offset of the first block from ``at`` on: its header leads to further ones, or to the end, and its bytes fit."""
    handle.seek(at)
    window = handle.read(LARGEST_BLOCK + HEAD)
    place = window.find(MAGIC)
    while place >= 0:
        start = at + place
        try:
            follow = start
            for _ in range(CHAIN):
                if follow == size:
                    break
                handle.seek(follow)
                follow += block_size(handle.read(HEAD), handle)[0]
            Blocks(handle, start << 16)
            return start
        except (ValueError, zlib.error):
            place = window.find(MAGIC, place + 1)
    return None


def plausible(data: bytes, refs: list[tuple[str, int]]) -> bool:
    """Whether the fields of a record (its first bytes, at least 36, with the length) fit each other."""
    size, ref, pos, bin_mq_nl, flag_nc, l_seq, next_ref, next_pos, _ = struct.unpack_from("<iiiIIiiii", data)
    l_name, ops = bin_mq_nl & 0xFF, flag_nc & 0xFFFF
    if not 32 < size <= LARGEST or l_seq < 0 or not l_name or 32 + l_name + 4 * ops + (l_seq + 1) // 2 + l_seq > size:
        return False
    for r, p in ((ref, pos), (next_ref, next_pos)):
        if not -1 <= r < len(refs) or p < -1 or (r >= 0 and p > refs[r][1]):
            return False
    name = data[36 : 36 + l_name]
    return len(name) < l_name or (name[-1] == 0 and all(32 < c < 127 for c in name[:-1]))


def find_record(handle, block: int, end: int, refs: list[tuple[str, int]]) -> int | None:
    """Virtual offset of the first place in the blocks from ``block`` and before ``end`` from which ``CHAIN`` records, or all to the end, fit."""
    blocks = Blocks(handle, block << 16)
    while blocks.ready() and blocks.start < end:
        start, own = blocks.start, blocks.data
        blocks.at = len(own)
        after = blocks.read(36 + 255)
        for at in range(len(own)):
            some = (own[at : at + 36 + 255] + after)[: 36 + 255]
            if len(some) >= 36 and plausible(some, refs) and _follows(Blocks(handle, start << 16 | at), refs):
                return start << 16 | at
        handle.seek(start)
        blocks = Blocks(handle, start << 16)
        blocks.at = len(own)
    return None


def _follows(blocks: Blocks, refs: list[tuple[str, int]]) -> bool:
    try:
        for _ in range(CHAIN):
            if not blocks.ready():
                return True
            data = blocks.record()
            if not plausible(struct.pack("<i", len(data)) + data[: 32 + 255], refs):
                return False
            decode_read(data, refs)
    except (ValueError, struct.error, IndexError, zlib.error):
        return False
    return True


def first_from(blocks: Blocks, block: int) -> tuple[int | None, int]:
    """Virtual offset of the first record that begins in ``block`` or later, and how many records before it were followed."""
    followed = 0
    while blocks.ready():
        if blocks.start >= block:
            return blocks.position, followed
        blocks.record()
        followed += 1
    return None, followed


def first_record(handle, begin: int, end: int, size: int, header: int, refs: list[tuple[str, int]], back: int = BACK) -> int | None:
    """Virtual offset of the first record that begins in a block at ``begin`` or later and before ``end``; ``header`` is that of the file's first."""
    if begin <= header >> 16:
        return header
    block = next_block(handle, begin, size)
    if block is None or block >= end:
        return None
    seen = find_record(handle, block, end, refs)
    while begin - back > header >> 16:
        earlier = next_block(handle, begin - back, size)
        known = find_record(handle, earlier, block, refs) if earlier is not None and earlier < block else None
        if known is not None:
            arrived, followed = first_from(Blocks(handle, known), block)
            inside = arrived if arrived is not None and arrived >> 16 < end else None
            if followed >= CHAIN:  # far enough to have left what only looks like a record
                if seen == inside:
                    return inside
                break
        back *= 4
    arrived, _ = first_from(Blocks(handle, header), block)
    return arrived if arrived is not None and arrived >> 16 < end else None


def read_header(blocks: Blocks) -> tuple[str, list[tuple[str, int]]]:
    if blocks.read(4) != b"BAM\1":
        raise ValueError("no BAM file")
    text = blocks.read(struct.unpack("<i", blocks.read(4))[0]).rstrip(b"\0").decode()
    refs = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0]).rstrip(b"\0").decode()
        refs.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return text, refs


def decode_tags(data: bytes) -> dict[str, str]:
    """Tags as SAM text: type and value, all whole numbers as ``i``."""
    tags, i = {}, 0
    while i < len(data):
        name, kind = data[i : i + 2].decode(), chr(data[i + 2])
        i += 3
        if kind in SCALARS:
            value = struct.unpack_from(SCALARS[kind], data, i)[0]
            i += struct.calcsize(SCALARS[kind])
            tags[name] = f"f:{value:g}" if kind == "f" else f"i:{value}"
        elif kind == "A":
            tags[name], i = f"A:{chr(data[i])}", i + 1
        elif kind in "ZH":
            end = data.index(b"\0", i)
            tags[name], i = f"{kind}:{data[i:end].decode()}", end + 1
        elif kind == "B":
            of, n = chr(data[i]), struct.unpack_from("<i", data, i + 1)[0]
            size = struct.calcsize(SCALARS[of])
            values = [struct.unpack_from(SCALARS[of], data, i + 5 + k * size)[0] for k in range(n)]
            tags[name], i = f"B:{of}," + ",".join(map(str, values)), i + 5 + n * size
        else:
            raise ValueError(f"tag {name} of unknown type {kind}")
    return tags


def decode_read(data: bytes, refs: list[tuple[str, int]]) -> tuple:
    ref, pos, bin_mq_nl, flag_nc, l_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiIIiiii", data)
    l_name, n_ops = bin_mq_nl & 0xFF, flag_nc & 0xFFFF
    at = 32 + l_name
    ops = struct.unpack_from(f"<{n_ops}I", data, at)
    at += 4 * n_ops
    packed = data[at : at + (l_seq + 1) // 2]
    at += len(packed)
    seq = "".join(LETTERS[b >> 4] + LETTERS[b & 15] for b in packed)[:l_seq]
    qual = list(data[at : at + l_seq])
    tags = decode_tags(data[at + l_seq :])
    name = lambda i: refs[i][0] if i >= 0 else "*"
    cigar = "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops)
    return (
        data[32 : 31 + l_name].decode(), flag_nc >> 16, ref, name(ref), pos + 1, bin_mq_nl >> 8 & 0xFF, bin_mq_nl >> 16, cigar, next_ref, name(next_ref),
        next_pos + 1, tlen, seq, qual, list(tags.items()), "SA" in tags,
    )


def reference_span(cigar: tuple[int, ...]) -> int:
    return sum(o >> 4 for o in cigar if OPS[o & 15] in "MDN=X")


def overlaps(data: bytes, region: tuple[int, int, int]) -> bool:
    """Whether a record overlaps (reference, start, end), 1-based and closed."""
    ref, pos, bin_mq_nl, flag_nc = struct.unpack_from("<iiII", data)
    if ref != region[0] or pos + 1 > region[2]:
        return False
    ops = struct.unpack_from(f"<{flag_nc & 0xFFFF}I", data, 32 + (bin_mq_nl & 0xFF))
    return pos + reference_span(ops) >= region[1]


def load_index(data: bytes) -> list[tuple[dict[int, list[tuple[int, int]]], list[int]]]:
    """Chunks by bin, and the linear index, of each reference of a ``.bai``."""
    if data[:4] != b"BAI\1":
        raise ValueError("no BAM index")
    at, out = 8, []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        bins: dict[int, list[tuple[int, int]]] = {}
        (n,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(n):
            name, chunks = struct.unpack_from("<Ii", data, at)
            bins[name] = [struct.unpack_from("<QQ", data, at + 8 + 16 * k) for k in range(chunks)]
            at += 8 + 16 * chunks
        (n,) = struct.unpack_from("<i", data, at)
        out.append((bins, list(struct.unpack_from(f"<{n}Q", data, at + 4))))
        at += 4 + 8 * n
    return out


def region_chunks(index, region: tuple[int, int, int]) -> list[tuple[int, int]]:
    """Merged virtual-offset ranges of the bins that may hold reads of a region."""
    bins, linear = index[region[0]]
    start, end = region[1] - 1, region[2] - 1
    wanted = {0, *(b for shift, offset in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)) for b in range((start >> shift) + offset, (end >> shift) + offset + 1))}
    least = linear[start >> 14] if start >> 14 < len(linear) else 0
    merged: list[tuple[int, int]] = []
    for a, b in sorted(c for name in wanted for c in bins.get(name, ()) if c[1] > least):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


@dataclass
class BamPartition(InputPartition):
    path: str
    begin: int
    end: int
    region: tuple[int, int, int] | None
    split: bool = False  # begin and end are places in the file, else virtual offsets


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path)
    return system, name


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def _files(self) -> list[str]:
        path = self.options["path"]
        system, name = _open(path)
        if system.get_file_info(name).type == fs.FileType.File:
            return [path]
        base = path.rstrip("/")
        return sorted(f"{base}/{f.base_name}" for f in system.get_file_info(fs.FileSelector(name)) if f.base_name.endswith(".bam"))

    def partitions(self) -> list[InputPartition]:
        out = []
        step = int(self.options.get("splitbytes", self.options.get("splitBytes", SPLIT)))
        for path in self._files():
            system, name = _open(path)
            size = system.get_file_info(name).size
            with system.open_input_file(name) as handle:
                check_end(handle, size)
                _, refs = read_header(Blocks(handle))
            region, ref = None, self.options.get("ref")
            if ref is not None:
                known = [n for n, _ in refs]
                if ref not in known:
                    continue
                region = (known.index(ref), int(self.options.get("start", 1)), int(self.options.get("end", 1 << 29)))
                beside = next((b for b in (name + ".bai", name.removesuffix(".bam") + ".bai") if system.get_file_info(b).type == fs.FileType.File), None)
                if beside is not None:
                    with system.open_input_stream(beside) as handle:
                        index = load_index(handle.read())
                    out += [BamPartition(path, a, b, region) for a, b in region_chunks(index, region)]
                    continue
            out += [BamPartition(path, a, min(a + step, size), region, True) for a in range(0, size, step)]
        return out or [BamPartition("", 0, 0, None)]

    def read(self, partition: BamPartition) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        types = pa.schema(
            [(n, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "map<string,string>": pa.map_(pa.string(), pa.string())}[t]) for n, t in (c.split(" ") for c in SCHEMA.split(", "))]
        )
        system, name = _open(partition.path)
        with system.open_input_file(name) as handle:
            blocks = Blocks(handle)
            _, refs = read_header(blocks)
            begin, end = partition.begin, partition.end
            if partition.split:
                blocks.ready()
                begin, end = first_record(handle, begin, end, system.get_file_info(name).size, blocks.position, refs), end << 16
                if begin is None:
                    return
            blocks = Blocks(handle, begin)
            rows = []
            while blocks.ready() and blocks.position < end:
                data = blocks.record()
                if partition.region is None or overlaps(data, partition.region):
                    rows.append(decode_read(data, refs))
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), types)], schema=types)


class BamDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(dict(self.options))
