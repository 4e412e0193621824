"""WARC archives, read back by boundary-chain verification (operator 1).

Writing: one record per page, as text files whose line separator is the end of
a WARC record. A block is an HTTP response; a revisit keeps its headers only.

Reading: the text source cuts the archives at the magic line, in parallel and
within large files. Every piece is a candidate record; its headers give the
offset where its successor must start. Magic inside a payload gives false
candidates. Per archive, pointer jumping from the file's start marks the
candidates that the chain reaches, and only those are records.

Null html is empty; null urls have no target line; null page_ids stay null.
Rows with the smallest page_id of a payload are all responses, so repeated rows
stay what the first is. A group of null ids alone is all responses. Other
columns are ignored; an empty table gives empty archives and an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import slices
from .scratch import drop, materialize

MAGIC = b"WARC/1.0\r\n"
END = b"\r\n\r\n"
#: Payloads of fewer bytes are never deduplicated.
LEAST = 100

CANDIDATES = (
    "archive string, block long, place long, size long, span long, page_id long, record_type string, "
    "refers_to long, declared string, payload_bytes long, payload_digest string"
)
CHAINED = CANDIDATES + ", offset long, part_of long"


def write(pages: DataFrame, path: str, least: int = LEAST) -> None:
    """Writes ``pages`` (page_id, url, html) as archives under ``path``."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2("html", 256)).withColumn("n", F.octet_length("html"))
    repeated = pages.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    # written, so that its size decides whether the join moves the pages
    repeated = materialize(repeated.filter("copies > 1").drop("copies"), "repeated-payloads")
    first = F.when(F.col("n") >= least, F.col("first"))
    revisit = first.isNotNull() & ~F.coalesce(F.col("page_id") == first, F.lit(False))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    record_id = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    head = F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit("2000-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]+", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Refers-To", F.when(revisit, record_id(first))),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))),
        F.lit("\r\n"),
    )
    pages.join(repeated, "digest", "left").select(F.concat(head, block).alias("value")).write.option("lineSep", END.decode()).text(path)
    drop(repeated)


def _headers(data: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """Header lines and where the block starts; nothing if these are no headers with a length."""
    end = data.find(END)
    if end < 0:
        return None
    lines = (x.partition(b":") for x in data[:end].split(b"\r\n"))
    found = {name.strip().lower(): value.strip() for name, _, value in lines}
    return (found, end + len(END)) if found.get(b"content-length", b"").isdigit() else None


def _page(value: bytes | None) -> int | None:
    found = (value or b"").removeprefix(b"<urn:x-page:").removesuffix(b">")
    return int(found) if found.lstrip(b"-").isdigit() else None


class _Open:
    """A candidate whose payload goes on behind magic inside it."""

    def __init__(self, row: dict, left: int, digest):
        self.row, self.left, self.digest = row, left, digest

    def feed(self, data: bytes) -> None:
        self.digest.update(data[: self.left])
        self.left = max(0, self.left - len(data))


def _candidate(archive: str, block: int, place: int, data: bytes) -> tuple[dict, int, object]:
    row = {"archive": archive, "block": block, "place": place, "size": len(data), "span": None, "page_id": None, "record_type": None, "refers_to": None, "declared": None, "payload_bytes": None, "payload_digest": None}
    parsed = _headers(data)
    if not parsed:
        return row, 0, None
    head, start = parsed
    length = int(head[b"content-length"])
    row |= {
        "span": start + length + len(END),
        "page_id": _page(head.get(b"warc-record-id")),
        "record_type": head.get(b"warc-type", b"").decode("utf-8", "replace"),
        "refers_to": _page(head.get(b"warc-refers-to")),
        "declared": head.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha256:"),
    }
    body = data[start : start + length]
    http = body.find(END)
    if http < 0:
        return row, 0, None
    inner = _headers(body[: http + len(END)])
    row["payload_bytes"] = int(inner[0][b"content-length"]) if inner else length - http - len(END)
    digest = hashlib.sha256(body[http + len(END) :])
    return row, length - len(body), digest


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """archive, block (the split's start) and data of what lies between magic lines, in order within a split."""
    found = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return found.select(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("data"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every piece between magic lines, with the span that its headers claim and the digest of its payload.

    The digest is null where the payload goes on in another split of the file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place, waiting, rows = None, 0, [], []
        types = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in CANDIDATES.split(", "))])
        for batch in slices(batches, "data"):
            for archive, block, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if split != (archive, block):
                    split, place, waiting = (archive, block), 0, []
                for w in waiting:
                    w.feed(MAGIC)
                    w.feed(data)
                    if not w.left:
                        w.row["payload_digest"] = w.digest.hexdigest()
                waiting = [w for w in waiting if w.left]
                row, left, digest = _candidate(archive, block, place, data)
                if digest is not None and left:
                    waiting.append(_Open(row, left, digest))
                elif digest is not None:
                    row["payload_digest"] = digest.hexdigest()
                rows.append(row)
                place += 1
            done, rows = rows, [w.row for w in waiting]
            held = {id(r) for r in rows}
            yield pa.RecordBatch.from_pylist([r for r in done if id(r) not in held], schema=types)
        yield pa.RecordBatch.from_pylist(rows, schema=types)

    return pieces(spark, path).mapInArrow(run, CANDIDATES)


def reachable(start: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which of the ascending offsets the chain from offset 0 reaches, where ``after[i]`` follows ``start[i]``."""
    n = len(start)
    at = np.searchsorted(start, after)
    found = np.minimum(at, max(n - 1, 0))
    jump = np.append(np.where((at < n) & (start[found] == after) & (after > start), found, n), n)  # n: the chain ends
    mark = np.zeros(n + 1, dtype=bool)
    mark[0] = n > 0 and start[0] == 0
    # doubling: after k rounds the marks cover 2**k steps and each jump spans as many
    while not (jump == n).all():
        mark[jump[mark]] = True
        jump = jump[jump]
    return mark[:n]


def chained(found: DataFrame) -> DataFrame:
    """The candidates that their archive's chain reaches, with their offsets; an archive is as large as its writer let it grow.

    Of a record whose payload goes on in another split, the pieces follow as rows of their own, with the record's offset as ``part_of``.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "place"], kind="stable")
        # the first piece stands before the first magic; every other one starts with it
        offset = (group["size"] + len(MAGIC)).cumsum().to_numpy() - group["size"].to_numpy() - 2 * len(MAGIC)
        group = group.assign(offset=offset, part_of=pd.array([None] * len(group), dtype="Int64"))[offset >= 0]
        real = group[group["span"].notna()]
        after = real["offset"].to_numpy() + len(MAGIC) + real["span"].to_numpy(dtype="int64")
        here = reachable(real["offset"].to_numpy(), after)
        records, ends = real[here], after[here]
        cut = ((records["record_type"] == "response") & records["payload_digest"].isna()).to_numpy()
        at = group["offset"].to_numpy()
        parts = [group.iloc[np.searchsorted(at, o) : np.searchsorted(at, e)].assign(part_of=o) for o, e in zip(records["offset"][cut], ends[cut])]
        return pd.concat([records, *parts])

    return found.groupBy("archive").applyInPandas(run, CHAINED)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Verified records: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    found = materialize(chained(candidates(spark, path)), "warc-records")
    records = found.filter("part_of is null")
    digest = F.when(F.col("record_type") == "revisit", F.col("declared")).otherwise(F.col("payload_digest"))
    if found.filter("part_of is not null").limit(1).count():
        records = records.join(_stitched(spark, path, found.filter("part_of is not null")), ["archive", "offset"], "left")
        digest = F.coalesce(digest, F.col("stitched"))
    return records.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def _stitched(spark: SparkSession, path: str, parts: DataFrame) -> DataFrame:
    """archive, offset and digest of records whose payload, with magic inside, crosses a split: their pieces are read again."""
    parts = parts.select("archive", "block", "place", F.col("offset").alias("piece"), F.col("part_of").alias("offset"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place = None, 0
        for batch in slices(batches, "data"):
            places = []
            for key in zip(batch.column("archive").to_pylist(), batch.column("block").to_pylist()):
                place = place + 1 if key == split else 0
                split = key
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["archive", "block", "data", "place"])

    def digest(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("piece", kind="stable")
        record = _candidate("", 0, 0, MAGIC.join(group["data"]))
        return pd.DataFrame({"archive": group["archive"].iloc[:1], "offset": group["offset"].iloc[:1], "stitched": [record[2].hexdigest()]})

    numbered = pieces(spark, path).mapInArrow(number, "archive string, block long, data binary, place long")
    return numbered.join(parts, ["archive", "block", "place"]).groupBy("archive", "offset").applyInPandas(digest, "archive string, offset long, stitched string")
