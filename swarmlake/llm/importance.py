"""Importance resampling of documents towards a target (operator 7).

Two generative models of hashed words, runs of signs, and pairs of neighbours: the
target's, counted in labelled texts (quality 1, not toxic), and the raw one, counted
in all documents. A text counts once in each of its buckets, and copies of a text
once in all. Counts are brought to one scale, on which a bucket of the bulk (the
median) has the same count in both, and smoothed by ``PRIOR``; a bucket's weight is
the log ratio of the models, shrunk by how far it stands out from chance:
z^2 / (z^2 + SURE^2) for z standard errors. A document's log weight is the sum over
its buckets. Gumbel noise drawn from the doc_id is added, and the k largest sums are
kept: a sample without replacement by the weights.

Unless it is given, k is the number of documents above the log weight that best
tells target from other labelled texts, a lost target text costing ``COST`` times a
kept other one; to choose it, half of them are kept out of the models. The models see at most ``LABELLED`` labelled rows, those of the smallest
hashed doc_ids; the raw one, and the weights, all documents.

Null and empty texts weigh zero. Repeated doc_ids get the same noise and are judged
one by one; equal sums at the cut are kept together. Labels that are null or
contradict each other do not count; without labels of both sides nothing is
rejected. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import distinct, mixed, numbered, renamed, slices, word_hash
from .quality_rules import split_words
from .scratch import drop, materialize

BUCKETS = 1 << 20
LABELLED = 20_000
SEED = 2011
PRIOR = 2.0  # added to each count
SURE = 5.0  # standard errors at which half of a log ratio counts
COST = 4.0  # of a share of the target lost, against the same share of other texts kept
GRAIN = 1 << 20  # steps to one unit of a noisy weight, for the cut
RANGES = 64  # of buckets, that are summed apart

_SIGNS = r"([^\pL\pN\s]+)"


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every word, run of signs and pair of neighbours, each once a text, in this order."""
    spaced = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), _SIGNS, r" \1 ")
    words, n_words = split_words(spaced)
    coded = words.dictionary_encode()
    known = np.fromiter((word_hash(w, SEED) for w in coded.dictionary.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    word = known[coded.indices.to_numpy()] if len(words) else known
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    pair = np.flatnonzero(text_of[1:] == text_of[:-1]) + 1
    hashed = np.concatenate([word, mixed(word[pair - 1], word[pair])])
    once = distinct(np.concatenate([text_of, text_of[pair]]) * buckets + ((hashed >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64))
    return once // buckets, once % buckets


def counted(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many texts of the column ``text`` each bucket has; as many numbers as buckets reach the driver."""
    width = -(-buckets // RANGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * RANGES, dtype=np.int64)
        for batch in slices(batches, "text", 4 << 20):
            total += np.bincount(features(batch.column("text"), buckets)[1], minlength=len(total))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(RANGES), pa.int32()), pa.array([x.tobytes() for x in total.reshape(RANGES, width)], pa.binary())], ["range", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for r, n in zip(batch.column("range").to_pylist(), batch.column("n")):
                total[r] = total.get(r, 0) + np.frombuffer(n.as_buffer(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["range", "n"])

    schema = "range int, n binary"
    sums = texts.select("text").mapInArrow(run, schema).repartitionById(RANGES, F.col("range")).mapInArrow(add, schema)
    found = np.zeros((RANGES, width), dtype=np.int64)
    for r in sums.collect():
        found[r["range"]] = np.frombuffer(r["n"], dtype=np.int64)
    return found.ravel()[:buckets]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) but for copies, of which those of the smallest doc_id stay."""
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    copied = hashed.groupBy("hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # written, so that its size decides whether the join moves the texts
    copied = materialize(copied.select("hash", "first"), "copied-texts")
    return hashed.join(copied, "hash", "left").filter("first is null or doc_id = first").select("text")


def labelled(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """text, target and fitted (else kept out of the models) of at most ``limit`` labelled documents."""
    one = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id")
    spread = one.agg(*[f(c).alias(f"{n}_{c}") for c in ("quality", "toxic") for n, f in (("low", F.min), ("high", F.max))])
    clear = spread.filter("low_quality = high_quality and low_toxic = high_toxic")
    target = (F.col("low_toxic") == 0) & (F.col("low_quality") != 0)
    some = clear.select("doc_id", target.alias("target"), (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("fitted")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "target", "fitted")


def log_ratios(target: np.ndarray, raw: np.ndarray, prior: float = PRIOR, sure: float = SURE) -> np.ndarray:
    """The weight of each bucket from its counts of texts in the target and in all."""
    both = target[raw > 0] / raw[raw > 0]
    weight = raw[raw > 0].astype(float)
    if not len(both) or not target.any():
        return np.zeros(len(raw))
    order = np.argsort(both)
    bulk = both[order][np.searchsorted(np.cumsum(weight[order]), weight.sum() / 2)]
    expected = raw * (bulk or target.sum() / raw.sum())
    z2 = (target - expected) ** 2 / (expected + 1)
    return np.log((target + prior) / (expected + prior)) * z2 / (z2 + sure**2)


def fit(docs: DataFrame, sample: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Weights by bucket from all ``docs`` and the fitted half of the labelled ``sample``."""
    target = counted(sample.filter("target and fitted"), buckets)
    if not target.any():
        return np.zeros(buckets)
    return log_ratios(target, counted(distinct_texts(docs), buckets))


def weighed(docs: DataFrame, weights: np.ndarray, columns: list[str], doc_id: str | None = "doc_id", text: str = "text") -> DataFrame:
    """``columns`` of ``docs``, its log weight, and the weight with Gumbel noise in steps of 1 / GRAIN."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("")) if doc_id else F.lit("")
    u = (F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    carried = docs.select(*columns, *([] if text in columns else [text]), (-F.log(-F.log(u))).alias("__gumbel"))  # a text travels once
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema if f.name in columns), "log_weight double, noisy long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in slices(batches, text, 4 << 20):
            row, bucket = features(batch.column(text), len(weights))
            weight = np.bincount(row, weights=weights[bucket], minlength=batch.num_rows).astype(float)  # a sum over nothing is a whole number
            noisy = np.floor((weight + batch.column("__gumbel").to_numpy(zero_copy_only=False)) * GRAIN).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(weight), pa.array(noisy)], [*columns, "log_weight", "noisy"])

    return carried.mapInArrow(run, schema)


def threshold(sample: DataFrame, weights: np.ndarray) -> float | None:
    """The log weight that best tells labelled targets from others among those kept out of the models."""
    rows = weighed(sample.filter("not fitted"), weights, ["target"], None).select("target", "log_weight").toPandas()  # at most LABELLED
    target = rows["target"].to_numpy(dtype=bool)
    if target.all() or not target.any():
        return None
    order = np.argsort(rows["log_weight"].to_numpy(), kind="stable")
    value, own = rows["log_weight"].to_numpy()[order], target[order]
    # below each value: the share of others that goes, less the share of targets that goes with it at its cost
    gain = np.concatenate([[0], np.cumsum(~own) / (~own).sum() - COST * np.cumsum(own) / own.sum()])
    first = np.concatenate([[True], np.diff(value) > 0])
    at = int(np.argmax(np.where(first, gain[:-1], -1)))
    return float(value[at]) if gain[at] > 0 else None


def kth_largest(table: DataFrame, column: str, k: int, fan: int = 4096) -> int | None:
    """The k-th largest of a long column; each pass brings at most ``fan`` counts to the driver."""
    ends = table.agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count(column).alias("n")).first()
    if k < 1 or k > ends["n"]:
        return None
    low, high = ends["low"], ends["high"]
    while low < high:
        step = -(-(high - low + 1) // fan)
        inside = table.filter(F.col(column).between(low, high))
        counts = inside.groupBy(F.expr(f"({column} - ({low}L)) div {step}L").alias("bin")).count().collect()
        for bin_, n in sorted(((r["bin"], r["count"]) for r in counts), reverse=True):
            if k <= n:
                low, high = low + bin_ * step, min(high, low + (bin_ + 1) * step - 1)
                break
            k -= n
    return low


def cut(docs: DataFrame, labels: DataFrame, k: int | None = None) -> tuple[DataFrame, np.ndarray, int | None]:
    """Weights of all documents, those of the buckets, and the smallest noisy weight that is kept (none: all are)."""
    sample = materialize(labelled(docs, labels), "labelled")
    weights = fit(docs, sample)
    least = threshold(sample, weights)
    table = materialize(weighed(docs, weights, ["doc_id"]), "weights")
    drop(sample)
    if k is None and least is None:
        return table, weights, None
    k = table.filter(F.col("log_weight") >= least).count() if k is None else min(k, table.count())
    return table, weights, kth_largest(table, "noisy", k)


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, noisy_weight and kept of every document."""
    table, _, least = cut(docs, labels, k)
    kept = F.col("noisy") >= least if least is not None else F.lit(True)
    return table.select("doc_id", "log_weight", (F.col("noisy") / GRAIN).alias("noisy_weight"), kept.alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The kept rows of ``docs``, with their columns as they are."""
    table, weights, least = cut(docs, labels, k)
    drop(table)
    if least is None:
        return docs
    plain, names = numbered(docs)
    of = lambda c: names[docs.columns.index(c)]
    return renamed(weighed(plain, weights, names, of("doc_id"), of("text")).filter(F.col("noisy") >= least), names, docs.columns)
