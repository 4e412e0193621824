"""Spelling variants of the corpus's words by permuterm rotations (operator 11).

Words are the runs ``[A-Za-z\\u00C0-\\u00FF]+`` of all texts, A-Z lower-cased, with
the stated deletions, of at least ``LETTERS`` code points and ``TIMES`` occurrences.
Two are near if they differ by one inserted, deleted or replaced code point.

A word a c b, marked at its end, is turned to b $ a c for each of its places. What
stands before the last symbol names a prefix range: all words a ? b, and a b itself,
which is turned to b $ a in whole. Sorted by that prefix, a range lies together and
holds each letter of the alphabet once at most, 91 rows, so a scan gives every row
the number of its neighbours in the range and the best of them: no pairs are made.
A pair that differs by a letter within a run of equal letters lies in several ranges,
and counts in that of the run's first place only.

Words of over ``LONG`` code points name their ranges by hashes of a and of b, as their
rotations would grow with the square of their length.

Null and empty texts have no words; a null doc_id is written as nothing in the rule
of deletions; repeated rows count as often as they stand there. Ties go to the smaller
word by code points. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import byte_values, slices
from .scratch import drop, materialize

RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # of lower-cased UTF-8; U+00C0 to U+00FF are C3 80 to C3 BF
DROPPED = 97
LETTERS = 5
TIMES = 3
LONG = 64
HELD = 200_000  # counts that a task holds before it sends them on
PRIMES = ((1 << 61) - 1, (1 << 89) - 1)


def words_of(doc_id: int | None, text: bytes) -> Iterator[tuple[bytes, int]]:
    """The runs of a text after deletions, with their counts."""
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    for run, n in Counter(RUN.findall(text.lower())).items():
        h = zlib.crc32(run, start)
        if h % DROPPED == 0:
            letters = run.decode()
            at = h % len(letters)
            run = (letters[:at] + letters[at + 1 :]).encode()
        yield run, n


def counted(docs: DataFrame, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """word and n of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in slices(batches, "text", 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_values(batch.column("text"))):
                for word, n in words_of(doc_id, text):
                    held[word] += n
            if len(held) > HELD:
                yield sent()
        if held:
            yield sent()

    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return runs.filter(F.length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def rotations(words: DataFrame, long: int = LONG) -> DataFrame:
    """(prefix, last, n, word) of each word's rotations; ``last`` is null for those that are the prefix; ``word`` is set for long words."""
    word, size = F.col("word"), F.length("word")
    rest, head = (lambda i: F.substring(word, i + 1, size)), (lambda i: F.substring(word, F.lit(1), i))
    whole = F.transform(F.when(size < long, F.sequence(F.lit(0), size)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.concat(rest(i), F.lit("$"), head(i)).alias("prefix"), F.lit(None).cast("string").alias("last")))
    cut = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(F.concat(rest(i), F.lit("$"), head(i - 1)).alias("prefix"), F.substring(word, i, F.lit(1)).alias("last")))
    short = words.filter(size <= long).select("n", F.explode(F.concat(whole, cut)).alias("r"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for letters, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                ahead, behind = _hashes(letters), _hashes(letters[::-1])[::-1]
                name = lambda i, j: f"{i}:{ahead[i]}:{behind[j]}:{letters[i - 1] if i else '$'}"  # noqa: E731, B023
                prefix, last = [name(i, i) for i in range(len(letters) + 1)], [None] * (len(letters) + 1)
                if len(letters) > long:  # else among the short ones
                    prefix, last = prefix + [name(i, i + 1) for i in range(len(letters))], last + list(letters)
                for a in range(0, len(prefix), 10_000):
                    some = pa.array(prefix[a : a + 10_000])
                    yield pa.RecordBatch.from_arrays([some, pa.array(last[a : a + 10_000], pa.string()), pa.array([n] * len(some), pa.int64()), pa.array([letters] * len(some))], ["prefix", "last", "n", "word"])

    far = words.filter(size >= long).mapInArrow(hashed, "prefix string, last string, n long, word string")
    return short.select("r.prefix", "r.last", "n", F.lit(None).cast("string").alias("word")).unionByName(far)


def _hashes(letters: str) -> list[str]:
    """Hashes of all prefixes of a word."""
    out, h = ["0"], [0 for _ in PRIMES]
    for c in letters:
        h = [(x * 1_000_003 + ord(c) + 1) % p for x, p in zip(h, PRIMES)]
        out.append("-".join(f"{x:x}" for x in h))
    return out


def scanned(turned: DataFrame) -> DataFrame:
    """word, links and best (-n, word) of each row that has neighbours in its range."""
    before = F.substring_index("prefix", "$", 1)
    after = F.substring_index("prefix", "$", -1)
    word = F.coalesce("word", F.concat(after, F.coalesce("last", F.lit("")), before))
    # once for a letter within a run of equal ones; the name of a long word's range ends with the letter before
    first = F.col("last").isNotNull() & (F.substring("prefix", -1, 1) != F.col("last"))
    rows = turned.select("prefix", "last", word.alias("word"), "n", first.alias("first"))
    group = Window.partitionBy("prefix")
    ranked = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    best, second = F.nth_value(own, 1).over(ranked), F.nth_value(own, 2).over(ranked)
    seen = rows.select(
        "*", best.alias("best"), second.alias("second"), F.count("last").over(ranked).alias("cut"), F.count(F.when(F.col("last").isNull(), 1)).over(ranked).alias("whole"), F.count(F.when(F.col("first"), 1)).over(ranked).alias("firsts")
    ).filter(F.col("cut") + F.col("whole") > 1)
    links = F.when(F.col("last").isNull(), F.col("firsts")).otherwise(F.col("cut") - 1 + F.when(F.col("first"), F.col("whole")).otherwise(0))
    return seen.select("word", links.alias("links"), F.when(F.col("best.word") == F.col("word"), F.col("second")).otherwise(F.col("best")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and the last of its forms; a form has twice the occurrences, so few rounds of doubled steps end all chains."""
    steps = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = steps.select(F.col("word").alias("at"), F.col("root").alias("on"))
        after = materialize(steps.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "forms")
        drop(steps)
        steps = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return steps


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word."""
    words = materialize(counted(docs), "words")
    near = scanned(rotations(words)).groupBy(F.col("word").alias("of")).agg(F.sum("links").alias("n_near"), F.min("best").alias("best"))
    met = words.join(near, F.col("word") == F.col("of"), "left")
    more = -F.col("best.less") >= 2 * F.col("n")
    formed = met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(more, F.col("best.word")).alias("form"), F.when(more, -F.col("best.less")).alias("form_n"))
    formed = materialize(formed, "word-forms")
    drop(words)
    ends = roots(formed.filter("form is not null")).select(F.col("word").alias("of"), "root")
    return formed.join(ends, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
