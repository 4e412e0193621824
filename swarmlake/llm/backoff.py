"""Weighted backoff automaton for language-model scoring (operator 6).

States are histories of at most two words that training texts hold. An arc reads
a word: its weight is the smoothed log10 probability of the n-gram, its target the
longest known history that ends in the word. A state without an arc for a word
has a failure arc to the history without its first word; its weight is the mass
that smoothing leaves to shorter histories. The root reads every word. A text is
traversed once, from left to right: the traversal carries its state, follows
failure arcs one after the other, and adds the weights it meets.

Smoothing takes the shorter history as a Dirichlet prior of fixed mass, so the
probabilities after any history sum to one: (c(hv) + m p(v | h')) / (c(h) + m).
Every n-gram of every training text counts; nothing is pruned, whatever the size.

The automaton is never in one place. Texts are bundled; a bundle sends its distinct
n-grams, with their counts, to the parts of a hashed key range; a part sums the
counts of all bundles and answers each with the totals of its own n-grams, from
which the bundle's piece of the automaton is made. So n-grams travel once, hot
ones once a bundle, and no task holds more than a part or a bundle. A text longer
than a bundle is one of its own.

N-grams are told apart by 62-bit hashes. A text without a doc_id is held out. Null
and empty texts are their end token. Repeated rows count and are scored each.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mixed, slices, word_hash
from .quality_rules import split_words
from .scratch import materialize

ADD = 0.1
#: Prior mass of the shorter history after one word and after two.
MASS_1, MASS_2 = 200.0, 5.0
BUNDLE = 2 << 20  # bytes of text in a bundle, about
PART = 2 << 20  # n-grams that meet in a part, about
ROUNDS = 4  # in which parts are dealt one after another, so that less lies on disk at once
CHUNK = 1 << 16  # positions that a traversal unpacks at once


START, END = word_hash(b" start"), word_hash(b" end")  # no word has a blank


def _tagged(key: np.ndarray, order: int) -> np.ndarray:
    return key & ~np.uint64(3) | np.uint64(order)


def tokens(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Lower-cased (A-Z) words of all texts, coded, and how many each has."""
    words, counts = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    return words.dictionary_encode(), counts


def split(docs: DataFrame) -> DataFrame:
    """doc_id, text and held_out: the crc32 of the id as text is divisible by 10."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.crc32(key.cast("binary")) % 10 == 0).alias("held_out"))


BUNDLES = "bundle long, doc_ids array<long>, held array<boolean>, counts binary, codes binary, hashes binary, n_all long, n_train long, train_texts long"


def bundles(texts: DataFrame) -> DataFrame:
    """Texts as coded words, one row a bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BUNDLE):
            coded, counts = tokens(batch.column("text"))
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            hashes = np.fromiter(map(word_hash, coded.dictionary.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
            row = {
                "bundle": [number],
                "doc_ids": pa.array([batch.column("doc_id")], pa.list_(pa.int64())),
                "held": pa.array([batch.column("held_out")], pa.list_(pa.bool_())),
                "counts": [_planes(counts.astype(np.int32))],
                "codes": [_planes(coded.indices.to_numpy().astype(np.int32))],
                "hashes": [hashes.tobytes()],
                "n_all": [int((counts + 1).sum())],
                "n_train": [int((counts[~held] + 1).sum())],
                "train_texts": [int((~held).sum())],
            }
            yield pa.RecordBatch.from_pydict(row)
            number += 1

    return texts.mapInArrow(run, BUNDLES)


class Bundle:
    """N-grams at each position of a bundle's texts, ends included."""

    def __init__(self, row: dict):
        counts = _numbers(row["counts"], np.int32).astype(np.int64)
        codes = _numbers(row["codes"], np.int32).astype(np.int64)
        hashes = np.append(np.frombuffer(row["hashes"], dtype=np.uint64), np.array([END, START], dtype=np.uint64))
        end, start = len(hashes) - 2, len(hashes) - 1
        self.lengths = counts + 1
        self.ends = np.cumsum(self.lengths)
        token = np.insert(codes, np.cumsum(counts), end)
        before = np.concatenate([[start], token[:-1]])
        before[before == end] = start
        self.first = before == start  # of their texts
        word = hashes[token]
        pair = mixed(hashes[before], word)
        self.inner = np.flatnonzero(~self.first)  # positions that two words stand before, or a start and a word
        triple = mixed(pair[self.inner - 1], word[self.inner])
        self.every = np.concatenate([_tagged(word, 1), _tagged(pair, 2), _tagged(triple, 3)])
        self.held = np.array(row["held"], dtype=bool)

    def counts(self, low: int, high: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of the parts from ``low`` to ``high``, ascending, and how often the bundle's training texts hold each."""
        part = _part(self.every, parts)
        some = (part >= low) & (part < high)
        keys, at = np.unique(self.every[some], return_inverse=True)
        trained = np.repeat(~self.held, self.lengths)
        weights = np.concatenate([trained, trained, trained[self.inner]])[some]
        return keys, np.bincount(at, weights=weights, minlength=len(keys)).astype(np.uint32)

    def totals(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals of the word, the pair and the triple that end at each position, from those of the ascending keys."""
        n = len(self.first)
        each = found[np.unique(self.every, return_inverse=True)[1]].astype(np.int64)
        triple = np.zeros(n, dtype=np.int64)
        triple[self.inner] = each[2 * n :]
        return each[:n], each[n : 2 * n], triple


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key, ascending with the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane: the upper planes of small ones compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _numbers(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _squeezed(keys: np.ndarray) -> bytes:
    """Gaps of ascending keys."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unsqueezed(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data, np.uint64), dtype=np.uint64)


def asked(table: DataFrame, low: int, high: int, parts: int) -> DataFrame:
    """part, bundle, and the bundle's keys of this part with their counts, for the parts from ``low`` to ``high``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                keys, n = Bundle(row).counts(low, high, parts)
                cuts = np.searchsorted(_part(keys, parts), np.arange(low, high + 1))
                full = np.flatnonzero(np.diff(cuts))
                some = [slice(cuts[p], cuts[p + 1]) for p in full]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low + full, pa.int32()), pa.array([row["bundle"]] * len(full), pa.int64()), pa.array([_squeezed(keys[s]) for s in some], pa.binary()), pa.array([_planes(n[s]) for s in some], pa.binary())],
                    ["part", "bundle", "keys", "n"],
                )

    return table.mapInArrow(run, "part int, bundle long, keys binary, n binary")


def answered(questions: DataFrame, low: int, high: int) -> DataFrame:
    """For each bundle and part the totals of its keys; a row without a bundle holds how many words of the part are trained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]  # one part
        if not rows:
            return
        sizes = [len(r["n"]) // 4 for r in rows]
        keys, at = np.unique(np.concatenate([_unsqueezed(r["keys"]) for r in rows]), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate([_numbers(r["n"], np.uint32) for r in rows]), minlength=len(keys)).astype(np.uint32)
        words = int(((keys & np.uint64(3) == 1) & (total > 0)).sum())
        found, cuts = total[at], np.cumsum([0, *sizes])
        answers = [_planes(found[a:b]) for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *(r["bundle"] for r in rows)], pa.int64()), pa.array([rows[0]["part"]] * (len(rows) + 1), pa.int32()), pa.array([None, *answers], pa.binary()), pa.array([words] + [0] * len(rows), pa.int64())],
            ["bundle", "part", "total", "words"],
        )

    return questions.repartitionById(high - low, F.col("part") - low).mapInArrow(run, "bundle long, part int, total binary, words long")


@dataclass
class Facts:
    tokens: int  # N
    kinds: int  # V
    texts: int  # training texts

    @property
    def norm(self) -> float:
        return self.tokens + ADD * (self.kinds + 1)


@dataclass
class Automaton:
    """The arcs that the positions of a bundle can take, as log10 weights (NaN: no such arc), and where they lead."""

    root: np.ndarray  # from the root
    one: np.ndarray  # from the word before
    two: np.ndarray  # from the two words before
    fall_one: np.ndarray  # failure arc of the word before, to the root
    fall_two: np.ndarray  # failure arc of the two words before, to the word before
    target: np.ndarray  # words of the longest known history behind the position
    known: np.ndarray  # whether a training text has the word

    @classmethod
    def of(cls, bundle: Bundle, found: np.ndarray, facts: Facts, mass_1: float = MASS_1, mass_2: float = MASS_2) -> Automaton:
        c1, c2, c3 = bundle.totals(found)
        h1 = np.where(bundle.first, facts.texts, np.roll(c1, 1))  # how often the history of one word stands in training texts
        h2 = np.where(bundle.first, 0, np.roll(c2, 1))
        p1 = (c1 + ADD) / facts.norm
        p2 = (c2 + mass_1 * p1) / (h1 + mass_1)
        p3 = (c3 + mass_2 * p2) / (h2 + mass_2)
        arcs = lambda p, c: np.where(c > 0, np.log10(p), np.nan)
        return cls(np.log10(p1), arcs(p2, c2), arcs(p3, c3), np.log10(mass_1 / (h1 + mass_1)), np.log10(mass_2 / (h2 + mass_2)), np.where(c2 > 0, 2, np.where(c1 > 0, 1, 0)), c1 > 0)

    def traverse(self, lengths: np.ndarray) -> list[float]:
        """The score of each text, from the state of its start."""
        scores, left, n = [], 0, iter(lengths.tolist())
        for a in range(0, len(self.root), CHUNK):
            steps = (x[a : a + CHUNK].tolist() for x in (self.two, self.one, self.root, self.fall_two, self.fall_one, self.target))
            for two, one, root, fall_two, fall_one, target in zip(*steps):
                if not left:
                    left, state, total = next(n), 1, 0.0
                if state == 2:
                    if two == two:
                        weight = two
                    else:
                        total += fall_two
                        state = 1
                if state == 1:
                    if one == one:
                        weight = one
                    else:
                        total += fall_one
                        state = 0
                if state == 0:
                    weight = root
                total += weight
                state = target
                left -= 1
                if not left:
                    scores.append(total)
        return scores


def scored(table: DataFrame, answers: DataFrame, facts: Facts) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of the bundles' texts."""
    found = answers.filter("bundle is not null").groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("part", "total"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Bundle(row)
                automaton = Automaton.of(b, np.concatenate([_numbers(x["total"], np.uint32) for x in row["found"]]), facts)
                starts = b.ends - b.lengths
                known = np.add.reduceat(automaton.known.astype(np.int64), starts)
                columns = [
                    pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(b.lengths), pa.array(known),
                    pa.array(np.add.reduceat(automaton.root, starts)), pa.array(automaton.traverse(b.lengths)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    met = table.join(found, "bundle")
    return met.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    table = materialize(bundles(split(docs)), "bundles")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    seen = table.agg(zero("n_all"), zero("n_train"), zero("train_texts")).first()
    parts = max(1, -(-3 * seen["n_all"] // PART))  # three orders
    bounds = [parts * i // ROUNDS for i in range(ROUNDS + 1)]
    rounds = [(low, high) for low, high in zip(bounds, bounds[1:]) if high > low]
    answers = reduce(DataFrame.unionByName, [materialize(answered(asked(table, *some, parts), *some), "totals") for some in rounds])
    kinds = answers.agg(zero("words")).first()["words"]
    facts = Facts(seen["n_train"], kinds, seen["train_texts"])
    found = scored(table, answers, facts)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(facts.tokens).cast("long").alias("train_tokens"), "base_score", "score")
