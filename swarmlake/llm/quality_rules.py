"""Quality rules as a short-circuit cascade (operator 3).

Rules reject a text on their own. A sample estimates what each costs and how
much it rejects; they then run in the order of rejection per cost, each on the
texts that all earlier ones passed. The order changes the cost, never the
verdict. Measures that the result reports are computed for every text.

Null and empty texts have no words and fail the base rule. Repeated rows and
doc_ids are judged one by one. Other columns are ignored, an empty table gives
an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import byte_values, numbered, renamed, slices

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes(range(ord("a"), ord("z") + 1))
#: Rows, about, on which cost and rejection of the rules are estimated.
SAMPLE_ROWS = 2000

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Text:
    data: bytes
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int


def _count(data: bytes, some: bytes) -> int:
    return len(data) - len(data.translate(None, some))


def many_symbols(t: Text) -> bool:
    """Over one sign of markup or accounting to four words."""
    return 4 * t.n_symbols > t.n_words


def many_repeated_lines(t: Text) -> bool:
    """Over half of the lines with a word equal to earlier ones."""
    lines = sum(1 for line in t.data.split(b"\n") if line.strip(SPACE))
    return 2 * t.n_dup_lines > lines


def shouting(t: Text) -> bool:
    """More capital than small ASCII letters."""
    return _count(t.data, UPPER) > _count(t.data, LOWER)


def exclaiming(t: Text) -> bool:
    """Over one run of two exclamation marks to four words."""
    return 4 * t.data.count(b"!!") > t.n_words


def odd_word_length(t: Text) -> bool:
    """Words of under two or over twenty characters on average."""
    return not 2 * t.n_words <= t.word_chars <= 20 * t.n_words


def stuttering(t: Text) -> bool:
    """Over three of ten words equal to the one before."""
    words = t.data.split()
    return 10 * sum(map(eq, words, words[1:])) > 3 * len(words)


RULES: list[Callable[[Text], bool]] = [many_symbols, many_repeated_lines, shouting, exclaiming, odd_word_length, stuttering]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each has."""
    lists = pc.ascii_split_whitespace(texts)
    flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at the ends gives empty words
    before = np.concatenate([[0], np.cumsum(full)])
    return flat if full.all() else flat.filter(pa.array(full)), np.diff(before[at - at[0]])


def measure(texts: pa.Array, data: list[bytes]) -> dict[str, np.ndarray]:
    """Words, characters in words, symbols, repeated lines and words in repeated windows of five, for each text."""
    texts = pc.fill_null(texts, "")
    words, n_words = split_words(texts)
    dup = []
    for d in data:
        lines = [line for line in d.split(b"\n") if line and not line.isspace()]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": n_words,
        "word_chars": pc.utf8_length(texts).to_numpy().astype(np.int64) - np.array([_count(d, SPACE) for d in data], dtype=np.int64),
        "n_symbols": np.array([_count(d, SYMBOLS) for d in data], dtype=np.int64),
        "n_dup_lines": np.array(dup, dtype=np.int64),
        "n_repeat_words": repeated_words(words, n_words),
    }


def _codes(values) -> tuple[np.ndarray, int]:
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)


def repeated_words(words: pa.Array, n_words: np.ndarray, width: int = 5) -> np.ndarray:
    """Words of each text within windows that stand twice or more in it; windows are told apart exactly."""
    out = np.zeros(len(n_words), dtype=np.int64)
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    starts = np.flatnonzero(text_of[: -width + 1] == text_of[width - 1 :])
    if not len(starts):
        return out
    word, n = _codes(words)
    window, size = word[starts], n
    for k in range(1, width):
        window, size = _codes(window * n + word[starts + k])
    window, size = _codes(text_of[starts] * size + window)
    again = starts[np.bincount(window, minlength=size)[window] > 1]
    edge = np.bincount(again, minlength=len(word) + 1) - np.bincount(again + width, minlength=len(word) + 1)
    inside = np.cumsum(edge[: len(word)]) > 0
    return np.bincount(text_of[inside], minlength=len(out)).astype(np.int64)


def _texts(data: list[bytes], m: dict[str, np.ndarray]) -> list[Text]:
    return [Text(d, *(int(x) for x in row)) for d, *row in zip(data, m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"])]


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def estimate(docs: DataFrame, rules=None, rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) on a sample of about ``rows`` rows of ``text``."""
    rules = RULES if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data = byte_values(batch.column("text"))
            texts = _texts(data, measure(batch.column("text"), data))
            for i, rule in enumerate(rules):
                began = time.perf_counter()
                n = sum(map(rule, texts))
                took = time.perf_counter() - began
                yield pa.RecordBatch.from_pydict({"rule": [i], "seconds": [took], "rejected": [n], "rows": [len(texts)]})

    share = min(1.0, rows / max(1, docs.count()))
    sample = docs.select("text").sample(share, seed=7) if share < 1 else docs.select("text")
    found = sample.mapInArrow(run, "rule long, seconds double, rejected long, rows long").groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("seconds", "rejected", "rows")])
    got = {r["rule"]: r for r in found.collect()}
    return [(rule.__name__, got[i]["seconds"] / got[i]["rows"], got[i]["rejected"] / got[i]["rows"]) if i in got else (rule.__name__, 1.0, 0.0) for i, rule in enumerate(rules)]


def ordered(docs: DataFrame, rules=None) -> list[Callable[[Text], bool]]:
    """The rules, most rejection per cost first."""
    rules = RULES if rules is None else rules
    worth = {name: rejected / max(seconds, 1e-9) for name, seconds, rejected in estimate(docs, rules)}
    return sorted(rules, key=lambda r: -worth[r.__name__])


def judge(docs: DataFrame, rules=None, columns: list[str] | None = None, text: str = "text") -> DataFrame:
    """``columns`` of ``docs`` (default doc_id) with the measures of ``text``, ``base_failed`` and ``kept``."""
    columns = columns or ["doc_id"]
    cascade = ordered(docs.select(F.col(text).alias("text")), rules)
    carried = docs.select(*columns, *([] if text in columns else [text]))  # a text travels once
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema if f.name in columns), *(f"{m} long" for m in MEASURES), "base_failed boolean, kept boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 4 << 20):
            data = byte_values(batch.column(text))
            m = measure(batch.column(text), data)
            failed = base_failed(m)
            kept = ~failed
            texts = _texts(data, m)
            for rule in cascade:
                for i in np.flatnonzero(kept):
                    kept[i] = not rule(texts[i])
            arrays = [*(batch.column(c) for c in columns), *(pa.array(m[c]) for c in MEASURES), pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(arrays, [*columns, *MEASURES, "base_failed", "kept"])

    return carried.mapInArrow(run, schema)


def keep(docs: DataFrame, rules=None) -> DataFrame:
    """The rows of ``docs`` whose texts pass, with their columns as they are."""
    plain, names = numbered(docs)
    return renamed(judge(plain, rules, names, names[docs.columns.index("text")]).filter("kept"), names, docs.columns)
