import re
import zlib
from collections import Counter

import pytest

from swarmlake.llm import spelling

ALPHABET = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def brute_words(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near_words(w, known):
    changed = {w[:i] + w[i + 1 :] for i in range(len(w))}
    for c in ALPHABET:
        changed |= {w[:i] + c + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i:] for i in range(len(w) + 1)}
    return (changed & known.keys()) - {w}


def brute(rows):
    known = brute_words(rows)
    form, near = {}, {}
    for w, n in known.items():
        near[w] = near_words(w, known)
        best = min(near[w], key=lambda v: (-known[v], v), default=None)
        form[w] = best if best is not None and known[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), known.get(form[w])) for w, n in known.items()}


def found(df):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_against_brute_force(spark, docs, edge):
    some = ["house", "houses", "hause", "housse", "housee", "ouse", "àéîöü", "àéîöÿ", "aaaaa", "aaaaaa", "aaaaaaa", "baaaaa", "aabaa", "Houses", "houseses", "x÷y×z", "hoüse", "straße"]
    rows = [*edge] + [(100 + i, " ".join(w + ("!" if i % 2 else " 7") for k, w in enumerate(some) for _ in range(1 + (k * i) % 4))) for i in range(30)]
    assert found(spelling.variants(docs(rows))) == brute(rows)


def test_deletions_and_chains(spark, docs):
    rows = [(i, "wonderful wonderfull wonderfulll " * (i % 7) + "wonderful " * 40 + "wonderfull " * 9) for i in range(400)]
    got = found(spelling.variants(docs(rows)))
    assert got == brute(rows)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # a chain of forms


@pytest.mark.parametrize("long", [6, 64])
def test_long_words(spark, docs, long, monkeypatch):
    """Words at and over the bound meet those under it."""
    monkeypatch.setattr(spelling.rotations, "__defaults__", (long,))
    words = ["abcdef", "abcdefg", "abcdeg", "abbdefg", "bcdefg", "aabcdefg", "abcdefgg", "x" * 3000, "x" * 3001, "x" * 2999 + "y", "q" * 64, "q" * 65, "q" * 63 + "r"]
    rows = [(i, " ".join(words * (1 + i % 2))) for i in range(6)]
    assert found(spelling.variants(docs(rows))) == brute(rows)


def test_no_words(spark, docs):
    assert spelling.variants(docs([])).count() == 0
    assert spelling.variants(docs([(1, None), (2, "a b c ?")])).count() == 0


def test_query_over_tables(spark):
    from pathlib import Path

    import __spark_entry__ as entry

    at = "/root/testdata/sf0.001"
    if not Path(at).exists():
        pytest.skip("no test tables")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    assert found(entry.queries()["op11_permuterm_variants"](spark, at)) == brute(rows)
