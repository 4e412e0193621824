import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from swarmlake.llm import repeats
from swarmlake.llm.scratch import materialize


def brute(rows, long=400):
    """The contract, string by string."""
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        seen.update(b[s : s + long] for s in range(len(b) - long + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - long + 1):
            if seen[b[s : s + long]] > 1:
                gone[s : s + long] = b"\1" * long
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def found(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in df.collect())


def words(rng, n, letters="abcdefghijklmnopqrstuvwxyz é日"):
    return "".join(rng.choice(letters) for _ in range(n))


def planted(rng):
    """Passages of many lengths in many surroundings, copies, periods and shifted overlaps."""
    base = words(rng, 3000)
    rows = [(1, base), (2, words(rng, 700)), (3, None), (4, ""), (5, "short"), (5, "short"), (None, "x" * 450)]
    for k, n in enumerate([399, 400, 401, 450, 700, 1000]):
        a = rng.randrange(0, 1500)
        rows.append((10 + k, words(rng, rng.randrange(0, 500)) + base[a : a + n] + words(rng, rng.randrange(0, 500))))
    rows += [(20, base[500:1500] + words(rng, 300) + base[1200:2100]), (21, base[:600]), (22, base[-650:]), (23, base[100:520] + "#" + base[521:1000])]
    rows += [(30, "ab" * 600), (31, "z" + "ab" * 300), (32, "q" * 900), (33, "the same line again\n" * 60)]
    near = base[:1400]
    rows += [(40 + k, near[: 300 * k] + "~" + near[300 * k :]) for k in range(5)]
    copy = words(rng, 900)
    rows += [(50, copy), (51, copy), (52, copy[:500] + words(rng, 40)), (53, copy[:399]), (54, copy[:399])]
    head = words(rng, 380)
    return rows + [(60 + k, head + words(rng, 30 + k)) for k in range(4)] + [(70, "".join(words(rng, 410)) * 2)]


def test_removed_against_brute_force(spark, docs):
    rows = planted(random.Random(7))
    assert found(repeats.removed(docs(rows))) == brute(rows)
    assert found(repeats.removed(docs(rows).repartition(7), batches=1)) == brute(rows)


def test_many_texts_share_a_passage(spark, docs):
    rng = random.Random(3)
    passage = words(rng, 900)
    rows = [(k, words(rng, rng.randrange(40, 200)) + passage[rng.randrange(0, 200) : 900 - rng.randrange(0, 200)] + words(rng, rng.randrange(0, 200))) for k in range(60)]
    assert found(repeats.removed(docs(rows), batches=2)) == brute(rows)


def test_empty_and_edge_texts(spark, docs, edge):
    assert repeats.removed(docs([]), batches=1).count() == 0
    short = [(i, t) for i, t in edge if len(t or "") < 9000]
    assert found(repeats.removed(docs(short), batches=2)) == brute(short)
    got = {r["doc_id"]: r for r in repeats.removed(docs(edge), batches=1).collect() if r["doc_id"] in (9, 10)}
    assert got[9]["n_removed"] == got[9]["n_bytes"] == 24 * 6000 and got[10]["n_removed"] == 9000


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 101, 5000).astype(np.uint8).tobytes()
    whole = {s: p for _, p, a, b in zip(*repeats.anchors(data, np.array([0]), np.array([5000]))) for s in range(a, b + 1)}
    assert sorted(whole) == list(range(5000 - 400 + 1))
    for s in range(0, 4600, 37):
        _, place, first, last = repeats.anchors(data[s : s + 400], np.array([0]), np.array([400]))
        assert (place + s).tolist() == [whole[s]] and first.tolist() == last.tolist() == [0]


def test_pieces(monkeypatch):
    data = np.random.default_rng(6).integers(97, 123, 9000).astype(np.uint8).tobytes()
    starts, ends = np.array([0, 0, 3000, 3300]), np.array([0, 3000, 3300, 9000])
    before = repeats.anchors(data, starts, ends)
    monkeypatch.setattr(repeats, "PIECE", 501)
    assert all((a == b).all() for a, b in zip(before, repeats.anchors(data, starts, ends)))


def test_levels_merge(spark):
    family = repeats.SuffixFamily(spark)
    for k in range(5):
        family.add(spark.createDataFrame([(100 + k, 1, 5), (7, k, 0), (k // 2, k, 9)], "core long, row long, pos long"))
        assert sorted(family.levels) == [b for b in range(3) if (k + 1) >> b & 1]
    assert sorted(r["core"] for r in family.matches().collect()) == [0, 1, 7]
    assert sum(level.count() for level in family.levels.values()) == 15


def test_query_over_tables(spark):
    import __spark_entry__ as entry

    at = "/root/testdata/sf0.001"
    if not Path(at).exists():
        pytest.skip("no test tables")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    assert found(entry.queries()["op13_suffix_family"](spark, at)) == brute(rows)


def test_sketches_hold_all_texts(spark, docs, edge):
    assert materialize(repeats.sketched(repeats.numbered(docs(edge))), "test").count() == len(edge)
