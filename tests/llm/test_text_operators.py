import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from swarmlake.llm import backoff, batches, components, importance, quality_rules, queries, simhash, similar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute_fingerprint(t):
    w = WORD.findall(lower(t))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(len(rows)):
                if rows[a][0] is not None and rows[b][0] is not None and (fp[a] ^ fp[b]).bit_count() <= 3 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    out = []
    for k, (i, _) in enumerate(rows):
        out.append((i, fp[k], None if i is None else min(rows[m][0] for m in range(len(rows)) if label[m] == label[k] and rows[m][0] is not None)))
    return out


def variants(seed=0, n=60):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 500, 300)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.integers(0, 300, i % 7):
            words[at] = f"z{rng.integers(0, 99)}"
        rows.append((100 + i, " ".join(words)))
    return rows


def test_simhash(docs, edge):
    rows = edge + variants()
    got = [(r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs(rows)).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(brute_components(rows), key=key)
    assert simhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("shard", [16, 1000])
def test_shards_cut_again_lose_no_link(spark, shard):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 62, 12)
    fp = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for c in centre for _ in range(40)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fp)
    points = spark.createDataFrame([(x,) for x in signed], "fp long")
    largest = simhash.shards(points, shard=shard).groupBy("mask", "value", "low", "high").count().agg({"count": "max"}).first()[0]
    assert largest <= 4 * shard
    label = {r["node"]: r["label"] for r in components.components(simhash.links(points, shard=shard)).collect()}
    full = np.array(signed).view(np.uint64)
    brute = np.arange(len(full))
    close = np.bitwise_count(full[:, None] ^ full[None, :]) <= 3
    for _ in range(len(full)):
        new = np.array([brute[c].min() for c in close])
        if (new == brute).all():
            break
        brute = new
    assert [label.get(x, x) for x in signed] == [signed[i] for i in brute]


def test_bk_tree_finds_all():
    rng = np.random.default_rng(4)
    points = np.unique(rng.integers(0, 1 << 20, 700)).tolist()
    tree = simhash.BKTree()
    for p in points:
        tree.add(p)
    assert all(key == (tree.points[child] ^ tree.points[node]).bit_count() for node, some in enumerate(tree.children) for key, child in some.items())
    for q in points[::7]:
        assert sorted(tree.near(q, 3)) == [i for i, p in enumerate(points) if (p ^ q).bit_count() <= 3]


def test_repeated_doc_ids_join_no_texts(docs):
    """Two texts of one doc_id are two rows."""
    a, b, c = "alpha beta gamma delta", "one two three four five", "red green blue white black"
    got = Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs([(5, a), (7, a), (7, b), (9, c), (7, c)])).collect())
    assert got == Counter([(5, 5), (7, 5), (7, 7), (9, 7), (7, 7)])


def test_unnamed_documents_link(spark, tmp_path):
    """The query gives a row without a doc_id the smallest one that it reaches, and links go through it."""
    words = [f"w{i}" for i in range(400)]

    def text(seed):
        return " ".join(w if i != 5 * seed else f"z{seed}" for i, w in enumerate(words))

    texts = {s: brute_fingerprint(text(s)) for s in range(1, 60)}
    far = lambda a, b: (texts[a] ^ texts[b]).bit_count()
    a, b, c = next((a, b, c) for b in texts for a in texts for c in texts if far(a, b) <= 3 and far(b, c) <= 3 and far(a, c) > 3)
    rows = [(9, text(a)), (None, text(b)), (4, text(c)), (None, text(b)), (7, "red green blue white"), (None, "one two three four"), (3, None), (None, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, queries.QUERIES["op2_simhash_bk_trees"](spark, str(tmp_path)).collect()))
    names = [4, 4, 4, 4, 7, None, 3, 3]
    assert got == Counter((i, f"{brute_fingerprint(t):016x}", n) for (i, t), n in zip(rows, names))


def shingles(t, width=5):
    w = WORD.findall(lower(t))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_kept(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) >= 0.8 * union:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    best = {}
    for k, (i, _) in enumerate(rows):
        best[label[k]] = min(best.get(label[k], (True, 0)), (i is None, i or 0))
    return Counter(None if none else i for none, i in best.values())


@pytest.mark.parametrize("shard", [4, 2048])
def test_keep_one_of_similar_texts(docs, edge, monkeypatch, shard):
    monkeypatch.setattr(similar.shards, "__defaults__", (shard,))
    rng = np.random.default_rng(6)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = edge + variants(1, 30) + [(7, "another text that has the number of seven"), (None, "a text without a number of its own")]
    rows += [(300 + i, f"{passage} " + " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60))) for i in range(20)]
    kept = similar.keep_one(docs(rows))
    assert kept.columns == docs([]).columns
    got, want = Counter(r["doc_id"] for r in kept.collect()), brute_kept(rows)
    assert got == want
    assert similar.keep_one(docs([])).count() == 0


def edited(rng, words, share):
    """The words with so many of them replaced that shingles of about ``share`` are others."""
    out = list(words)
    for k in rng.choice(len(out), max(1, int(share * len(out) / 5)), replace=False):
        out[k] = f"e{rng.integers(10**9)}"
    return " ".join(out)


@pytest.mark.parametrize("names, radius, shard", [(6, 22, 2048), (1, 6, 3)])
def test_links_at_the_limit_are_not_lost(docs, monkeypatch, names, radius, shard):
    """Many copies of similarity about 0.8, also where the sketches find hardly any of them."""
    monkeypatch.setattr(similar, "NAMES", names)
    monkeypatch.setattr(similar.neighbours, "__defaults__", (similar.LEAST, radius))
    monkeypatch.setattr(similar.links, "__defaults__", (similar.LEAST, radius))
    monkeypatch.setattr(similar.shards, "__defaults__", (shard,))
    monkeypatch.setattr(similar.crossing, "__defaults__", (similar.LEAST, shard))
    rng = np.random.default_rng(11)
    rows, passage = [], [f"p{k}" for k in range(60)]
    for group in range(40):
        base = [f"g{group}w{k}" for k in range(int(rng.integers(6, 150)))] + (passage if group % 3 else [])
        rows += [(100 * group + k, edited(rng, base, rng.uniform(0.02, 0.13))) for k in range(5)]
        rows += [(100 * group + 50 + k, " ".join(base[: int(len(base) * f)])) for k, f in enumerate((0.97, 0.85, 0.8, 0.75))]
    kept = similar.keep_one(docs(rows).repartition(5))
    assert Counter(r["doc_id"] for r in kept.collect()) == brute_kept(rows)


def test_components_of_a_path(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def brute_measures(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(windows)
    inside = {i + k for i, g in enumerate(windows) if n[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside)


def test_quality_measures(docs, edge):
    rows = edge + [(20, "a b c d e f a b c d e g\nx\nx\n\nx"), (21, "# a | b & c <d>"), (22, " ".join(f"word{i}" for i in range(40))), (23, "SHOUT!! " * 3 + " ".join(f"LOUD{i}!!" for i in range(30)))]
    rows.append((24, "in in in in es es es es " + " ".join(f"u{i}" for i in range(5))))
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.judge(docs(rows)).collect()}
    for i, t in rows:
        m = brute_measures(t)
        r = got[i, m[0]]
        assert tuple(r[c] for c in quality_rules.MEASURES) == m
        assert r["base_failed"] == (m[0] < 10 or 100 * m[4] > 20 * m[0])
    assert got[22, 40]["kept"] and not got[23, 33]["kept"] and not got[24, 13]["kept"]
    kept = quality_rules.keep(docs(rows))
    assert kept.columns == docs([]).columns and [r["doc_id"] for r in kept.collect()] == [22]
    assert quality_rules.judge(docs([])).count() == 0


def test_cascade_order_does_not_change_verdicts(docs):
    rows = [(i, t) for i, t in enumerate(["# " * 20 + "a", "ok " + " ".join(f"w{i}" for i in range(30)), "A B C D E F G H I J K L"])]
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        assert {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs(rows), rules).collect()} == {0: False, 1: True, 2: False}


def brute_scores(rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    texts = [(i, ["<s>", *WORD.findall(lower(t)), None]) for i, t in rows]
    train = [w for i, w in texts if not held(i)]
    grams = Counter(tuple(w[k - n : k]) for w in train for k in range(2, len(w) + 1) for n in (1, 2, 3) if n <= k and w[k - 1 : k] != ["<s>"])
    starts = len(train)
    n_tokens = sum(len(w) - 1 for w in train)
    kinds = sum(len(g) == 1 for g in grams)
    seen = lambda h: starts if h == ("<s>",) else grams[h]

    def p(h, v):
        if not h:
            return (grams[v,] + 0.1) / (n_tokens + 0.1 * (kinds + 1))
        mass = backoff.MASS_1 if len(h) == 1 else backoff.MASS_2
        return (grams[(*h, v)] + mass * p(h[1:], v)) / (seen(h) + mass)

    for i, w in texts:
        steps = [(tuple(w[max(0, k - 2) : k]), w[k]) for k in range(1, len(w))]
        base = sum(math.log10(p((), v)) for _, v in steps)
        yield i, held(i), len(steps), sum(grams[v,] > 0 for _, v in steps), n_tokens, base, sum(math.log10(p(h, v)) for h, v in steps)


@pytest.mark.parametrize(("bundle", "part"), [(1 << 20, 1 << 20), (300, 64)])
def test_backoff_automaton(docs, edge, monkeypatch, bundle, part):
    """Whatever the size of bundles and parts, scores are those of the whole model."""
    monkeypatch.setattr(backoff, "BUNDLE", bundle)
    monkeypatch.setattr(backoff, "PART", part)
    rows = [(i, t if i != 9 else t[:4000]) for i, t in edge] + [(i, " ".join(f"w{(i * k) % 17}" for k in range(1, 40)) + f" The end of x{i // 2}") for i in range(100, 130)]
    key = lambda r: tuple((x is None, x or 0) for x in tuple(r)[:4]) + (round(tuple(r)[5], 3),)
    for a, b in zip(sorted(map(tuple, backoff.score(docs(rows)).collect()), key=key), sorted(brute_scores(rows), key=key), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


def test_backoff_of_nothing(docs):
    assert backoff.score(docs([])).count() == 0


def test_backoff_probabilities_sum_to_one():
    """After any history, over all words and the unknown one."""
    facts = backoff.Facts(tokens=50, kinds=4, texts=3)
    c1, c2, c3 = np.array([20, 15, 10, 5, 0]), np.array([6, 1, 0, 3, 0]), np.array([2, 0, 0, 1, 0])
    p1 = (c1 + backoff.ADD) / facts.norm
    p2 = (c2 + backoff.MASS_1 * p1) / (c2.sum() + backoff.MASS_1)
    p3 = (c3 + backoff.MASS_2 * p2) / (c3.sum() + backoff.MASS_2)
    assert np.allclose([p1.sum(), p2.sum(), p3.sum()], 1)


def brute_features(t):
    spaced = re.sub(r"([^\W\d_]|\d|\s)|(_|[^\w\s])+", lambda m: m[0] if m[1] else f" {m[0]} ", (t or "").lower())
    h = [xxhash.xxh64_intdigest(x.encode(), importance.SEED) for x in WORD.findall(spaced)]
    pairs = [int(batches.mixed(np.array([a], dtype=np.uint64), np.array([b], dtype=np.uint64))[0]) for a, b in zip(h, h[1:])]
    return {(x >> 24) % importance.BUCKETS for x in h + pairs}


def labelled_rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(800):
        text = list(rng.choice(words, 60))
        kind = i % 4
        if kind == 2:
            text = [f"{w}###" for w in text]
        if kind == 3:
            for at in rng.choice(60, 6, replace=False):
                text[at] = ("nasty", "mean", "vile")[at % 3]
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind != 2), int(kind == 3)))
    return rows, labels


def test_importance(spark, docs, edge):
    rows, labels = labelled_rows()
    marks = spark.createDataFrame(labels[:600] + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in importance.resample(docs(rows), marks).collect()}
    right = [got[i] == (i % 4 < 2) for i in range(600, 800)]
    assert np.mean(right) > 0.95
    kept = importance.keep(docs(rows), marks)
    assert kept.columns == docs([]).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in importance.resample(docs(edge), none).collect())
    assert importance.resample(docs([]), marks).count() == 0
    assert sum(r["kept"] for r in importance.resample(docs(edge[:8]), none, k=3).collect()) >= 3


def test_importance_against_brute_force(spark, docs, edge):
    """Weights from counts of all texts, copies once; the sample by noise and a given k."""
    rows, labels = labelled_rows()
    rows = [(i, t) for i, t in rows if i < 200] + [(1000 + i, rows[i][1]) for i in range(40)] + [(i + 2000 if i else i, t) for i, t in edge if i is None or i != 9]
    marks = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    sample = importance.labelled(docs(rows), marks)
    fitted = {r["text"] for r in sample.filter("fitted").collect()}
    texts = dict(rows)
    target = Counter(b for i in range(200) if i % 4 < 2 and texts[i] in fitted for b in brute_features(texts[i]))
    first = {t: i for i, t in sorted(rows, key=lambda r: -(r[0] if r[0] is not None else 10**9))}
    raw = Counter(b for i, t in rows if first[t] == i for b in brute_features(t))
    at = np.array(sorted(raw))
    t, r = (np.array([c[b] for b in at], dtype=float) for c in (target, raw))
    order = np.argsort(t / r)
    bulk = (t / r)[order][np.searchsorted(np.cumsum(r[order]), r.sum() / 2)] or t.sum() / r.sum()
    z2 = (t - r * bulk) ** 2 / (r * bulk + 1)
    weight = dict(zip(at.tolist(), np.log((t + importance.PRIOR) / (r * bulk + importance.PRIOR)) * z2 / (z2 + importance.SURE**2)))
    want = Counter((i, round(sum(weight[b] for b in brute_features(x)), 6)) for i, x in rows)
    got = importance.resample(docs(rows), marks, k=50).collect()
    assert Counter((r["doc_id"], round(r["log_weight"], 6)) for r in got) == want
    cut = sorted((r["noisy_weight"] for r in got), reverse=True)[49]
    assert all(r["kept"] == (r["noisy_weight"] >= cut) for r in got)


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = [int(x) for x in rng.integers(-(10**15), 10**15, 500)] + [3, 3, 3]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 7, 250, 503):
        assert importance.kth_largest(df, "v", k, fan=16) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, "v", 0) is None and importance.kth_largest(df, "v", 504) is None


def test_bound_of_buckets_excludes_no_similar_sets():
    rng = np.random.default_rng(4)
    sets = []
    for n in (0, 1, 7, 60, 400, 40_000):
        base = batches.distinct(rng.integers(0, 2**32, n).astype(np.uint64))
        for cut in (0.0, 0.05, 0.1, 0.3, 0.9):
            sets.append(np.concatenate([base[rng.random(len(base)) >= cut], rng.integers(0, 2**32, int(n * cut)).astype(np.uint64)]))
    sets = [np.unique(s) for s in sets]
    size = np.array([len(s) for s in sets])
    spread = np.array([np.minimum(np.bincount((s % similar.SPREAD).astype(int), minlength=similar.SPREAD), 255) for s in sets]).astype(np.uint8)
    others, ended = list(range(len(sets))), 0
    for i, a in enumerate(sets):
        left = similar.may_reach(0.8, size, spread, i, others)
        ended += len(others) - len(left)
        for j, b in enumerate(sets):
            assert j in left or similar.similarity(a, b) < 0.8
    assert ended > len(sets) ** 2 / 2
