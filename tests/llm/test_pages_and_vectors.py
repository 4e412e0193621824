import hashlib

import numpy as np
import pytest

from swarmlake.llm import main_text, scratch, topk, warc

PAGES = "page_id long, url string, html string, digest string, n int, `first` int, edge int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, 3) for r in rows], PAGES)


def brute_records(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == data and j is not None]
        first = min(same, default=None)
        again = len(data) >= 100 and first is not None and i != first
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return out


KEY = lambda r: tuple((x is None, x or 0) for x in r)
TRAP = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_warc_round_trip(spark):
    rows = [
        (1, "http://a/1", "x" * 200), (2, "http://a/2", "x" * 200), (3, None, "y" * 50), (4, "http://a/4\r\nX: y", "y" * 50), (5, "u", None), (6, "u", ""),
        (7, "u", f"<p>{TRAP * 3}é日本</p>"), (8, "u", TRAP + "WARC/1.0\r\n" * 5), (None, "u", "x" * 200), (9, "u", "z" * 70_000), (9, "u", "z" * 70_000), (10, "u", "\r\n\r\n" * 40),
    ]
    path = scratch.new_path(spark, "test-warc")
    warc.write(pages(spark, rows), path)
    assert sorted(map(tuple, warc.read(spark, path).collect()), key=KEY) == sorted(brute_records(rows), key=KEY)


def test_warc_across_splits(spark):
    rows = [(i, f"http://a/{i}", (TRAP if i % 3 else "") + f"body {i} " * 40 + TRAP * (i % 4)) for i in range(120)]
    path = scratch.new_path(spark, "test-warc")
    warc.write(pages(spark, rows).coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert sorted(map(tuple, warc.read(spark, path).collect()), key=KEY) == sorted(brute_records(rows), key=KEY)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_warc_across_splits_with_odd_ids_and_headers(spark):
    """Nulls, repeated ids and headers longer than a split lose and double nothing."""
    rows = [(i % 7 or None, f"http://a/{'x' * (70_000 if i % 5 == 0 else 9)}", TRAP * (i % 3) + f"body {i} " * 900 + TRAP * 40) for i in range(20)] + [(3, "u", TRAP * 300)] * 2
    path = scratch.new_path(spark, "test-warc")
    warc.write(pages(spark, rows).coalesce(1), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert sorted(map(tuple, warc.read(spark, path).collect()), key=KEY) == sorted(brute_records(rows), key=KEY)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_warc_empty(spark):
    path = scratch.new_path(spark, "test-warc")
    warc.write(pages(spark, []), path)
    assert warc.read(spark, path).count() == 0


def test_chain():
    start = np.array([0, 10, 15, 30, 40])
    after = np.array([10, 30, 99, 40, 77])
    assert warc.reachable(start, after).tolist() == [True, True, False, True, True]
    assert warc.reachable(start[1:], after[1:]).tolist() == [False] * 4
    assert warc.reachable(np.array([], dtype=int), np.array([], dtype=int)).tolist() == []


def test_main_text_of_marked_pages(spark):
    html = (
        "<html><head><title>T</title><script>if(a<b){'<p>x</p>'}</script></head><body class='has-sidebar'><header>Site</header><nav>menu</nav><div class='ad'>buy</div>"
        "<article><header><h1>A &amp; B</h1></header><p><b>one<br><p>two\n\n  words&nbsp;here</p><div class='comments'><p>c</p></div></article><footer>f</footer></body></html>"
    )
    rows = [(1, "http://a/x", html), (2, None, None), (3, "http://a/y", ""), (1, "http://a/x", html), (None, "::bad[", "<p>plain &lt;text&gt;")]
    got = main_text.extract(pages(spark, rows)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "plain <text>", 12), (1, "A & B one two words here", 24), (1, "A & B one two words here", 24), (2, "", 0), (3, "", 0)]
    assert main_text.extract(pages(spark, [])).count() == 0


@pytest.mark.parametrize("partitions", ["1", "4", "9"])
def test_differencing_does_not_depend_on_partitions(spark, partitions):
    frame = "<div>Menu one two</div><p>Our shop sells all things</p>"
    rows = [(i, f"http://h/{i:03d}", f"{frame}<p>Story {i} " + f"tells of number {i * 7} and more. " * 8 + "</p><div>All rights kept</div>") for i in range(40)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        texts = {r["page_id"]: r["text"] for r in main_text.extract(pages(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(t.startswith(f"Story {i} ") and t.endswith("more.") for i, t in texts.items())


def test_copies_lose_nothing(spark):
    rows = [(i, f"http://h/{i}", "<p>the same long story</p><p>on both pages</p>") for i in range(2)] + [(2, "http://g/1", "<p>alone</p>")]
    assert {r["page_id"]: r["text"] for r in main_text.extract(pages(spark, rows)).collect()}[0] == "the same long story on both pages"


def by_differencing(rows):
    """The text of each page by the rule of runs, on one sorted list, without names and marks."""
    signs = {}
    for i, u, h in rows:
        found = main_text.main_lines(h or "", False)
        host, path = main_text._host_path(u)
        signs.setdefault((host, tuple(x.text for x in found)), []).append((path, i, found))
    out = {}
    for host in {k[0] for k in signs}:
        line_up = sorted((min(p for p, _, _ in some), lines, some) for (h, lines), some in signs.items() if h == host)
        sign = [main_text.signature(some[0][2]) for _, _, some in line_up]
        run = [0] * len(sign)
        for k in range(1, len(sign)):
            run[k] = run[k - 1] + (main_text.shared_lines(sign[k - 1], sign[k]) is not None)
        for k, (_, _, some) in enumerate(line_up):
            near = [max((j for j in range(k) if run[j] == run[k] - 1), default=None), min((j for j in range(k + 1, len(sign)) if run[j] == run[k] + 1), default=None)]
            gone = {x for j in near if j is not None for x in (main_text.shared_lines(sign[j], sign[k]) or ([], []))[1]}
            for _, i, found in some:
                out[i] = " ".join(x.text for n, x in enumerate(found) if n not in gone)
    return out


@pytest.mark.parametrize("partitions", [1, 4, 9])
def test_runs_of_copies_over_ranges(spark, partitions):
    """Runs of near copies, at the head of a host too, lose the same lines however the pages are cut into ranges."""
    frame = "<div>Menu one two</div><p>Our shop sells all things of the world</p>"
    body = lambda run, k: " ".join(f"Sentence {j} of run {run}." for j in range(60)) + f" Copy {k}."
    page = lambda run, k: f"{frame}{''.join(f'<p>{s}.</p>' for s in body(run, k).split('.') if s)}<div>Rights kept</div>"
    rows = [(10 * run + k, f"http://h{run // 3}/{run:02d}/{k}", page(run, k)) for run in range(7) for k in range(10)]
    rows += [(900 + k, f"http://h0/00/{k}x", page(0, k)) for k in range(3)] + [(950, "http://one/", page(1, 1))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r["page_id"]: r["text"] for r in main_text.extract(pages(spark, rows), named=False).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == by_differencing(rows)
    assert sum("Menu" in t for t in got.values()) == 11  # h2 has one run and "one" one page: nothing differs there


def test_frames_go_where_no_word_names_them(spark):
    """With all lists off, what neighbours share goes, also around runs of copies."""
    frame = "<div>Menu one two</div><p>Our shop sells all things of the world, and has done so for years</p>"
    story = lambda i: f"Story {i} " + f"tells of number {i * 7}. " * 3
    rows = [(i, f"http://h/{i:03d}", f"{frame}<p>{story(i // 5)}</p><div>All rights kept</div>") for i in range(40)]
    texts = {r["page_id"]: r["text"] for r in main_text.extract(pages(spark, rows), named=False).collect()}
    assert texts == {i: story(i // 5).strip() for i, _, _ in rows}


def test_marks_name_the_block_itself():
    text = lambda page: [x.text for x in main_text.main_lines(page)]
    assert text("<div class='content has-sidebar'><div class='post-header'>Head</div><p>body</p></div>") == ["Head", "body"]
    assert text("<p>a long text that makes the page</p><article class='teaser'>more</article>") == ["a long text that makes the page", "more"]
    assert text("<form><p>all in a form</p></form>") == ["all in a form"]
    assert text("<table><tr><td class='sidebar'><div>m</div><ul><li>a<li>b</ul></td><td>text</td></tr></table>") == ["text"]
    assert text("<ul><li class='ad'><p>buy</p><li>item</ul>") == ["item"]


def test_many_equal_lines():
    """Lines that repeat take no memory by the square."""
    a, b = [1] * 30_000 + [2] + [1] * 10_000, [1] * 20_000 + [3] + [1] * 30_000
    left, right = main_text.common(a, b)
    assert len(left) == len(right) == 40_000


def test_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(0, 12)).tolist() for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        left, right = main_text.common(a, b)
        assert len(left) == table[-1, -1] and [a[i] for i in left] == [b[j] for j in right]
        assert left == sorted(set(left)) and right == sorted(set(right))


def brute_top(rows, k=5):
    q = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in q), default=0)
    q = [(i, np.pad(v, (0, dim - len(v)))) for i, v in q]
    out = []
    for own, (i, v) in enumerate(q):
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for at, (j, w) in enumerate(q) if at != own)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, [0.5] * 8) for i in range(30)] + [(2000, [9.0, 9.0]), (2001, [])]
    rows += [(3000, None), (3001, [None] * 8), (3002, [float("nan")] * 8), (3003, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, ring int, pivot int")
    assert sorted(map(tuple, topk.search(df, pivots=16).collect())) == brute_top(rows)
    few = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (51, [0.0, 0.0])]
    df = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.search(df).collect())) == brute_top(few)
    again = [(50, [1.0, 2.0]), (50, [2.0, -1.0]), (50, [1.0, 2.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0]), (3, [0.5, 0.5]), (3, [0.5, 0.25]), (100, [0.0, 1.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame(again, "vec_id long, embedding array<float>")
    for pivots in (1, 3, 64):
        assert sorted(map(tuple, topk.search(df, pivots=pivots).collect())) == brute_top(again)
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_over_many_partitions(spark, monkeypatch):
    """Queries and blocks meet, and each row once, where no partitions are put together and blocks are salted and asked in chunks."""
    monkeypatch.setattr(topk, "BLOCK", 10)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)] + [(1000 + i, [0.5] * 8) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        assert sorted(map(tuple, topk.search(df, pivots=16).collect())) == brute_top(rows)
    finally:
        spark.conf.set(name, before)
