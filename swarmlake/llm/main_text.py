"""Main text of web pages by nearest-URL differencing (operator 4).

A page becomes lines, one for each block, without the elements that say
themselves what they are (menus, footers, forms, scripts ...). Within a host, pages
of equal lines are one; the others are sorted by URL path. Pages of which each is a
near copy of the one before make a run; each page is aligned with the nearest pages
of the runs before and after its own, by the longest common subsequence of its lines. Shared lines go, unless they are headings or stand in
what the page itself marks as its article and most of its text: passages that
articles have in common are text, not frame. Pages that share all but a tenth of
their text are copies of an article, not frames around different ones.

Only hashes of lines travel for the alignment. The sort is by range, so a host of
any size spreads over tasks; pages at the start of a range, whose run may have begun
before it, are aligned afterwards, so the result does not depend on the ranges. An alignment takes memory in
proportion to the lines, however often they repeat.

Null and empty html gives empty text; a null url is a host of its own with an
empty path. Repeated rows lose the same lines; nothing is cut from long pages.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .scratch import drop, materialize

# Element names and the words of class, id and role that name what is no main text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas"}
REMOVED = {"nav", "footer", "aside", "form", "dialog", "menu", "select", "button"} | RAW
HEADER = {"header"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "meter", "nobr", "output", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
ENDED_BY_BLOCK = {"p", "li", "dt", "dd", "td", "th", "option"}
MARKED = {
    "ad", "ads", "adbox", "advert", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "menu", "nav",
    "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "masthead", "cookie", "cookies", "consent", "gdpr", "notice",
    "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "comment", "comments", "disqus",
    "respond", "reply", "replies", "related", "recommended", "recommendations", "share", "sharing", "social", "widget", "toolbar", "pagination",
    "pager", "copyright", "disclaimer", "skip",
}
COMMENT = {"comment", "comments", "reply", "replies", "disqus", "respond"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar", "toolbar"}
KEPT_WHOLE = {"html", "body", "main"}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")
COPY = 0.9  # share of a page's text in common with another from which they are copies
# Words that say what a name with a marked word is about, or that the marked thing is elsewhere.
CONTENT = {"content", "article", "post", "entry", "main", "story"}
ABOUT = {"has", "no", "with", "without", "show", "hide", "is"}
PARENTS = {"ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "select"}


class Line:
    __slots__ = ("heading", "inside", "text")

    def __init__(self, text: str, inside: bool, heading: bool):
        self.text, self.inside, self.heading = text, inside, heading


def _removed(name: str, attributes: str, inside: bool) -> bool:
    if name in KEPT_WHOLE:
        return False
    if name in REMOVED or (name in HEADER and not inside):
        return True
    if not attributes:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    words: set[str] = set()
    for token in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        some = _WORD.findall(token)
        if some and some[0] not in ABOUT and (not CONTENT & set(some) or COMMENT & set(some)):
            words.update(some)
    if name == "article":
        return bool(words & COMMENT)
    if found.get("role", "").lower() in ROLES:
        return True
    return bool(words & (MARKED - {"header"} if inside else MARKED))


def lines(page: str, forms: bool = False, named: bool = True) -> list[Line]:
    """The blocks of a page in order, white space made single, without what is no main text; ``forms`` are text if asked."""
    out: list[Line] = []
    parts: list[str] = []
    at, articles, heading = 0, 0, False
    skipped, depth, inner = "", 0, 0  # the element left out, how many of its name are open, and parents of items inside it

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Line(text, articles > 0, heading))
        parts.clear()

    tags = _TAG.finditer(page)
    raw_until = 0
    for tag in tags:
        if tag.start() < raw_until:
            continue
        if not skipped:
            parts.append(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing = bool(tag[1])
        block = name not in INLINE
        if skipped:
            if name == skipped:
                depth += -1 if closing else 1
                if skipped in ENDED_BY_BLOCK and not closing and not inner:
                    depth = 0
            elif skipped == "p" and block and name not in VOID:
                depth = 0
            elif skipped in ENDED_BY_BLOCK and name in PARENTS:
                depth = 0 if closing and not inner else depth
                inner += -1 if closing else 1
            if depth > 0:
                continue
            ended_by_itself = name == skipped and closing
            skipped = ""
            if ended_by_itself:
                continue
        if block:
            flush()
        if closing:
            if name in ("article", "main"):
                articles = max(0, articles - 1)
            if re.fullmatch("h[1-6]", name):
                heading = False
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            raw_until = at = end.end() if end else len(page)
            continue
        if named and name not in VOID and not (forms and name == "form") and _removed(name, tag[3], articles > 0):
            if not tag[3].rstrip().endswith("/"):
                skipped, depth, inner = name, 1, 0
            continue
        if name in ("article", "main"):
            articles += 1
        if re.fullmatch("h[1-6]", name):
            heading = True
    if not skipped:
        parts.append(page[at:])
    flush()
    return out


def main_lines(page: str, named: bool = True) -> list[Line]:
    """The lines of the marked article where it has most of the text, else all; a page that is one form is that form."""
    found = lines(page, named=named) or lines(page, forms=True)
    inside = [x for x in found if x.inside]
    if named and 2 * sum(len(x.text) for x in inside) > sum(len(x.text) for x in found):
        return inside
    for x in found:
        x.inside = False
    return found


def _prefixes(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a`` and each prefix of ``b``, bit by bit in one number."""
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        found = row & places.get(x, 0)
        row = ((row + found) | (row - found)) & every
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8) or 1, "little"), dtype=np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Places of a longest common subsequence in both: equal ends first, halves of what is left by where they meet best."""
    left: list[int] = []
    right: list[int] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        i, m, j, n = stack.pop()
        while i < m and j < n and a[i] == b[j]:
            left.append(i)
            right.append(j)
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            left.append(m)
            right.append(n)
        if i == m or j == n:
            continue
        if m - i == 1:
            if a[i] in b[j:n]:
                left.append(i)
                right.append(b.index(a[i], j, n))
            continue
        half = (i + m) // 2
        upper = _prefixes(a[i:half], b[j:n])
        lower = _prefixes(a[half:m][::-1], b[j:n][::-1])[::-1]
        meet = j + int(np.argmax(upper + lower))
        stack += [(i, half, j, meet), (half, m, meet, n)]
    return sorted(left), sorted(right)


def signature(found: list[Line]) -> tuple[list[int], list[int], list[bool]]:
    """Hash and characters of each line, and whether it may go when shared."""
    hashes = [xxhash.xxh64_intdigest(x.text.encode("utf-8", "surrogatepass")) - (1 << 63) for x in found]
    may_go = [not x.heading and not x.inside for x in found]
    return hashes, [len(x.text) for x in found], may_go


def shared_lines(a: tuple, b: tuple) -> tuple[list[int], list[int]] | None:
    """Lines that two pages lose by each other, each given as (hashes, characters, may_go); nothing for copies."""
    both = set(a[0]) & set(b[0])
    if not both:
        return [], []
    at, bt = ([k for k, x in enumerate(page[0]) if x in both] for page in (a, b))
    left, right = common([a[0][k] for k in at], [b[0][k] for k in bt])
    left, right = [at[k] for k in left], [bt[k] for k in right]
    for places, page in ((left, a), (right, b)):
        if sum(page[1][i] for i in places) > COPY * sum(page[1]):
            return None
    return [i for i in left if a[2][i]], [j for j in right if b[2][j]]


def _host_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), parts.path
    except ValueError:
        return "", url or ""


SIGNED = "key long, host string, path string, hashes array<long>, chars array<int>, may_go array<boolean>"
ALIGNED = "key long, cut array<int>, part int, edge int, host string, hashes array<long>, chars array<int>, may_go array<boolean>"


def signed(pages: DataFrame, named: bool = True) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            hosts = [_host_path(u) for u in batch.column("url").to_pylist()]
            signs = [signature(main_lines(x or "", named)) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array([h for h, _ in hosts], pa.string()),
                    pa.array([p for _, p in hosts], pa.string()),
                    pa.array([s[0] for s in signs], pa.list_(pa.int64())),
                    pa.array([s[1] for s in signs], pa.list_(pa.int32())),
                    pa.array([s[2] for s in signs], pa.list_(pa.bool_())),
                ],
                ["key", "host", "path", "hashes", "chars", "may_go"],
            )

    return pages.mapInArrow(run, SIGNED)


def aligned(signs: DataFrame, descending: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines that each page loses by the run of copies before it (after it, if descending), and what is open at ranges' starts.

    In the order of host and path, pages of which each is a copy of the one before make
    a run; a page is aligned with the nearest page of the run before its own. Only the
    first run of a range may have begun in an earlier one: its pages stay open. The
    first, the last and the page before the last run of each range tell what they meet.
    """
    n = int(signs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc(c) if descending else F.asc(c) for c in ("host", "path", "key")]
    schema = pa.schema([("key", pa.int64()), ("cut", pa.list_(pa.int32())), ("part", pa.int32()), ("edge", pa.int32()), ("host", pa.string()), ("hashes", pa.list_(pa.int64())), ("chars", pa.list_(pa.int32())), ("may_go", pa.list_(pa.bool_()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, before, unknown = TaskContext.get().partitionId(), None, None, True
        row = lambda r, cut=None, edge=None: {"key": r["key"], "cut": cut, "part": part, "edge": edge} | ({} if cut else {c: r[c] for c in PAGE})
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cut = None
                if last is None:
                    out.append(row(r, edge=FIRST))
                elif last["host"] != r["host"]:
                    before, unknown = None, False
                else:
                    met = shared_lines(_sign(last), _sign(r))
                    if met is not None:
                        before, unknown, cut = last, False, met[1]
                if unknown:
                    out.append(row(r, edge=OPEN))
                elif before is not None:
                    if cut is None:
                        cut = (shared_lines(_sign(before), _sign(r)) or ([], []))[1]
                    if cut:
                        out.append(row(r, cut))
                last = r
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if last is not None:
            ends = [row(last, edge=LAST)] + ([row(before, edge=BEFORE)] if before is not None else []) + ([row(last, edge=ONE_RUN)] if unknown else [])
            yield pa.RecordBatch.from_pylist(ends, schema=schema)

    found = materialize(signs.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, ALIGNED), "aligned-pages")
    return found.filter("cut is not null").select("key", "cut"), found.filter("edge is not null")


FIRST, LAST, BEFORE, ONE_RUN, OPEN = range(5)
PAGE = ("host", "hashes", "chars", "may_go")


def _sign(r: dict) -> tuple:
    return r["hashes"], r["chars"], r["may_go"]


def met_before(edges: DataFrame) -> DataFrame:
    """(part, hashes, chars, may_go): the page that a range's first run is aligned with; from four rows a range at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, dict[int, dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                ranges.setdefault(r["part"], {})[r["edge"]] = r
        out, earlier, carried = [], None, None
        for part in sorted(ranges):
            own = ranges[part]
            if earlier is None or earlier[LAST]["host"] != own[FIRST]["host"]:
                carried = None
            elif shared_lines(_sign(earlier[LAST]), _sign(own[FIRST])) is not None:
                carried = earlier[LAST]
            elif ONE_RUN not in earlier:
                carried = earlier.get(BEFORE)
            if carried is not None:
                out.append({"part": part} | {c: carried[c] for c in PAGE[1:]})
            earlier = own
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("part", pa.int32()), ("hashes", pa.list_(pa.int64())), ("chars", pa.list_(pa.int32())), ("may_go", pa.list_(pa.bool_()))]))

    return edges.filter(F.col("edge") < OPEN).coalesce(1).mapInArrow(run, "part int, hashes array<long>, chars array<int>, may_go array<boolean>")


def opened(edges: DataFrame) -> DataFrame:
    """Lines that the open pages of each range lose."""
    carried = materialize(met_before(edges).select("part", *[F.col(c).alias(f"met_{c}") for c in PAGE[1:]]), "met-pages")
    pairs = edges.filter(F.col("edge") == OPEN).join(carried, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, cuts = [], []
            for r in batch.to_pylist():
                met = shared_lines((r["met_hashes"], r["met_chars"], r["met_may_go"]), _sign(r))
                if met is not None and met[1]:
                    keys.append(r["key"])
                    cuts.append(met[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(cuts, pa.list_(pa.int32()))], ["key", "cut"])

    return pairs.mapInArrow(run, "key long, cut array<int>")


def cut_lines(signs: DataFrame) -> DataFrame:
    """(key, cut): the lines that each page loses by the pages before and after it."""
    every = []
    for descending in (False, True):
        cuts, edges = aligned(signs, descending)
        every += [cuts, opened(edges)]
    lost = reduce(DataFrame.unionByName, every)
    return lost.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("cut"))  # four lists at most


def extract(pages: DataFrame, named: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Without ``named``, no element goes by its name or marks and none is taken for the
    article: the differencing alone decides.
    """
    keyed = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    # pages of equal lines align alike, so the one of the smallest path stands for all of a host
    signs = materialize(signed(keyed.select("key", "url", "html"), named).withColumn("lines", F.xxhash64("host", "hashes", "may_go")), "page-lines")
    first = signs.groupBy("lines").agg(F.min(F.struct("path", "host", "hashes", "chars", "may_go")).alias("p"))
    cuts = cut_lines(materialize(first.select(F.col("lines").alias("key"), "p.*"), "distinct-pages")).withColumnRenamed("key", "lines")
    cuts = materialize(signs.select("key", "lines").distinct().join(cuts, "lines").select("key", "cut"), "shared-lines")
    drop(signs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = []
            for page, cut in zip(batch.column("html").to_pylist(), batch.column("cut").to_pylist()):
                gone = set(cut or ())
                texts.append(" ".join(x.text for i, x in enumerate(main_lines(page or "", named)) if i not in gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    joined = keyed.join(cuts, "key", "left").select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "cut")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
