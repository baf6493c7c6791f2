"""Main text of web pages by nearest-URL page differencing.

1. A page becomes lines: one for each block of text, in page order, with
   character references decoded and white space as single spaces.  Scripts,
   styles, comments and other parts that show no text give none.
2. Within each host, distinct pages are sorted by URL path, and each page is
   paired with the neighbour whose path it shares the longest beginning with.
   The lines of both are aligned by a longest common subsequence; shared lines
   are the frame of the site, and go.
3. Markup comes before the difference where it is plain.  Lines inside menus,
   headers, footers, sidebars, notices, adverts, forms and reader comments go
   even if no other page shares them, and lines of the element that holds the
   article stay even if another page quotes them.  What is left, text that
   markup says nothing about, is decided by the difference.

The rule of step 3 is there because the difference alone gives wrong results:
an advert that one page has stays, and a paragraph that two pages of a host
share goes (figures in the README).

A hot host is many partitions: pages are range-partitioned by (host, path), and
neighbours across a border meet in a second step that holds two pages of each
partition.  Only hashes of lines are moved for the pairing; equal pages of a
host are one page there, so a copy is never the neighbour.

Defined results: null html is empty and gives an empty text; a null or odd URL
has an empty host or path and pairs with others alike; rows repeated under one
id are rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import join_groups, map_arrow, save

# ---- markup -------------------------------------------------------------

# Fixed values of HTML.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody
    td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup, up to the end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: A start tag on the left ends an open element on the right, unless one of the last column is in between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
NO_PARAGRAPH = BLOCKS - {"caption", "head", "html", "body", "legend", "optgroup", "option", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}
P_SCOPE = frozenset("button caption html object table td th article aside section nav main header footer form div blockquote li".split())

#: Elements whose text nobody reads as part of the page.
UNSEEN = frozenset("head script style template noscript noembed noframes iframe object svg math canvas audio video map title datalist select option textarea".split())
#: Parts of a page that are not its article.
PARTS = frozenset("nav footer aside menu dialog search button".split())
#: Words of class and id names, and roles, that say so too.
NAMES = frozenset("""ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices alert popup modal overlay newsletter subscribe signup paywall nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar
    widget widgets related recommended masthead topbar footer colophon copyright comment comments disqus reply replies respond share sharing social login""".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
MAIN = frozenset("article main".split())
OPENED = frozenset("nav header form menu".split())
MAIN_NAMES = frozenset("article-body entry-content post-content story-body main-content".split())

TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+')?+)*+)(>|\Z)|!--(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*+(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")

FRAME, OPEN, KEPT = 0, 1, 2     # what markup says of a line: goes, nothing, stays


def _role(tag: str, attributes: str, now: int | None, inside: frozenset[str]) -> tuple[int | None, frozenset[str]]:
    """What markup says of an element's text (None: unseen), and the parts of
    the page that it stands in ("*": a part by its name or role)."""
    if now is None or tag in UNSEEN:
        return None, inside
    name, role, keep = [], "", tag in MAIN
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
            if key in ("class", "id"):
                name += value.split()
            elif key == "role":
                role = value.strip().lower()
            elif key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower():
                return None, inside
            elif key == "itemprop" and value == "articleBody":
                keep = True
    named = tag not in ("html", "body") and any(w.lower() in NAMES for x in name for w in WORDS.findall(x))
    keep = keep or role in MAIN or bool(MAIN_NAMES & {x.lower() for x in name})
    if tag in PARTS or tag == "form" or tag == "header" and now != KEPT:
        return FRAME, inside | {tag}
    if role in ROLES or named and (tag in MAIN or not keep):        # a reader's comment may be an article
        return FRAME, inside | {"*"}
    if keep and not inside - OPENED:        # the article ends what a page head, menu or form left open
        return KEPT, frozenset()
    return now, inside


class _Page:
    """Open elements and the lines so far."""

    def __init__(self):
        self.stack: list[tuple[str, int | None, frozenset[str]]] = []    # tag, role, parts it stands in
        self.lines: list[tuple[str, int]] = []
        self.text: list[str] = []

    @property
    def now(self) -> int | None:
        return self.stack[-1][1] if self.stack else OPEN

    def end_line(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                self.lines.append((line, self.now))
            self.text = []

    def add(self, text: str) -> None:
        if text and self.now is not None:
            self.text.append(entities.unescape(text))

    def pop_to(self, k: int) -> None:
        self.end_line()
        del self.stack[k:]

    def close(self, names, scope) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in names:
                return self.pop_to(k)
            if self.stack[k][0] in scope:
                return None
        return None

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.end_line()
            if tag in NO_PARAGRAPH:
                self.close(("p",), P_SCOPE)
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        if tag == "br":
            self.add(" ")
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            return
        role, inside = _role(tag, attributes, self.now, self.stack[-1][2] if self.stack else frozenset())
        if role != self.now:
            self.end_line()
        self.stack.append((tag, role, inside))

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                if self.stack[k][1] != (self.stack[k - 1][1] if k else OPEN):
                    self.end_line()
                if tag in BLOCKS or k == len(self.stack) - 1:
                    del self.stack[k:]
                else:           # an inline element that was left open inside a block stays out of it
                    del self.stack[k]
                return
            if tag not in BLOCKS and self.stack[k][0] in BLOCKS:
                return


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """(line, what markup says of it) of a page."""
    page, src, at = _Page(), html or "", 0
    while (m := TAG.search(src, at)) is not None:
        page.add(src[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            page.end(tag)
            continue
        if not m[4]:            # the page ends inside a tag
            break
        page.start(tag, m[3])
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(src, at)
            at = stop.start()
    else:
        page.add(src[at:])
    page.end_line()
    return page.lines


# ---- alignment ----------------------------------------------------------

#: Bits of alignment rows that are held at once; larger pairs are halved.
TABLE_BITS = 1 << 26


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit rows of the alignment of a's beginnings with b: in row i, bit j is 0
    where b[j] makes the common subsequence with a[:i] longer."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for x in a:
        u = row & at.get(x, 0)
        row = (row + u | row - u) & full
        rows.append(row)
    return rows


def _lengths(row: int, n: int) -> np.ndarray:
    """Length of the common subsequence with each beginning of b."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def _last_row(a: list[int], b: list[int]) -> int:
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        u = row & at.get(x, 0)
        row = (row + u | row - u) & full
    return row


def lcs(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence with b."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mine, other = set(a[head:len(a) - tail]), set(b[head:len(b) - tail])
    place = [i for i in range(head, len(a) - tail) if a[i] in other]
    x, y = [a[i] for i in place], [v for v in b[head:len(b) - tail] if v in mine]
    return [*range(head), *(place[i] for i in _inner(x, y)), *range(len(a) - tail, len(a))]


def _inner(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > TABLE_BITS:
        half = len(a) // 2
        front, back = _lengths(_last_row(a[:half], b), len(b)), _lengths(_last_row(a[:half - 1:-1], b[::-1]), len(b))
        cut = int(np.argmax(front + back[::-1]))
        return lcs(a[:half], b[:cut]) + [half + i for i in lcs(a[half:], b[cut:])]
    rows, out, j = _rows(a, b), [], len(b) - 1
    for i in range(len(a), 0, -1):
        # a[i-1] is matched where the row makes a longer one than the row before
        while j >= 0 and rows[i] >> j & 1:
            j -= 1
        if j < 0:
            break
        if rows[i - 1] >> j & 1:
            out.append(i - 1)
            j -= 1
    return out[::-1]


# ---- pairing ------------------------------------------------------------

def host_of(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), r"^.*@|:\d*$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)


PARSED = "page_id long, url string, host string, path string, text string, kept long, n_lines long, n_open long, lines array<string>, marks binary, hashes binary, digest long"


def _parsed(pages: DataFrame) -> DataFrame:
    """Pages with their lines; ``text`` is there where no line is open, ``lines`` where one is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for html in part.column("html"):
                    lines = page_lines(html.as_py())
                    marks = bytes(mark for _, mark in lines)
                    hashes = b"".join(hashlib.blake2b(line.encode("utf-8", "replace"), digest_size=8).digest() for line, _ in lines)
                    known = OPEN not in marks
                    out.append(("\n".join(x for x, mark in lines if mark == KEPT) if known else None, marks.count(KEPT), len(marks), marks.count(OPEN),
                                None if known else [x for x, _ in lines], None if known else marks, hashes,
                                int.from_bytes(hashlib.blake2b(hashes + marks, digest_size=8).digest(), "little", signed=True)))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host", "path")), *(pa.array(c, t) for c, t in zip(zip(*out), kinds))],
                                                 names=[c.split()[0] for c in PARSED.split(", ")])

    url = F.col("url").cast("string")
    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"),
                                  F.col("html").cast("string").alias("html")), run, PARSED)


def _alike(a: str, b: str) -> int:
    """Bytes that two paths begin with alike."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


SHARED = "host string, digest long, alike int, shared array<int>, part int, path string, hashes binary"


def _compare(rows: Iterator[dict], border: bool) -> Iterator[tuple]:
    """Each page against the page before and the one after it of its host, from
    rows in order: (host, digest, alike, shared lines, part, path, hashes); the
    last three only for the first and last row of a partition, which meet their
    other neighbour later.  With ``border`` only pages of different partitions
    are compared."""
    def pair(x: dict, y: dict) -> Iterator[tuple]:
        if x["host"] == y["host"] and (not border or x["part"] != y["part"]):
            same = _alike(x["path"], y["path"])
            one, two = (np.frombuffer(z["hashes"], np.int64).tolist() for z in (x, y))
            yield (x["host"], x["digest"], same, lcs(one, two), None, None, None)
            yield (y["host"], y["digest"], same, lcs(two, one), None, None, None)

    def edge(x: dict) -> tuple:
        return (x["host"], x["digest"], -1, None, x["part"], x["path"], x["hashes"])

    last, count = None, 0
    for row in rows:
        if last is not None:
            yield from pair(last, row)
        elif not border:
            yield edge(row)
        last, count = row, count + 1
    if count > 1 and not border:
        yield edge(last)


def _emit(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.binary())
    hold = []
    names = [c.split()[0] for c in SHARED.split(", ")]
    for r in rows:
        hold.append(r)
        if len(hold) == 512:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hold), kinds)], names=names)
            hold = []
    if hold:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*hold), kinds)], names=names)


def shared_lines(parsed: DataFrame) -> DataFrame:
    """(host, digest, shared): places of the lines that a page shares with the
    nearest other page of its host."""
    pages = parsed.groupBy("host", "digest").agg(F.min("path").alias("path"), F.any_value("hashes").alias("hashes"))
    rows = pages.repartitionByRange("host", "path", "digest").sortWithinPartitions("host", "path", "digest").withColumn("part", F.spark_partition_id())

    def run(border: bool):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _emit(_compare((r for b in batches for r in b.to_pylist()), border))
        return step

    inner = save(map_arrow(rows, run(False), SHARED), "page-pairs")
    # the first and last page of each partition, in one task: two rows a partition
    edges = inner.where("part is not null").select("host", "path", "digest", "part", "hashes").repartition(1).sortWithinPartitions("host", "path", "digest", "part")
    both = inner.where("part is null").unionByName(map_arrow(edges, run(True), SHARED))
    best = both.groupBy("host", "digest").agg(F.max(F.struct("alike", F.sort_array("shared").alias("shared"))).alias("best"))
    return best.select("host", "digest", "best.shared")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared): the main text, the
    lines of the whole page and how many of them the difference took away."""
    parsed = save(_parsed(pages), "pages-parsed")
    done = parsed.where("n_open = 0").select("page_id", "url", "text", "n_lines", F.lit(0).cast("long").alias("n_shared"))
    open_pages = parsed.where("n_open > 0")
    sizes = open_pages.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("members"))
    frames = sizes.join(shared_lines(parsed), ["host", "digest"], "left")
    rows = join_groups(open_pages, frames, ["host", "digest"], "members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, gone = [], []
            for lines, marks, shared in zip(*(batch.column(c) for c in ("lines", "marks", "shared"))):
                frame, marks = set(shared.as_py() or ()), marks.as_py()
                stays = [m == KEPT or m == OPEN and i not in frame for i, m in enumerate(marks)]
                text.append("\n".join(x for x, stay in zip(lines.as_py(), stays) if stay))
                gone.append(sum(m == OPEN and i in frame for i, m in enumerate(marks)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), batch.column("n_lines"), pa.array(gone, pa.int64())],
                                             names=["page_id", "url", "text", "n_lines", "n_shared"])

    cut = map_arrow(rows.select("page_id", "url", "lines", "marks", "shared", "n_lines"), run, "page_id long, url string, text string, n_lines long, n_shared long")
    return done.unionByName(cut).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared")
