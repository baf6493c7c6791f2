"""Lexical search, the manifest and page extraction."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import extract as X
from wattline.llm import lexical as L
from wattline.llm import merkle as M
from wattline.llm.common import table
from wattline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- lexical search -----------------------------------------------------

def ranked(docs, items, top=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counts = [(i, Counter(word.findall((t or "").translate(UP)))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(k for _, c in counts for k in c)
    out = []
    for item, text in sorted(set(items), key=str):
        found = []
        for i, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms if n_terms else 75
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in word.findall((text or "").translate(UP)) if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def test_search_query_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_lexical_search"](spark, SF).collect()), key=str) == ranked(docs, items)


@pytest.mark.parametrize("small", [False, True])
def test_search_edges(spark, nasty, nobody, monkeypatch, small):
    """Ties, repeated rows and items, nulls, separators, blocks of every size."""
    if small:
        for name, value in (("SCAN_BYTES", 40), ("DOCS", 2), ("HOLD", 3), ("ITEMS", 2), ("PARTS", 2)):
            monkeypatch.setattr(L, name, value)
    items = [(1, "Quick FOX quick"), (1, "Quick FOX quick"), (1, "lazy"), (2, None), (None, "aa bb"), (3, "ünï 中文 \U0001f600 w5x5"), (4, "--- !!"), (5, "absent")]
    df = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x"))
    docs = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    assert sorted((tuple(r) for r in L.search(nasty, df).collect()), key=str) == ranked(docs, items)
    assert L.search(nobody, df).count() == 0 and L.search(nasty, df.where("item_id = 99")).count() == 0
    same = spark.createDataFrame([(i, "equal text here") for i in range(60)] + [(None, "equal text here")], "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in L.search(same, spark.createDataFrame([(7, "text")], "item_id long, text string")).collect()]
    assert sorted((r, d) for _, r, d, _ in got) == [(k + 1, k) for k in range(20)]


# ---- manifest -----------------------------------------------------------

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def manifest(rows):
    """Rows of the query, from (doc_id, source, lang, n_chars, text)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sources = {}
    for i, source, lang, n, text in rows:
        hit = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        other = text.translate(UP) if hit and text is not None else text
        leaf, changed = (sha("".join(map(enc, (i, source, lang, n, t)))) for t in (text, other))
        sources.setdefault((source is not None, (source or "").encode()), []).append(((i is not None, i or 0, leaf), i, leaf, changed))

    def path(nodes, i):
        out = []
        while len(nodes) > 1:
            run = nodes[i // 16 * 16:i // 16 * 16 + 16]
            out.append(("".join(run[:i % 16]), "".join(run[i % 16 + 1:])))
            nodes, i = [sha("".join(nodes[j:j + 16])) for j in range(0, len(nodes), 16)], i // 16
        return nodes[0], out

    trees = [sorted(sources[k], key=lambda x: x[0]) for k in sorted(sources)]
    subroots = [path([x[2] for x in t], 0)[0] for t in trees]
    out = []
    for k, t in enumerate(trees):
        root, above = path(subroots, k)
        for j, (_, i, leaf, changed) in enumerate(t):
            way = path([x[2] for x in t], j)[1] + above
            up = changed
            for a, b in way:
                up = sha(a + up + b)
            out.append((i, leaf, subroots[k], root, sha("".join(a + b for a, b in way)), up, up == root))
    return sorted(out, key=str)


def as_rows(df):
    return [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_manifest_query_against_brute_force(spark):
    got = sorted((tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, SF).collect()), key=str)
    want = manifest(as_rows(table(spark, SF, "documents")))
    assert got == want and 0 < sum(not r[-1] for r in got) < len(got)


def test_manifest_edges(spark, nasty, nobody):
    assert sorted((tuple(r) for r in M.check_lowered(nasty).collect()), key=str) == manifest(as_rows(nasty))
    assert M.check_lowered(nobody).count() == 0 and M.build(nobody).root is None


@pytest.mark.parametrize("span_levels", [2, 3, 4])
def test_manifest_layers_and_many_sources(spark, monkeypatch, span_levels):
    """Blocks of fewer levels, so that small tables have many layers, in the
    sources' trees and in the one above."""
    monkeypatch.setattr(M, "LEVELS", span_levels)
    monkeypatch.setattr(M, "SPAN", M.FAN ** (span_levels - 1))
    sizes = [700, 257, 256, 17, 16, 2] + [1] * 40
    rows = [(i * 31 % 5003, f"s{k:02d}" if k else None, None, k, f"Text {i} of {k}") for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert sorted((tuple(r) for r in M.check_lowered(docs).collect()), key=str) == manifest(rows)


def test_layout_is_a_permutation_by_halves():
    for levels in range(1, 6):
        at = np.concatenate([M.places(levels, d, np.arange(M.FAN ** d)) for d in range(levels)])
        assert sorted(at.tolist()) == list(range(M.n_nodes(levels)))
    # the upper half lies before, and each subtree below in one piece
    assert M.places(4, 0, np.array([0]))[0] == 0 and M.places(4, 1, np.arange(16)).tolist() == list(range(1, 17))
    low = M.places(4, 3, np.arange(32))
    assert M.places(4, 2, np.array([0, 1])).tolist() == [17, 34] and low.tolist() == [*range(18, 34), *range(35, 51)]


# ---- pages --------------------------------------------------------------

def article(html):
    """The text of the given pages' article element, by plain expressions."""
    import html as h
    body = re.search("(?s)<article>(.*)</article>", html or "")
    if not body:
        return ""
    lines = [" ".join(h.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body[1])]
    return "\n".join(x for x in lines if x)


def test_pages_query_against_plain_expressions(spark):
    d = "/root/testdata/sf0.01"
    html = {r["page_id"]: r["html"] for r in table(spark, d, "pages").collect()}
    got = {r["page_id"]: r for r in QUERIES["op13_html_extraction"](spark, d).collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: article(x) for i, x in html.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def kept(html):
    return [line for line, mark in X.page_lines(html) if mark == X.KEPT]


def test_markup_rules():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body class="has-sidebar">
      <header><a href=/>Site</a></header><nav><ul><li>Home<li>About</ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">We use cookies</div>
      <form><label>Mail</label><input value=x><button>Go</button></form>
      <article class=post><header><h1>Head&nbsp;line</h1></header><p>One <b>bold</b>\n &lt;tag&gt; &#233;&eacute;<br>two<p title="a > b">Three<ul><li>item<li>item two</ul>
      <aside>Related</aside><div class="share-buttons">Share</div><noscript>enable</noscript><p hidden>secret</p><pre>x  y</pre>tail</article>
      <section id="comments"><article><p>First!</p></article></section><div role="complementary">Side</div><footer>&copy; Site</footer>"""
    assert kept(page) == ["Head line", "One bold <tag> éé two", "Three", "item", "item two", "x y", "tail"]
    assert [m for _, m in X.page_lines(page)].count(X.OPEN) == 0
    # what a menu or form leaves open, the article ends; what markup says nothing of is open
    assert kept("<nav><ul><li>a<article><p>body</p></article>") == ["body"]
    assert kept("<form id=f><main><p>body</p></main></form>") == ["body"]
    assert X.page_lines("<div>one</div>two<p>three") == [("one", X.OPEN), ("two", X.OPEN), ("three", X.OPEN)]
    for html in (None, "", "<", "<p", "a < b", "<!--", "<script>", "</p>", "<p title='", "&", "<p/>x", "<article>", "</nav></article>" * 3, "\x00<b\x00>"):
        assert isinstance(X.page_lines(html), list)
    assert X.page_lines("a < b &amp c &am d")[0][0] == "a < b & c &am d"
    assert kept("<article>" + "<b>" * 3000 + "deep" + "</b>" * 3000 + "</article>") == ["deep"]
    long = "<article>" + "<p>word word</p>" * 100_000 + "</article>"
    assert len(kept(long)) == 100_000


def length_of_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@pytest.mark.parametrize("bits", [1 << 26, 8])
def test_alignment_against_dynamic_programming(monkeypatch, bits):
    monkeypatch.setattr(X, "TABLE_BITS", bits)
    r = random.Random(bits)
    for _ in range(800):
        k = r.randint(1, 6)
        a, b = ([r.randint(0, k) for _ in range(r.randint(0, 14))] for _ in range(2))
        place = X.lcs(a, b)
        rest = iter(b)
        assert place == sorted(set(place)) and all(x in rest for x in (a[i] for i in place)) and len(place) == length_of_common(a, b)


def test_shared_lines_of_the_nearest_page_go(spark):
    """Pages without any telling markup: the frame of a host goes, and what a
    page has alone stays; a copy is no neighbour; hosts don't mix."""
    frame = "<div>Menu of {h}</div><div>Top</div>{body}<div>Bottom of {h}</div>"
    rows, own = [], {}
    for h in ("a.example", "b.example"):
        for k in range(40):
            body = "".join(f"<p>{h} page {k} line {j}</p>" for j in range(3))
            rows.append((len(rows), f"http://{h}/x/{k:02d}.html?q={k}", frame.format(h=h, body=body)))
            own[len(rows) - 1] = "\n".join(f"{h} page {k} line {j}" for j in range(3))
    rows += [(500 + k, f"https://a.example/x/07-copy{k}", rows[7][2]) for k in range(30)]       # copies under other paths
    own |= {500 + k: own[7] for k in range(30)}
    rows += [(900, "http://alone.example/", "<p>Only one page here</p>"), (901, None, "<p>no url</p>"), (902, "::odd", None), (903, "http://c.example/a", "<p>same</p>"), (903, "http://c.example/a", "<p>same</p>")]
    own |= {900: "Only one page here", 901: "no url", 902: "", 903: "same"}
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2)).repartition(parts)
        got = X.main_text(df).collect()
        assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got} == own
        assert all(r["n_shared"] == 3 for r in got if r["page_id"] < 600)
    assert X.main_text(df.where("page_id = -1")).count() == 0


def test_hosts_and_paths(spark):
    rows = [("HTTP://User@WWW.Example.com:80/a/b?q#f", "www.example.com", "/a/b"), ("//x/y", "x", "/y"), ("/only/path", "", "/only/path"), (None, "", ""), ("http://h", "h", "")]
    got = spark.createDataFrame(rows, "u string, h string, p string").select(X.host_of(F.col("u")).alias("host"), X.path_of(F.col("u")).alias("path"), "h", "p").collect()
    assert all((r["host"], r["path"]) == (r["h"], r["p"]) for r in got)
