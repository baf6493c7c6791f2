import random
import re

import numpy as np

from wattline.llm import ngram_join as J
from wattline.llm.queries import QUERIES

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t, w):
    x = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(UP))
    return frozenset(tuple(x[k:k + w]) for k in range(len(x) - w + 1)) if len(x) >= w else frozenset([tuple(x)] if x else [])


def brute(rows, rule):
    """{row number: component}, and the links between smallest ids of classes."""
    sets = [shingles(t, rule.words) for _, t in rows]
    par = list(range(len(rows)))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    links = set()
    first = {}
    for i, s in enumerate(sets):
        if s:
            par[root(i)] = root(first.setdefault(s, i))
    reps = list(first.values())
    for a, i in enumerate(reps):
        for j in reps[:a]:
            both = len(sets[i] & sets[j])
            if 100 * both >= rule.percent * (len(sets[i]) + len(sets[j]) - both):
                par[root(i)] = root(j)
                links.add(frozenset((sets[i], sets[j])))
    return sets, [root(i) for i in range(len(rows))], links


def check(spark, rows, rule):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, comp, links = brute(rows, rule)
    low = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            low[c] = min(low.get(c, i), i)
    want = sorted(((i, len(s), low.get(c) if s else i) for (i, _), s, c in zip(rows, sets, comp)), key=str)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.components(df, rule).collect()), key=str)
    assert got == want
    pairs, members = J.similar_pairs(df, rule)
    of = {i: s for (i, _), s in zip(rows, sets)}
    assert {frozenset((of[r["a"]], of[r["b"]])) for r in pairs.collect()} == links
    assert members.count() == len(rows)


def edited(r, words, share):
    out = list(words)
    for k in range(len(out)):
        if r.random() < share:
            out[k] = f"e{r.randint(0, 10 ** 6)}"
    return out


def test_random_near_copies(spark):
    r = random.Random(11)
    rows, i = [], 0
    passage = [f"p{k}" for k in range(40)]
    for g in range(12):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice((3, 8, 30, 120)))]
        for _ in range(r.randint(1, 9)):
            own = edited(r, base, r.choice((0, 0.01, 0.02, 0.04)))
            if g % 3 == 0:
                own = own + passage
            rows.append((i, " ".join(own).title() if r.random() < 0.2 else " ".join(own)))
            i += 1
    r.shuffle(rows)
    check(spark, rows, J.Rule(words=3, percent=80))
    check(spark, rows, J.Rule(words=4, percent=85))


def test_hot_tile_in_blocks(spark, monkeypatch):
    """One passage that many texts consist of, in blocks and with retries."""
    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "FIRST_TRIES", 1)
    r = random.Random(5)
    base = [f"p{k}" for k in range(20)]
    rows = [(i, " ".join(base + [f"u{i}a{k}" for k in range(r.choice((0, 1, 2, 3, 4, 6)))])) for i in range(60)]
    check(spark, rows, J.Rule(words=2, percent=80))


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    sets, comp, _ = brute(rows, J.Rule(words=4, percent=85))
    low = {}
    for (i, _), c in zip(rows, comp):
        low[c] = min(low.get(c, i), i)
    want = {i: (len(s), low[c] if s else i) for (i, _), s, c in zip(rows, sets, comp)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op4_ngram_join"](spark, d).collect()}
    assert got == want


def test_edges(spark, nasty, nobody):
    rows = [(r["doc_id"], r["text"]) for r in nasty.collect()]
    got = {}
    for r in J.components(nasty, J.Rule(words=4, percent=85)).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert got[1] == [(6, 1)] and got[6] == [(6, 1)] and (6, 1) in got[None]
    assert got[2] == [(0, 2)] and got[3] == [(0, 3)] and got[4] == [(0, 4)] and got[10] == [(1, 7)]
    assert sum(map(len, got.values())) == len(rows)
    assert J.components(nobody).count() == 0
    kept = J.keep_first(nasty)
    assert kept.columns == nasty.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 7, 8, 9, None}


def test_keep_first_repeated_ids(spark):
    """One id on different texts: no clean text is lost, no near copy stays."""
    base = " ".join(f"w{k}" for k in range(40))
    near, other, third = base + " end", " ".join(f"o{k}" for k in range(40)), " ".join(f"t{k}" for k in range(40))
    cases = [([(1, base), (2, near), (2, other)], [(1, base), (2, other)]),
             ([(2, base), (2, near)], None),
             ([(None, base), (3, near), (None, other), (None, other)], [(3, near), (None, other)]),
             ([(4, base), (4, base), (4, base), (5, near), (5, third), (4, "")], [(4, base), (5, third), (4, "")])]
    for rows, want in cases:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = [tuple(r) for r in J.keep_first(df).collect()]
        if want is None:
            assert len(got) == 1 and got[0] in rows
        else:
            assert sorted(got, key=str) == sorted(want, key=str)


def test_signature_bounds_overlap():
    r = np.random.default_rng(2)
    for _ in range(300):
        x = np.unique(r.integers(0, 2 ** 63, r.integers(1, 300), dtype=np.uint64))
        y = np.unique(np.concatenate((x[r.random(len(x)) < r.random()], r.integers(0, 2 ** 63, r.integers(1, 60), dtype=np.uint64))))
        a, b = J.signature(x), J.signature(y)
        w = min(len(a), len(b)) // 8
        apart = int(np.bitwise_count(J._folded(a, w) ^ J._folded(b, w)).sum())
        assert len(np.intersect1d(x, y)) <= (len(x) + len(y) - apart) // 2


def test_shingles_by_bytes():
    s = J.Shingler(J.Rule(words=3))
    texts = ["a b c d", "A  B\tc\nd", "", " ", "a b", "x", "a b c", "é ü ö", "a" * 9000 + " b c d", "ab c d", "a bc d"]
    raw = [t.encode() for t in texts]
    off = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    sets = s.sets(np.frombuffer(b"".join(raw), np.uint8), off)
    assert [len(x) for x in sets] == [len(shingles(t, 3)) for t in texts]
    assert sets[0].tolist() == sets[1].tolist() and sets[6].tolist()[0] in sets[0].tolist()
    assert len({tuple(x.tolist()) for x in sets}) == len({shingles(t, 3) for t in texts})
