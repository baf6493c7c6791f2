"""Similarity join on word n-gram sets (Jaccard), exact.

1. One pass gives every document the size and a hash of its shingle set, and a
   sketch of shingle counts (fixed size).  Documents with equal sets form one
   class; only one text of a class goes on.
2. Shingles are ordered by (sketch count, hash).  Two sets over the threshold
   share a shingle among the first of each in that order (fewer for the smaller
   set), so each class is dealt to the tiles of these shingles only.  Very
   common shingles come last in the order and hardly ever make a tile.  A tile's
   rows are sorted by size; a row without a partner of fitting size goes.
3. Neighbours by size within a tile are compared first.  This links most of
   what belongs together, also large groups of near copies, with one pair per
   row.
4. Tiles that still hold several components are cut into size bands and, where
   large, into blocks.  Inside a tile, numpy compares hashed bitmap signatures
   of the pairs of different components; bit counts bound the overlap from
   above.  What passes is compared exactly by sorted-array intersection: first
   the likeliest pairs that would join the tile's components to a forest, then,
   while components stay apart, more forests, until no pair is left out.

``similar_pairs`` returns every link between different sets; ``components``
the components, for which links inside a component needn't be found.

Defined results: null, empty and blank texts have no shingles, size 0 and no
links; with fewer words than a shingle has, the whole sequence is the one
shingle; a null id links like any other, and the component id is the smallest
id that is not null; rows repeated under one id are rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import drop_saved, join_groups, key_bitmap, map_arrow, maybe_in, mix64, save, split_by, text_chunks, whole_rows
from wattline.llm.components import components as connected

#: Counters of the shingle sketch (one byte each when broadcast: 4 MB).
SKETCH_BITS, SLICE_BITS = 22, 12
BLOCK = 512              # rows of a block of a large tile
FIRST_TRIES = 4          # forests of pairs compared first in a tile
SEEN_CLASSES = 1 << 20   # classes that a task remembers

PROFILE = "doc_id long, t binary, n int, s1 long, s2 long, slice int, counts binary"


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; a link where 100 * both >= percent * either."""
    words: int = 5
    percent: int = 80
    seed: int = 1

    def sizes_fit(self, a, b):
        """Whether sets of these sizes can link at all."""
        return (100 * np.minimum(a, b) >= self.percent * np.maximum(a, b))

    def prefix(self, n: int) -> int:
        """Shingles of which a link shares one, against any other set."""
        return n - -(-n * self.percent // 100) + 1

    def short_prefix(self, n: int) -> int:
        """Shingles of which a link shares one, against a set not smaller."""
        return n - -(-2 * n * self.percent // (100 + self.percent)) + 1


# ---- shingle sets -------------------------------------------------------

def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte (A-Z as a-z), and what is white space."""
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    value = mix64(low + np.uint64(1000 + 256 * seed)) | np.uint64(1)
    return value, blank, mix64(np.arange(1, 4097, dtype=np.uint64) * np.uint64(7919 + seed)) | np.uint64(1)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts, many texts at a time."""

    def __init__(self, rule: Rule):
        self.w = rule.words
        self.value, self.blank, self.place = _tables(rule.seed)

    def word_hashes(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, first word of each text and the end)."""
        at = np.flatnonzero(~self.blank[data])
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
        edge = np.diff(at) > 1
        inner = off[1:-1]
        if len(inner):    # texts that touch without white space
            k = np.searchsorted(at, inner)
            k = k[(k > 0) & (k < len(at))]
            edge[k - 1] = True
        first = np.concatenate(([0], np.flatnonzero(edge) + 1))
        size = np.diff(np.concatenate((first, [len(at)])))
        pos = np.arange(len(at)) - np.repeat(first, size)
        longest = int(size.max())
        place = self.place
        if longest > len(place):
            place = mix64(np.arange(1, longest + 1, dtype=np.uint64) * np.uint64(7919)) | np.uint64(1)
            place[:len(self.place)] = self.place
        h = np.add.reduceat(self.value[data[at]] * place[pos], first)
        return mix64(h + size.astype(np.uint64)), np.searchsorted(at[first], off)

    def sets(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        word, start = self.word_hashes(data, off)
        w, n = self.w, len(word)
        salt = mix64(np.arange(1, w + 2, dtype=np.uint64)) | np.uint64(1)
        h = np.zeros(max(0, n - w + 1), np.uint64)
        for k in range(w):
            h += word[k:n - w + 1 + k] * salt[k] if n >= w else np.uint64(0)
        h = mix64(h)
        out = []
        for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
            if b - a >= w:
                s = np.sort(h[a:b - w + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                out.append(mix64((word[a:b] * salt[:b - a]).sum(keepdims=True) + salt[w:] * np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    pair = np.array([mix64(s ^ np.uint64(0xA5A5A5A5)).sum(), mix64(s ^ np.uint64(0x5A5A5A5A5A)).sum()], np.uint64)
    return tuple(mix64(pair).view(np.int64).tolist())


def signature(s: np.ndarray) -> bytes:
    """Hashed bitmap of a set, one bit per element at least: bit i is the
    parity of the elements hashed to it, so it does not fill up."""
    bits = max(64, 1 << int(len(s)).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


def _folded(sig: bytes, words: int) -> np.ndarray:
    """A signature at a smaller width (both powers of two), as 64-bit words."""
    x = np.frombuffer(sig, np.uint64)
    while len(x) > words:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x


# ---- pass 1: classes and the sketch ------------------------------------

def content_key(text: Column) -> Column:
    """Tells rows with one id and different texts apart."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _profiles(docs: DataFrame, rule: Rule) -> DataFrame:
    """Rows of documents (slice null) and of the tasks' sketches (doc null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(rule)
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        names = [x.split()[0] for x in PROFILE.split(", ")]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for rows, data, off in text_chunks(batches):
            sets = shingler.sets(data, off)
            hashes = [_set_hash(s) for s in sets]
            if sum(map(len, sets)):
                np.add.at(sketch, (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            k = len(sets)
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), rows.column("t"), pa.array([len(s) for s in sets], pa.int32()), pa.array([h[0] for h in hashes], pa.int64()),
                pa.array([h[1] for h in hashes], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if sketch.any():
            part = np.minimum(sketch, 255).astype(np.uint8).reshape(-1, 1 << SLICE_BITS)
            for a in range(0, len(part), 256):
                own = part[a:a + 256]
                k = len(own)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(k, t) for t in kinds[:5]), pa.array(range(a, a + k), pa.int32()),
                                                  pa.array([x.tobytes() for x in own], pa.binary())], names=names)

    return map_arrow(docs.select("doc_id", content_key(F.col("text")).alias("t"), "text"), run, PROFILE)


def _sketch(profiles: DataFrame) -> np.ndarray:
    """Levels (logarithms) of the summed counts: 4 MB whatever the input."""
    slices = profiles.where("slice is not null").select("slice", "counts")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                row = np.frombuffer(c.as_buffer(), np.uint8)
                total[k] = total[k] + row if k in total else row.astype(np.int64)
        for k, c in total.items():
            level = np.minimum(np.round(8 * np.log2(1 + c)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["slice", "counts"])

    levels = np.zeros((1 << (SKETCH_BITS - SLICE_BITS), 1 << SLICE_BITS), np.uint8)
    for r in map_arrow(slices.repartition("slice"), add, "slice int, counts binary").collect():
        levels[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
    return levels.ravel()


# ---- pass 2: tiles ------------------------------------------------------

def _prefixes(reps: DataFrame, rule: Rule, levels: np.ndarray) -> DataFrame:
    """(h, v, n, short): the classes of each prefix shingle; ``short`` tells
    whether it is among the first that suffice for the smaller set."""
    shared = reps.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, level = Shingler(rule), shared.value
        seen: set[int] = set()
        for _, data, off in text_chunks(batches):
            hs, vs, ns, short = [], [], [], []
            for s in shingler.sets(data, off):
                if not len(s):
                    continue
                v = _set_hash(s)[0]
                if v in seen:     # a copy
                    continue
                if len(seen) >= SEEN_CLASSES:
                    seen.clear()
                seen.add(v)
                k = rule.prefix(len(s))
                lv = level[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                top = np.argsort(lv, kind="stable")[:k]      # s is sorted, so ties go by hash
                hs.append(s[top])
                vs.append(v)
                ns.append((k, len(s)))
                short.append(np.arange(k) < rule.short_prefix(len(s)))
            if hs:
                k = [x[0] for x in ns]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.repeat(np.array(vs, np.int64), k)),
                    pa.array(np.repeat(np.array([x[1] for x in ns], np.int32), k)), pa.array(np.concatenate(short))], names=["h", "v", "n", "short"])

    return map_arrow(reps.select(F.col("text").cast("string").alias("text")), run, "h long, v long, n int, short boolean")


def _shared_tiles(prefixes: DataFrame, rule: Rule) -> DataFrame:
    """Rows of tiles that have a partner of fitting size: (h, v, n, short,
    prev); prev is the nearest smaller class that fits, or null.  Sorted by
    size, the nearest partner tells whether there is any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold = None     # the nearest short row before the last row, if any, and the last row

        def settle(h, v, n, x, first: int, last: int) -> tuple[pa.RecordBatch, np.ndarray]:
            at = np.arange(len(h))
            near = np.concatenate(([-1], np.maximum.accumulate(np.where(x, at, -1))[:-1]))
            near = np.where((near >= 0) & (h[near] == h), near, -1)
            down = (near >= 0) & rule.sizes_fit(n[near], n)
            up = np.zeros(len(h), bool)
            up[:-1] = x[:-1] & (h[1:] == h[:-1]) & rule.sizes_fit(n[:-1], n[1:])
            i = first + np.flatnonzero((down | up)[first:last])
            return pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(v[i]), pa.array(n[i]), pa.array(x[i]), pa.array(v[near[i]], mask=~down[i])],
                                              names=["h", "v", "n", "short", "prev"]), near

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "v", "n", "short")]
            done = 0
            if hold is not None:
                done = len(hold[0]) - 1
                cols = [np.concatenate((a, b)) for a, b in zip(hold, cols)]
            h, v = cols[0], cols[1]
            keep = np.concatenate(([True], (h[1:] != h[:-1]) | (v[1:] != v[:-1])))    # copies of a class
            cols = [c[keep] for c in cols]
            out, near = settle(*cols, done, len(cols[0]) - 1)
            yield out
            last = [len(cols[0]) - 1] if near[-1] < 0 else [near[-1], len(cols[0]) - 1]
            hold = [c[last] for c in cols]
        if hold is not None:
            yield settle(*hold, len(hold[0]) - 1, len(hold[0]))[0]

    rows = prefixes.repartition("h").sortWithinPartitions("h", "n", F.desc("short"), "v")
    return map_arrow(rows, run, "h long, v long, n int, short boolean, prev long")


# ---- comparison ---------------------------------------------------------

def _exact(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, link) for pairs (a, b) of classes.  What is moved and compared is
    one sorted array of hashes per class, one pair at a time."""
    pairs = pairs.select("a", "b")
    wanted = key_bitmap(pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct(), "v")
    sets = maybe_in(sets.select("v", "hashes"), "v", wanted)     # the others stay where they are
    left = sets.select(F.col("v").alias("a"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("v").alias("b"), F.col("hashes").alias("hb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            link = []
            for x, y in zip(batch.column("ha"), batch.column("hb")):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                link.append(100 * both >= rule.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(link, pa.bool_())], names=["a", "b", "link"])

    return map_arrow(pairs.join(left, "a").join(right, "b"), run, "a long, b long, link boolean")


def _bounded(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs whose signatures allow enough overlap."""
    sigs = sets.select("v", "n", "sig")
    x = sigs.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    y = sigs.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb"))):
                words = min(len(sa), len(sb)) // 8
                apart = int(np.bitwise_count(_folded(sa, words) ^ _folded(sb, words)).sum())
                most = (na + nb - apart) // 2
                keep.append(100 * most >= rule.percent * (na + nb - most))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(pairs.select("a", "b").join(x, "a").join(y, "b"), run, "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Complete groups from batches sorted by the keys."""
    hold: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy() for c in keys])
        cut = (np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist()
        if hold and any(hold[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in keys):
            yield pa.Table.from_batches(hold)
            hold = []
        for a, b in zip([0, *cut], cut):
            yield pa.Table.from_batches([*hold, batch.slice(a, b - a)])
            hold = []
        hold.append(batch.slice(cut[-1] if cut else 0))
    if hold:
        yield pa.Table.from_batches(hold)


def _forests(pairs: list[tuple[float, int, int, int, int]], tries: int) -> tuple[list[tuple[int, int]], bool]:
    """From (unlikeliness, component, component, a, b): the pairs of up to
    ``tries`` forests over the components, likeliest first, and whether pairs
    were left out."""
    out, rest = [], sorted(pairs)
    for _ in range(tries):
        parent: dict[int, int] = {}

        def root(x: int, parent=parent) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        later = []
        for pair in rest:
            x, y = root(pair[1]), root(pair[2])
            if x == y:
                later.append(pair)
            else:
                parent[x] = y
                out.append(pair[3:])
        rest = later
        if not rest:
            break
    return out, bool(rest)


def _tile_pairs(rows: DataFrame, rule: Rule, tries: int | None) -> DataFrame:
    """Pairs of one tile block whose signatures allow a link, of different
    components: those of the first ``tries`` forests, or all; ``more`` tells
    whether that left some out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["tile", "kind", "bi", "bj"]):
            v, c, n, left, short, blk = (g.column(x).to_numpy() for x in ("v", "root", "n", "own", "short", "blk"))
            main = g.column("main").to_numpy(zero_copy_only=False)
            sigs = g.column("sig").to_pylist()
            words = min(map(len, sigs)) // 8
            sig = np.stack([_folded(s, words) for s in sigs])
            cross, apart_blocks = g.column("kind")[0].as_py() == 0, g.column("bi")[0].as_py() != g.column("bj")[0].as_py()
            found, more = [], False
            for i in range(len(v)):
                # each pair once, and only where one row belongs to the band itself
                j = np.arange(len(v)) > i
                j &= (c != c[i]) & (left | left[i]) & rule.sizes_fit(n, n[i])
                # the tile's shingle must be among the first of the smaller set
                j &= np.where(n == n[i], short | short[i], np.where(n < n[i], short, short[i]))
                if cross:             # main component against the others
                    j &= main != main[i]
                elif apart_blocks:    # pairs inside one block belong to that block's own group
                    j &= blk != blk[i]
                j = np.flatnonzero(j)
                if not len(j):
                    continue
                apart = np.bitwise_count(sig[j] ^ sig[i]).sum(axis=1).astype(np.int64)
                most = (n[j].astype(np.int64) + n[i] - apart) // 2
                either = n[j].astype(np.int64) + n[i] - most
                ok = 100 * most >= rule.percent * either
                j, unlike = j[ok], -(most[ok] / either[ok])
                if tries is not None and len(j) > tries:    # of the pairs with one component, the likeliest
                    order = np.lexsort((unlike, c[j]))
                    j, unlike = j[order], unlike[order]
                    first = np.concatenate(([True], c[j][1:] != c[j][:-1]))
                    place = np.arange(len(j)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                    more |= bool((place >= tries).any())
                    j, unlike = j[place < tries], unlike[place < tries]
                found += [(u, int(c[i]), int(c[k]), int(min(v[i], v[k])), int(max(v[i], v[k]))) for k, u in zip(j.tolist(), unlike.tolist())]
            pairs, rest = ([x[3:] for x in found], False) if tries is None else _forests(found, tries)
            if pairs:
                more |= rest
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64()),
                                                  pa.array([more] * len(pairs), pa.bool_())], names=["a", "b", "more"])

    part = rows.repartition("tile", "kind", "bi", "bj").sortWithinPartitions("tile", "kind", "bi", "bj")
    return map_arrow(part, run, "a long, b long, more boolean")


def _blocks(tiles: DataFrame, roots: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Rows of tile blocks: (tile, kind, bi, bj, blk, main, own, short, v, n, root, sig).

    A row stands in its size band and, as a visitor, in the next.  In each
    band the main component is the largest; its rows are never compared with
    each other.  Kind 0 holds a block of the main component and one of the
    others, kind 1 two blocks of the others."""
    step = float(np.log(100 / rule.percent))
    rows = tiles.select("h", "v", "n", "short").join(roots.select("v", "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(step + 1e-9)).cast("int")
    rows = rows.select("h", "v", "n", "short", "root", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")),
                                                                F.struct((band + 1).alias("band"), F.lit(False).alias("own")))).alias("x"))
    rows = rows.select("h", "x.band", "x.own", "short", "v", "n", "root")
    per = rows.groupBy("h", "band", "root").agg(F.count(F.lit(1)).alias("k"), F.max("own").alias("any_own"),
                                                 F.sum(F.xxhash64("v", "own", "short").cast("decimal(38,0)")).alias("sum"),
                                                 F.expr("bit_xor(xxhash64(own, short, v))").alias("xor"))
    per = per.groupBy("h", "band").agg(F.max(F.struct("k", "root")).alias("top"), F.sum("k").alias("m"), F.max("any_own").alias("any_own"),
                                       F.sum("sum").alias("sum"), F.expr("bit_xor(xor)").alias("xor"))
    per = per.where("any_own and top.k < m")     # several components, one of them in this band
    # tiles with the same members do the same work: one of them is kept
    per = per.groupBy("band", "m", "sum", "xor").agg(F.min(F.struct("h", "top")).alias("t"))
    per = per.select(F.col("t.h").alias("h"), "band", F.col("t.top.root").alias("main_root"), F.col("t.top.k").alias("d"), (F.col("m") - F.col("t.top.k")).alias("r"))
    rows = rows.join(per, ["h", "band"])
    nd, nr = F.ceil(F.col("d") / BLOCK).cast("int"), F.ceil(F.col("r") / BLOCK).cast("int")
    rows = rows.withColumn("main", F.col("root") == F.col("main_root")).withColumn("nd", nd).withColumn("nr", nr)
    rows = rows.withColumn("blk", F.pmod(F.xxhash64("v"), F.when(F.col("main"), F.col("nd")).otherwise(F.col("nr"))).cast("int"))
    key = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("bi"), j.alias("bj"))
    up = lambda n: F.sequence(F.lit(0), n - 1)
    main = F.transform(up(F.col("nr")), lambda j: key(0, F.col("blk"), j))
    other = F.concat(F.transform(up(F.col("nd")), lambda i: key(0, i, F.col("blk"))),
                     F.transform(up(F.col("nr")), lambda j: key(1, F.least(j, F.col("blk")), F.greatest(j, F.col("blk")))))
    rows = rows.withColumn("key", F.explode(F.when(F.col("main"), main).otherwise(other)))
    rows = rows.select(F.xxhash64("h", "band").alias("tile"), "key.kind", "key.bi", "key.bj", "blk", "main", "own", "short", "v", "n", "root")
    return rows.join(sets.select("v", "sig"), "v")


# ---- the join -----------------------------------------------------------

@dataclass
class _Found:
    profiles: DataFrame      # (doc_id, t, n, v) of every document
    classes: DataFrame       # (v, n, rep, members)
    links: DataFrame         # (a, b) between classes


def _find(docs: DataFrame, rule: Rule, all_links: bool) -> _Found:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    while True:
        both = save(_profiles(docs, rule), "profiles")
        profiles = both.where("slice is null").select("doc_id", "t", "n", F.col("s1").alias("v"), "s2")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t"))
        classes = save(profiles.where("n > 0").groupBy("v").agg(F.max("n").alias("n"), least.alias("first"), F.count(F.lit(1)).alias("members"),
                                                               (F.min("s2") != F.max("s2")).alias("clash")).withColumn("rep", F.col("first.doc_id")), "classes", both.count())
        if classes.where("clash").isEmpty():
            break
        rule = Rule(rule.words, rule.percent, rule.seed + 1)    # two sets share 64 of 128 bits: other hashes
    levels = _sketch(both)
    reps = maybe_in(docs, "doc_id", key_bitmap(classes.select(F.col("rep").alias("doc_id")), "doc_id"))
    tiles = save(_shared_tiles(_prefixes(reps, rule, levels), rule), "tiles")
    own = save(tiles.select("v").distinct().join(classes.select("v", "rep"), "v"), "tile-classes", classes.count())
    read = maybe_in(docs, "doc_id", key_bitmap(own.select(F.col("rep").alias("doc_id")), "doc_id"))
    sets = save(_sets(read, rule).dropDuplicates(["v"]), "sets")      # one row a class
    first = tiles.where(F.col("prev").isNotNull()).select(F.least("v", "prev").alias("a"), F.greatest("v", "prev").alias("b")).distinct()
    tried = save(_exact(_bounded(first, sets, rule), sets, rule), "tried")
    tries = None if all_links else FIRST_TRIES
    while True:
        links = tried.where("link").select("a", "b")
        roots = tiles.select("v", F.col("v").alias("root")).limit(0) if all_links else connected(links)    # without links, a class is its own root
        pairs = save(_tile_pairs(_blocks(tiles, roots, sets, rule), rule, tries), "tile-pairs")
        new = save(pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "new-pairs", pairs.count())
        found = save(_exact(new, sets, rule), "tried")
        tried = tried.unionByName(found)
        if all_links:
            break
        more = not pairs.where("more").isEmpty()
        drop_saved(roots)
        if not more:
            break             # every pair of different components that may link was compared
        tries *= 16           # where the likelier pairs failed, more of them are looked at
    return _Found(profiles.drop("s2"), classes.drop("clash"), tried.where("link").select("a", "b"))


def _sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(v, n, sig, hashes) of at least one document of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen = Shingler(rule), set()
        for _, data, off in text_chunks(batches):
            rows = []
            for s in shingler.sets(data, off):
                v = _set_hash(s)[0] if len(s) else None
                if v is None or v in seen:
                    continue
                if len(seen) >= SEEN_CLASSES:
                    seen.clear()
                seen.add(v)
                rows.append((v, len(s), signature(s), s.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                                                 names=["v", "n", "sig", "hashes"])

    return map_arrow(docs, run, "v long, n int, sig binary, hashes binary")


def similar_pairs(docs: DataFrame, rule: Rule | None = None) -> tuple[DataFrame, DataFrame]:
    """All links between different sets, as pairs (a, b) of the smallest ids of
    their classes, and the membership (doc_id, class_id, n_shingles)."""
    found = _find(docs, rule or Rule(), True)
    rep = found.classes.select("v", "rep")
    pairs = (found.links.join(rep.select(F.col("v").alias("a"), F.col("rep").alias("ra")), "a")
             .join(rep.select(F.col("v").alias("b"), F.col("rep").alias("rb")), "b")
             .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")))
    members = join_groups(found.profiles, found.classes.select("v", "rep", "members"), ["v"], "members")
    return pairs, members.select("doc_id", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("class_id"),
                                 F.col("n").cast("long").alias("n_shingles"))


def _labelled(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per document: (doc_id, t, n, first); first is the (doc_id, t) that stays
    of its component, null without shingles."""
    found = _find(docs, rule, False)
    roots = connected(found.links)
    classes = found.classes.join(roots.select("v", "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = classes.groupBy("root").agg(F.min("first").alias("least"))
    by_class = save(join_groups(classes.select("v", "members", "root"), least.withColumn("size", F.lit(1)), ["root"], "size"), "class-components", found.classes.count())
    return join_groups(found.profiles, by_class.select("v", "members", F.col("least").alias("first")), ["v"], "members").select("doc_id", "t", "n", "first")


def components(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id)."""
    out = _labelled(docs, rule or Rule())
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row of each component, with all its columns: the smallest id, of
    equal ids the smallest content key, of rows with both the first by the
    other columns; a null id comes last.  Rows without shingles all stay.  Only
    rows that may go are shuffled."""
    rows = save(_labelled(docs.select("doc_id", "text"), rule or Rule()).where("n > 0").select(
        F.col("doc_id").alias("_gone"), "t", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))).alias("stays")), "near-copies")
    gone = rows.where("not stays").select("_gone", "t").distinct()
    repeated = rows.where("stays").groupBy("_gone", "t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_gone", "t")
    bitmap = lambda ids: key_bitmap(ids.select(F.col("_gone").alias("doc_id")), "doc_id")
    own = whole_rows(docs, (F.col("doc_id").cast("long"), "doc_id"), (F.col("text"), "_own"))
    may, clear = split_by(own, "doc_id", bitmap(gone.union(repeated)))
    may = may.withColumn("_own_t", content_key(F.col("_own")))
    may = may.join(gone, may["doc_id"].eqNullSafe(gone["_gone"]) & (may["_own_t"] == gone["t"]), "left_anti")
    many, single = split_by(may, "doc_id", bitmap(repeated))
    nth = F.row_number().over(Window.partitionBy("doc_id", "_own_t", F.col("_whole")).orderBy("_row"))
    # rows of an id that shares its slot, and those without shingles, are no copies of each other
    many = many.join(repeated.withColumn("_whole", F.lit(True)), many["doc_id"].eqNullSafe(repeated["_gone"]) & (many["_own_t"] == repeated["t"]), "left")
    many = many.withColumn("_nth", nth).where("_nth = 1 or _whole is null")
    return many.select("_row").unionByName(single.select("_row")).unionByName(clear.select("_row")).select("_row.*")
