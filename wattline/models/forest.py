"""Random forests from binned histograms.

Inputs are binned once to one byte each.  All trees grow together, a level at
a time: one aggregation by (tree, node, feature, bin) gives the sums from which
every node of the level takes its split, so a level is one job whatever the
number of trees.  (A table of at most 3.1 million rows goes to every task
instead, and a task grows whole trees from it.)  A node that holds at most ``LOCAL_ROWS`` rows is finished by
one task: its rows go there, packed by task, and the subtree below it grows
from sorted bins.  Bootstrap weights (Poisson) and feature draws are hashes of
(row, tree) and (tree, node), so a tree is the same on any partitioning.

Several forests that leave out different folds grow in the same jobs
(``exclude``): a cross-validation is one binned table and one set of trees.

A tree is four arrays by node: feature (-1: leaf), bin, left child (the right
one is next to it), value.  Scoring compares bins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

BINS = 256
#: Rows of a node that one task finishes alone.
LOCAL_ROWS = 1 << 19
#: Subtrees of at most so many rows find their splits by sorting rows.
SORTED_ROWS = 1 << 16
#: Rows that a task looks at together, and rows of all trees' samples that one
#: job deals to the tasks that finish subtrees (some 34 bytes each on disk).
CHUNK_ROWS, DEALT_ROWS = 1 << 16, 250_000_000
#: A table of at most so many times ``local_rows``, of which one job could deal
#: the samples of so many trees, goes to every task (20 bytes a row and one an
#: input, 3.1 million rows at most): a task grows whole trees, samples are not dealt.
SHARED_TIMES, SHARED_TREES = 6, 80
SAMPLE_ERROR = 1e-4


# ---- hashes -------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x ^ x >> np.uint64(31)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def bootstrap(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's sample."""
    salt = _mix(np.array([(seed << 32) + tree + 1], np.uint64))[0]
    u = (_mix(rows.view(np.uint64) ^ salt) >> np.uint64(11)).astype(float) / (1 << 53)
    return np.searchsorted(_POISSON, u, side="right").astype(np.uint8)


def feature_order(tree: int, nodes: np.ndarray, n_features: int, seed: int) -> np.ndarray:
    """(nodes, features): the order in which each node looks at features."""
    key = _mix(np.array([(seed << 32) + tree + 1], np.uint64))[0] ^ _mix(nodes.astype(np.uint64))
    draws = _mix(key[:, None] + np.arange(1, n_features + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    return np.argsort(draws, axis=1, kind="stable").astype(np.uint8)


# ---- bins ---------------------------------------------------------------

def cut_points(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper edges between bins: midpoints between neighbouring quantiles."""
    probs = [k / bins for k in range(bins + 1)]
    out = []
    for q in df.approxQuantile(list(features), probs, SAMPLE_ERROR):
        u = np.unique(np.array(q, float))
        out.append(((u[1:] + u[:-1]) / 2)[:bins - 1])
    return out


def codes_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8) if cuts else np.zeros((len(x), 0), np.uint8)


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1) if names else np.zeros((batch.num_rows, 0))


def binned(df: DataFrame, features: Sequence[str], target: str, cuts: list[np.ndarray], key: Column, fold: Column) -> DataFrame:
    """(row, codes, y, fold): a row's hash, one byte a feature, the target."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = codes_of(_columns(b, features), cuts)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array([c.tobytes() for c in codes], pa.binary()), b.column("_y"), b.column("_fold")],
                                             names=["row", "codes", "y", "fold"])

    rows = df.select(F.xxhash64(key).alias("_row"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features],
                     F.col(target).cast("double").alias("_y"), fold.cast("int").alias("_fold"))
    return rows.mapInArrow(run, "row long, codes binary, y double, fold int")


def _matrix(batch: pa.RecordBatch, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, n_features)
    return (batch.column("row").to_numpy(), codes, batch.column("y").to_numpy(), batch.column("fold").to_numpy())


def _chunks(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The matrices of a few batches at a time."""
    held, n = [], 0
    for b in batches:
        held.append(_matrix(b, n_features))
        n += b.num_rows
        if n >= CHUNK_ROWS:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _walk(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, flat: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` rows ends; ``flat``: their codes, feature by
    feature.  A node without a split (feature 0, cut 255) leads to itself."""
    at, rows = np.zeros(n, np.int64), np.arange(n)
    while True:
        to = left[at] + (flat[feature[at] * n + rows] > cut[at])
        if np.array_equal(to, at):
            return at
        at = to


# ---- trees --------------------------------------------------------------

@dataclass
class Tree:
    feature: np.ndarray     # -1: leaf
    bin: np.ndarray         # rows with code <= bin go left
    left: np.ndarray
    value: np.ndarray

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arrays that ``_walk`` follows."""
        leaf = self.feature < 0
        return np.where(leaf, 0, self.feature).astype(np.int64), np.where(leaf, BINS - 1, self.bin).astype(np.uint8), np.where(leaf, np.arange(len(leaf)), self.left)

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        return _walk(*self.steps(), codes.T.ravel(), len(codes)) if codes.size else np.zeros(len(codes), np.int64)

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(codes)]


@dataclass(frozen=True)
class Settings:
    trees: int = 200
    depth: int = 15
    per_split: int = 0          # features a node looks at; 0: the root of their number, rounded up
    seed: int = 42
    local_rows: int = LOCAL_ROWS

    def drawn(self, n_features: int) -> int:
        return min(n_features, self.per_split or math.ceil(math.sqrt(n_features)))


def _at(x: np.ndarray, i: np.ndarray) -> np.ndarray:
    """``x[i]`` of places that are known to be there: no check for each."""
    return np.take(x, i, mode="clip")


def _best_sorted(code: np.ndarray, node: np.ndarray, w: np.ndarray, wy: np.ndarray, total_w: np.ndarray, total_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best split of one feature per node (nodes 0..k-1): (score, bin); the
    score is the part of the sum of squares that two means explain, -inf
    without a split.  Rows of a node with one code stay together."""
    k = len(total_w)
    key = node * BINS + code
    if len(key) < 1 << 24:                      # a stable order by sorting plain numbers
        packed = np.sort(key.astype(np.uint64) << np.uint64(24) | np.arange(len(key), dtype=np.uint64))
        order, key = (packed & np.uint64((1 << 24) - 1)).astype(np.int64), (packed >> np.uint64(24)).astype(np.int64)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    lw, ly = np.cumsum(w[order]), np.cumsum(wy[order])
    first = np.searchsorted(node[order], np.arange(k))
    lw, ly = lw - np.concatenate(([0.0], lw))[first][node[order]], ly - np.concatenate(([0.0], ly))[first][node[order]]
    at = np.flatnonzero(key[1:] != key[:-1])
    at = at[node[order][at] == node[order][at + 1]]       # a place between two codes of one node
    score, cut = np.full(k, -np.inf), np.zeros(k, np.int64)
    if len(at):
        own = node[order][at]
        s = ly[at] ** 2 / lw[at] + (total_y[own] - ly[at]) ** 2 / (total_w[own] - lw[at])
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        best = np.maximum.reduceat(s, starts)
        hit = np.flatnonzero(s == np.repeat(best, np.diff(np.append(starts, len(s)))))
        hit = hit[np.concatenate(([True], own[hit][1:] != own[hit][:-1]))]      # of equal splits the first
        score[own[hit]], cut[own[hit]] = s[hit], code[order][at[hit]]
    return score, cut


def _best_binned(code: np.ndarray, node: np.ndarray, w: np.ndarray, wy: np.ndarray, total_w: np.ndarray, total_y: np.ndarray,
                 width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from sums by (node, code), without sorting rows; ``width``:
    codes of each node's feature."""
    k = len(total_w)
    start = np.concatenate(([0], np.cumsum(width)))
    key = _at(start, node)
    key += code
    sw = np.bincount(key, w, start[-1])
    cell = np.flatnonzero(sw)
    own = np.repeat(np.arange(k), width)[cell]
    lw, ly = np.cumsum(sw[cell]), np.cumsum(np.bincount(key, wy, start[-1])[cell])
    first = np.searchsorted(own, np.arange(k))
    lw, ly = lw - np.concatenate(([0.0], lw))[first][own], ly - np.concatenate(([0.0], ly))[first][own]
    at = np.flatnonzero(own[1:] == own[:-1])              # a place between two codes of one node
    score, cut = np.full(k, -np.inf), np.zeros(k, np.int64)
    if len(at):
        own, code, lw, ly = own[at], cell[at] - start[own[at]], lw[at], ly[at]
        s = ly ** 2 / lw + (total_y[own] - ly) ** 2 / (total_w[own] - lw)
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        best = np.maximum.reduceat(s, starts)
        hit = np.flatnonzero(s == np.repeat(best, np.diff(np.append(starts, len(s)))))
        hit = hit[np.concatenate(([True], own[hit][1:] != own[hit][:-1]))]      # of equal splits the first
        score[own[hit]], cut[own[hit]] = s[hit], code[hit]
    return score, cut


def grow(codes: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, root: int, depth: int, s: Settings) -> Tree:
    """The subtree of a node from its rows.  ``root`` is the node's number in
    the complete tree, which feature draws depend on."""
    (n, n_features), k = codes.shape, s.drawn(codes.shape[1])
    flat, widths = codes.T.ravel(), codes.max(axis=0).astype(np.int64) + 1
    w = w.astype(float)
    mean = float(np.average(y, weights=w))
    feature, cut, left, value = [np.array([-1])], [np.array([0])], [np.array([0])], [np.array([mean])]
    nodes = 1
    ids, node = np.array([root], np.int64), np.zeros(n, np.int64)
    rows = np.arange(n)                         # with their sums, of the nodes that may split
    wy = w * (y - mean)                         # sums around the mean lose no digits
    wyy = wy * (y - mean)
    place = np.array([0])                       # of each node of the level, among the level's
    for _ in range(depth):
        m = len(ids)
        tw, ty, tyy = (np.bincount(node, x, m) for x in (w, wy, wyy))
        mixed = tyy - ty ** 2 / tw > 1e-12 * tyy        # nodes of one value are leaves
        if not mixed.any():
            break
        if not mixed.all():
            number = np.cumsum(mixed) - 1
            keep = np.flatnonzero(_at(mixed, node))
            rows, w, wy, wyy, node = *(_at(x, keep) for x in (rows, w, wy, wyy)), _at(number, _at(node, keep))
            ids, place, tw, ty, tyy, m = ids[mixed], place[mixed], tw[mixed], ty[mixed], tyy[mixed], int(mixed.sum())
        order = feature_order(tree, ids, n_features, s.seed)
        best, best_f, best_cut = np.full(m, -np.inf), np.full(m, -1), np.zeros(m, np.int64)
        todo = np.arange(m)
        for j in range(n_features):
            r, own, rw, rwy = rows, node, w, wy
            if j >= k:                          # a node looks on while none of its features can split
                todo = np.flatnonzero(best == -np.inf)
                if not len(todo):
                    break
                number = np.full(m, -1)
                number[todo] = np.arange(len(todo))
                use = np.flatnonzero(_at(number, node) >= 0)
                r, own, rw, rwy = _at(rows, use), _at(number, _at(node, use)), _at(w, use), _at(wy, use)
            f = order[todo, j].astype(np.int64)
            code, sums = _at(flat, _at(f * n, own) + r), (rw, rwy, tw[todo], ty[todo])
            binned = n > SORTED_ROWS and widths[f].sum() <= 8 * len(r)
            score, at = _best_binned(code, own, *sums, widths[f]) if binned else _best_sorted(code, own, *sums)
            better = score > best[todo]
            best[todo[better]], best_f[todo[better]], best_cut[todo[better]] = score[better], f[better], at[better]
        gain = best - ty ** 2 / tw
        split = np.flatnonzero((best_f >= 0) & (gain > 1e-12 * tyy))
        if not len(split):
            break
        child = np.full(m, -1)
        child[split] = np.arange(len(split)) * 2
        feature[-1][place[split]], cut[-1][place[split]], left[-1][place[split]] = best_f[split], best_cut[split], nodes + child[split]
        if len(split) < m:
            keep = np.flatnonzero(_at(child, node) >= 0)
            rows, w, wy, wyy, node = (_at(x, keep) for x in (rows, w, wy, wyy, node))
        node = _at(child, node) + (_at(flat, _at(best_f * n, node) + rows) > _at(best_cut, node))
        size = 2 * len(split)
        tw, ty = np.bincount(node, w, size), np.bincount(node, wy, size)
        feature.append(np.full(size, -1))
        cut.append(np.zeros(size, np.int64))
        left.append(np.zeros(size, np.int64))
        value.append(mean + ty / tw)
        place = np.arange(size)
        nodes += size
        ids = np.stack([2 * ids[split] + 1, 2 * ids[split] + 2], axis=1).ravel()
    return Tree(*(np.concatenate(x).astype(t) for x, t in ((feature, np.int16), (cut, np.uint8), (left, np.int32), (value, float))))


# ---- levels over all rows -----------------------------------------------

@dataclass
class _Growing:
    """A tree whose upper levels are known: numbers of the complete tree."""
    exclude: int                                # fold whose rows are left out; -1: none
    splits: dict[int, tuple[int, int]]          # node -> (feature, bin)
    open: list[int]                             # nodes of the level that the next job splits
    small: list[int]                            # nodes that one task each finishes

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``_walk`` follows to the open or small node of each row."""
        n = 2 * max(self.splits, default=-1) + 3
        feature, cut, left = np.zeros(n, np.int64), np.full(n, BINS - 1, np.uint8), np.arange(n)
        for node, (f, b) in self.splits.items():
            feature[node], cut[node], left[node] = f, b, 2 * node + 1
        return feature, cut, left


def _plain(trees: list[_Growing]) -> list[tuple]:
    return [(t.exclude, t.splits, t.open, t.small) for t in trees]


def _level_sums(data: DataFrame, trees: list[_Growing], n_features: int, s: Settings) -> DataFrame:
    """(tree, node, feature, bin, w, wy) over the rows of open nodes."""
    shared = data.sparkSession.sparkContext.broadcast(_plain(trees))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_Growing(*t) for t in shared.value]
        sums: dict[int, np.ndarray] = {}
        order = {t: feature_order(t, np.array(g.open, np.int64), n_features, s.seed)[:, :s.drawn(n_features)].astype(np.int64) for t, g in enumerate(own) if g.open}
        steps = {t: own[t].steps() for t in order}
        for row, codes, y, fold in _chunks(batches, n_features):
            n, flat = len(row), codes.T.ravel()
            for t, looked in order.items():
                g = own[t]
                w = bootstrap(row, t, s.seed) * (fold != g.exclude)
                ends = _walk(*steps[t], flat, n)
                at = np.full(max(len(steps[t][0]), max(g.open) + 1), -1)
                at[g.open] = np.arange(len(g.open))
                use = np.flatnonzero((w > 0) & (at[ends] >= 0))
                node, w = at[ends[use]], w[use].astype(float)
                wy = w * y[use]
                h = sums.setdefault(t, np.zeros((2, len(g.open) * looked.shape[1] * BINS)))
                for j in range(looked.shape[1]):
                    key = (node * looked.shape[1] + j) * BINS + flat[(looked[:, j] * n)[node] + use]
                    h[0] += np.bincount(key, w, h.shape[1])
                    h[1] += np.bincount(key, wy, h.shape[1])
        for t, h in sums.items():
            i = np.flatnonzero(h[0])
            k = order[t].shape[1]
            node, j = i // BINS // k, i // BINS % k
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), t, np.int32)), pa.array(np.array(own[t].open, np.int64)[node]),
                                              pa.array(order[t][node, j].astype(np.int32)), pa.array((i % BINS).astype(np.int32)), pa.array(h[0][i]), pa.array(h[1][i])],
                                             names=["tree", "node", "feature", "bin", "w", "wy"])

    part = data.mapInArrow(run, "tree int, node long, feature int, bin int, w double, wy double")
    return part.groupBy("tree", "node", "feature", "bin").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))


def _best_splits(sums: DataFrame) -> DataFrame:
    """(tree, node, w, feature, bin, lw): the best split of each node; feature
    is null where no looked-at feature varies."""
    all_of = Window.partitionBy("tree", "node", "feature")
    upto = all_of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    x = sums.select("tree", "node", "feature", "bin", F.sum("w").over(upto).alias("lw"), F.sum("wy").over(upto).alias("ly"),
                    F.sum("w").over(all_of).alias("tw"), F.sum("wy").over(all_of).alias("ty"))
    score = F.when(F.col("lw") < F.col("tw"), F.col("ly") * F.col("ly") / F.col("lw") + (F.col("ty") - F.col("ly")) * (F.col("ty") - F.col("ly")) / (F.col("tw") - F.col("lw")))
    best = F.max_by(F.struct("feature", "bin", "lw"), F.struct(F.col("score"), -F.col("feature"), -F.col("bin")))
    x = x.withColumn("score", score)
    return x.groupBy("tree", "node").agg(F.max("tw").alias("w"), F.max("score").alias("score"), best.alias("best")).select(
        "tree", "node", "w", F.when(F.col("score").isNotNull(), F.col("best.feature")).alias("feature"), "best.bin", "best.lw")


def _finish(data: DataFrame, trees: list[_Growing], n_features: int, s: Settings) -> DataFrame:
    """(tree, node, feature, bin, left, value): subtrees of the small nodes, as
    packed arrays.  Each task packs its rows of a node into one row."""
    shared = data.sparkSession.sparkContext.broadcast(_plain(trees))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_Growing(*t) for t in shared.value]
        steps = {t: g.steps() for t, g in enumerate(own) if g.small}
        for row, codes, y, fold in _chunks(batches, n_features):
            flat = codes.T.ravel()
            for t in steps:
                use = np.flatnonzero(bootstrap(row, t, s.seed) * (fold != own[t].exclude))
                node = _walk(*steps[t], flat, len(row))[use]
                order = np.argsort(node, kind="stable")
                use, node = use[order], node[order]
                ids, first = np.unique(node, return_index=True)
                out = [(t, n, codes[i].tobytes(), y[i].tobytes(), row[i].tobytes()) for n, i in zip(ids.tolist(), np.split(use, first[1:])) if len(i)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 3))],
                                                     names=["tree", "node", "codes", "y", "row"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hold = None, []

        def settle() -> pa.RecordBatch:
            codes, y, row = (np.frombuffer(b"".join(r[k] for r in hold), kind) for k, kind in enumerate((np.uint8, float, np.int64)))
            # the same order on any partitioning, so sums are the same too
            i = np.lexsort((y, row))
            depth = int(math.log2(key[1] + 1))
            t = grow(codes.reshape(-1, n_features)[i], y[i], bootstrap(row[i], key[0], s.seed), key[0], key[1], s.depth - depth, s)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()),
                                               *(pa.array([a.tobytes()], pa.binary()) for a in (t.feature, t.bin, t.left, t.value))],
                                              names=["tree", "node", "feature", "bin", "left", "value"])

        for b in batches:
            for t, n, *parts in zip(*(b.column(c).to_pylist() for c in ("tree", "node", "codes", "y", "row"))):
                if (t, n) != key and hold:
                    yield settle()
                    hold = []
                key = (t, n)
                hold.append(parts)
        if hold:
            yield settle()

    packed = data.mapInArrow(pack, "tree int, node long, codes binary, y binary, row binary")
    # one task for each few trees: the subtrees are bounded, the trees many
    tasks = max(1, min(sum(len(t.small) for t in trees), 4 * data.sparkSession.sparkContext.defaultParallelism))
    rows = packed.repartition(tasks, "tree", "node").sortWithinPartitions("tree", "node")
    return rows.mapInArrow(build, "tree int, node long, feature binary, bin binary, left binary, value binary")


def _whole(data: DataFrame, exclude: Sequence[int], n_features: int, s: Settings) -> DataFrame:
    """(tree, feature, bin, left, value): every tree grown whole by one task
    from the table that all tasks share."""
    t = data.toArrow()
    row, y, fold = (t.column(c).to_numpy() for c in ("row", "y", "fold"))
    fixed = [c.cast(pa.binary(n_features)) for c in t.column("codes").chunks if len(c)]
    codes = np.concatenate([np.frombuffer(c.buffers()[1], np.uint8).reshape(-1, n_features)[c.offset:c.offset + len(c)] for c in fixed])
    i = np.lexsort((y, row))                    # the same order on any partitioning, so sums are the same too
    spark = data.sparkSession
    shared = spark.sparkContext.broadcast((row[i], codes[i], y[i], fold[i].astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, codes, y, fold = shared.value
        for b in batches:
            for t in b.column("id").to_pylist():
                w = bootstrap(row, t, s.seed) * (fold != exclude[t])
                use = np.flatnonzero(w)
                if len(use):
                    g = grow(codes[use], y[use], w[use], t, 0, s.depth, s)
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (g.feature, g.bin, g.left, g.value))],
                                                     names=["tree", "feature", "bin", "left", "value"])

    tasks = max(1, min(len(exclude), 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, len(exclude), 1, tasks).mapInArrow(run, "tree int, feature binary, bin binary, left binary, value binary")


def _joined(splits: dict[int, tuple[int, int]], parts: dict[int, tuple], mean: float) -> Tree:
    """One tree from its upper splits and the subtrees below them."""
    feature, cut, left, value = [], [], [], []

    def reserve() -> int:
        for a, x in ((feature, -1), (cut, 0), (left, 0), (value, mean)):
            a.append(x)
        return len(feature) - 1

    todo = [(0, reserve())]
    while todo:
        node, at = todo.pop()
        if node in splits:
            a, b = reserve(), reserve()
            feature[at], cut[at], left[at] = *splits[node], a
            todo += [(2 * node + 1, a), (2 * node + 2, b)]
        elif node in parts:
            f, c, lf, v = parts[node]
            base = len(feature) - 1             # its root takes the reserved place, the others follow
            feature[at], cut[at], left[at], value[at] = int(f[0]), int(c[0]), int(lf[0]) + base if f[0] >= 0 else 0, float(v[0])
            feature += f[1:].tolist()
            cut += c[1:].tolist()
            left += np.where(f[1:] >= 0, lf[1:] + base, 0).tolist()
            value += v[1:].tolist()
    return Tree(np.array(feature, np.int16), np.array(cut, np.uint8), np.array(left, np.int32), np.array(value))


def _arrays(r) -> tuple:
    return tuple(np.frombuffer(r[c], k) for c, k in (("feature", np.int16), ("bin", np.uint8), ("left", np.int32), ("value", float)))


def fit_forests(df: DataFrame, features: Sequence[str], target: str, settings: Settings, key: Column, fold: Column | None = None,
                exclude: Sequence[int] = (-1,)) -> list["Forest"]:
    """A forest for each entry of ``exclude``, which leaves out the rows of
    that fold (-1: none).  All trees of all forests grow in the same jobs."""
    row = df.agg(*[(F.min(f) != F.max(f)).alias(f"c{i}") for i, f in enumerate(features)], F.count(F.lit(1)).alias("n"), F.avg(target).alias("mean")).first()
    # a column that never varies can't split
    used = [f for i, f in enumerate(features) if row[f"c{i}"]]
    s, mean = settings, float(row["mean"] or 0.0)
    cuts = cut_points(df, used) if used else []
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(4 * cores, row["n"] // 20_000), row["n"] // 1_000_000)     # work per row is that of all trees
    data = binned(df, used, target, cuts, key, fold if fold is not None else F.lit(0)).repartition(tasks).persist()
    trees = [_Growing(k, {}, [0], []) for k in exclude for _ in range(s.trees)]
    try:
        if row["n"] and used and row["n"] <= min(SHARED_TIMES * s.local_rows, DEALT_ROWS // SHARED_TREES):
            grown = {r["tree"]: Tree(*_arrays(r)) for r in _whole(data, [t.exclude for t in trees], len(used), s).collect()}     # the model itself
            done = [grown.get(i) or _joined({}, {}, mean) for i in range(len(trees))]
        elif row["n"] and used:
            rows = [row["n"]] * len(trees)      # at most so many in the root
            for t, n in zip(trees, rows):
                if n <= s.local_rows:
                    t.open, t.small = [], [0]
            for level in range(s.depth):
                if not any(t.open for t in trees):
                    break
                now = {(r["tree"], r["node"]): r for r in _best_splits(_level_sums(data, trees, len(used), s)).collect()}
                for i, t in enumerate(trees):
                    nodes, t.open = t.open, []
                    for n in nodes:
                        r = now.get((i, n))
                        if r is None:
                            continue
                        if r["feature"] is None:
                            t.small.append(n)       # one task sees whether other features split it
                            continue
                        t.splits[n] = (r["feature"], r["bin"])
                        for child, w in ((2 * n + 1, r["lw"]), (2 * n + 2, r["w"] - r["lw"])):
                            (t.open if w > s.local_rows and level + 1 < s.depth else t.small).append(child)
            parts: list[dict[int, tuple]] = [{} for _ in trees]
            # some trees at a time, so that what is dealt has a bound on disk whatever the rows
            step = max(1, DEALT_ROWS // row["n"])
            for a in range(0, len(trees), step):
                now = [t if a <= i < a + step else _Growing(t.exclude, {}, [], []) for i, t in enumerate(trees)]
                for r in _finish(data, now, len(used), s).collect():     # the model itself: bounded by depth and trees
                    parts[r["tree"]][r["node"]] = _arrays(r)
                if a + step < len(trees):
                    df.sparkSession.sparkContext._jvm.System.gc()       # Spark drops what no plan refers to any more
            done = [_joined(t.splits, p, mean) for t, p in zip(trees, parts)]
        else:
            done = [Tree(np.array([-1], np.int16), np.zeros(1, np.uint8), np.zeros(1, np.int32), np.array([mean])) for _ in trees]
    finally:
        data.unpersist()
    return [Forest(list(features), used, cuts, done[i * s.trees:(i + 1) * s.trees]) for i in range(len(exclude))]


# ---- the model ----------------------------------------------------------

@dataclass
class Forest:
    features: list[str]
    used: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree]

    def _shared(self, df: DataFrame):
        plain = [(t.feature, t.bin, t.left, t.value) for t in self.trees]
        return df.sparkSession.sparkContext.broadcast((self.used, self.cuts, plain))

    def transform(self, df: DataFrame, floor: float | None = 0.0, out: str = "prediction") -> DataFrame:
        """Adds ``out``, the mean of the trees."""
        shared = self._shared(df)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            used, cuts, plain = shared.value
            trees = [(*Tree(*t).steps(), t[3]) for t in plain]
            for b in batches:
                flat = codes_of(np.nan_to_num(_columns(b, used)), cuts).T.ravel()
                at = (value[_walk(*steps, flat, b.num_rows) if len(flat) else np.zeros(b.num_rows, np.int64)] for *steps, value in trees)
                p = sum(at, np.zeros(b.num_rows)) / len(trees)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p if floor is None else np.maximum(p, floor))], names=[*b.schema.names, out])

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, DoubleType())]))
