"""Merkle manifest of a dataset, its subtrees stored in van Emde Boas layout.

Every row is a leaf.  The leaves of a source, by id, form a tree of fan-out 16;
the roots of all sources, by source, form the tree above.  A tree is cut into
aligned subtrees ("blocks") of four levels of nodes, 4,096 leaves.  One task
hashes one block and stores its nodes as one array: the upper half of the
levels first, then each subtree below it, each half laid out the same way
again.  The place of a node is arithmetic on (level, index), so construction
and sibling retrieval look nothing up.  The roots of the blocks are the leaves
of the next layer of blocks, until one is left.

A proof goes down the layers: each block hands every block below it the
siblings on the way to the root, and the lowest blocks hand them to the rows.

Leaves get their places by a range partitioning on (source, id, leaf) and the
row counts of the partitions, so a hot source is many partitions, and texts
are hashed where they are read.

Defined results: a null source is a source of its own and comes first; a null
id comes first in its source and is never tampered with; rows repeated under
one id are leaves of their own, in order of their hashes; extra columns are
ignored; an empty table has no leaves and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import map_arrow, save

FAN = 16
LEVELS = 4                      # levels of nodes in a block, its leaves included
SPAN = FAN ** (LEVELS - 1)      # leaves of a block
HEX = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

BLOCKS = "tree long, layer int, block long, levels int, n int, nodes binary, root string"
PATH = "array<struct<left:string, right:string>>"


# ---- the layout ---------------------------------------------------------

def n_nodes(levels: int) -> int:
    return (FAN ** levels - 1) // (FAN - 1)


def places(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` at ``depth`` (0: the root) of a block of
    ``levels`` levels: the upper half, then the subtrees below it in order."""
    index = np.asarray(index, np.int64)
    base = np.zeros_like(index)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        below = FAN ** (depth - upper)
        base = base + n_nodes(upper) + index // below * n_nodes(levels - upper)
        index, depth, levels = index % below, depth - upper, levels - upper
    return base


def levels_for(n: int) -> int:
    levels = 1
    while FAN ** (levels - 1) < n:
        levels += 1
    return levels


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


class Block:
    """The nodes of one aligned subtree, as an array of hex digests."""

    def __init__(self, levels: int, n: int, nodes: np.ndarray):
        self.levels, self.n, self.nodes = levels, n, nodes

    @classmethod
    def build(cls, leaves: np.ndarray, levels: int) -> Block:
        n = len(leaves)
        count = [-(-n // FAN ** (levels - 1 - d)) for d in range(levels)]
        last = max(int(places(levels, d, [k - 1])[0]) for d, k in enumerate(count))
        block = cls(levels, n, np.zeros(last + 1, f"S{HEX}"))
        block.nodes[places(levels, levels - 1, np.arange(n))] = leaves
        for d in range(levels - 2, -1, -1):
            block.nodes[places(levels, d, np.arange(count[d]))] = [digest(block.run(d + 1, j)) for j in range(count[d])]
        return block

    def run(self, depth: int, j: int) -> bytes:
        """The digests of the ``j``-th run of siblings at a depth."""
        stop = min((j + 1) * FAN, -(-self.n // FAN ** (self.levels - 1 - depth)))
        return self.nodes[places(self.levels, depth, np.arange(j * FAN, stop))].tobytes()

    @property
    def root(self) -> str:
        return self.nodes[0].decode()


class Prover:
    """Sibling paths of the leaves of a block, and of what lies above it."""

    def __init__(self, block: Block, above: list[tuple[bytes, bytes]]):
        self.block, self.above = block, above
        self.above_bytes = b"".join(left + right for left, right in above)
        self.runs: dict[tuple[int, int], bytes] = {}
        self.folded: dict[tuple[int, int, bytes], bytes] = {}

    def siblings(self, depth: int, index: int) -> tuple[bytes, bytes]:
        j, own = divmod(index, FAN)
        run = self.runs.get((depth, j))
        if run is None:
            run = self.runs[depth, j] = self.block.run(depth, j)
        return run[:HEX * own], run[HEX * (own + 1):]

    def path(self, index: int) -> list[tuple[bytes, bytes]]:
        return [self.siblings(d, index // FAN ** (self.block.levels - 1 - d)) for d in range(self.block.levels - 1, 0, -1)]

    def proof(self, index: int) -> str:
        h = hashlib.sha256()
        for left, right in self.path(index):
            h.update(left)
            h.update(right)
        h.update(self.above_bytes)
        return h.hexdigest()

    def fold(self, depth: int, index: int, own: bytes) -> bytes:
        """The root that a digest in the place of a node leads to."""
        known = self.folded.get((depth, index, own))
        if known is not None:
            return known
        if depth == 0:
            up = own
            for left, right in self.above:
                up = digest(left + up + right)
        else:
            left, right = self.siblings(depth, index)
            up = self.fold(depth - 1, index // FAN, digest(left + own + right))
        if depth < self.block.levels - 1:       # leaves are asked for once
            self.folded[depth, index, own] = up
        return up


# ---- leaves -------------------------------------------------------------

def field(col: Column) -> Column:
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(cols: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, cols)), 256)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows (source, doc_id, leaf, other) with (tree, pos): the rank of the
    source and the place in it.  The largest table that is joined holds one
    row per partition and source."""
    order = ["source", "doc_id", "leaf"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
    at = F.monotonically_increasing_id()      # (partition, row in it), after the sort
    rows = save(ranged.drop("_tie").withColumn("at", at).select(
        "*", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("idx")).drop("at"), "merkle-rows")
    heads = rows.groupBy("part", "source").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = save(heads.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")), "merkle-heads")
    # sources in order: the partitions hold them sorted, so (first partition, first row) ranks them
    firsts = heads.groupBy("source").agg(F.min(F.struct("part", "first")).alias("head"))
    per_part = firsts.groupBy(F.col("head.part").alias("part")).agg(F.count(F.lit(1)).alias("k"))
    base = per_part.select("part", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    trees = (firsts.select("source", "head.part", "head.first").join(base, "part")
             .select("source", (F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("first")) - 1).alias("tree")))
    known = lambda df: df.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_null", F.col("source").isNull()).drop("source")
    heads = known(heads).join(known(trees), ["_s", "_null"]).select("part", "_s", "_null", "start", "tree")
    return known(rows).join(heads, ["part", "_s", "_null"]).select("tree", (F.col("start") + F.col("idx")).alias("pos"), "doc_id", "leaf", "other")


# ---- layers of blocks ---------------------------------------------------

def _blocks_of(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[pa.RecordBatch]]]:
    """Rows of one block after the other, from rows sorted by (tree, block)."""
    key, hold = None, []
    for batch in rows:
        if not batch.num_rows:
            continue
        tree, block = (batch.column(c).to_numpy() for c in ("tree", "block"))
        cut = np.flatnonzero((np.diff(tree) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            own = (int(tree[a]), int(block[a]))
            if own != key and hold:
                yield key, hold
                hold = []
            key = own
            hold.append(batch.slice(a, b - a))
    if hold:
        yield key, hold


def _hex(batches: list[pa.RecordBatch], col: str) -> np.ndarray:
    return np.concatenate([b.column(col).to_numpy(zero_copy_only=False) for b in batches]).astype(f"S{HEX}")


def _build(nodes: DataFrame, layer: int) -> DataFrame:
    """Blocks of a layer from its nodes (tree, pos, digest)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string())
        for (tree, block), rows in _blocks_of(batches):
            leaves = _hex(rows, "digest")
            # the first block of a tree that it does not fill is the whole tree
            b = Block.build(leaves, LEVELS if block else levels_for(len(leaves)))
            row = (tree, layer, block, b.levels, b.n, b.nodes.tobytes(), b.root)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

    rows = nodes.select("tree", F.expr(f"pos div {SPAN}").alias("block"), "pos", "digest")
    return map_arrow(rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos"), run, BLOCKS)


def _grow(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame | None]:
    """(layers of blocks, lowest first; (tree, layer, root) of the finished trees)."""
    layers, done = [], None
    while True:
        blocks = save(_build(nodes, len(layers)), f"{name}-{len(layers)}")
        layers.append(blocks)
        per = blocks.groupBy("tree").agg(F.max("block").alias("last"), F.max("root").alias("root"))
        ended = per.where("last = 0").select("tree", F.lit(len(layers) - 1).alias("layer"), "root")
        done = ended if done is None else done.unionByName(ended)
        going = per.where("last > 0").select("tree")
        if going.isEmpty():
            return layers, save(done, f"{name}-roots")
        nodes = blocks.join(going, "tree", "left_semi").select("tree", F.col("block").alias("pos"), F.col("root").alias("digest"))


@dataclass
class Manifest:
    leaves: DataFrame            # (tree, pos, doc_id, leaf, other)
    layers: list[DataFrame]      # blocks of the sources' trees, lowest first
    subroots: DataFrame          # (tree, layer, root)
    top: list[DataFrame]         # blocks of the tree above
    root: str | None


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, changed: Callable[[], dict[str, Column]] | None = None) -> Manifest:
    """Hash every row and store the trees.  ``changed`` gives columns to use
    instead in ``other``, the leaf that is to be checked."""
    own = {c: F.col(c) for c in fields}
    other = own | (changed() if changed else {})
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"),
                       leaf_hash(list(own.values())).alias("leaf"), *([leaf_hash(list(other.values())).alias("other")] if changed else []))
    rows = rows if changed else rows.withColumn("other", F.col("leaf"))
    leaves = save(_placed(rows), "merkle-leaves")
    layers, subroots = _grow(leaves.select("tree", "pos", F.col("leaf").alias("digest")), "merkle")
    top, roots = _grow(subroots.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("root").alias("digest")), "merkle-top")
    row = roots.first()
    return Manifest(leaves, layers, subroots, top, row["root"] if row else None)


def _paths_below(blocks: DataFrame) -> DataFrame:
    """(tree, block, path) of the nodes under blocks with their own ``path``:
    the leaf at a place of a layer is the block of that number below it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for batch in batches:
            for r in batch.to_pylist():
                p = Prover(_stored(r), [])
                above = [(s["left"], s["right"]) for s in r["path"]]
                first = r["block"] * SPAN
                for at in range(0, r["n"], 64):
                    i = range(at, min(at + 64, r["n"]))
                    paths = [[{"left": x.decode(), "right": y.decode()} for x, y in p.path(k)] + [{"left": x, "right": y} for x, y in above] for k in i]
                    yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * len(i), pa.int64()), pa.array([first + k for k in i], pa.int64()),
                                                      pa.array(paths, kind)], names=["tree", "block", "path"])

    return map_arrow(blocks, run, f"tree long, block long, path {PATH}")


def _stored(r: dict) -> Block:
    return Block(r["levels"], r["n"], np.frombuffer(r["nodes"], f"S{HEX}"))


def _down(layers: list[DataFrame], ended: DataFrame, name: str) -> Iterator[tuple[DataFrame, DataFrame]]:
    """From the highest layer to the lowest: (blocks with their path to the
    root, paths of what is below them).  ``ended`` holds (tree, layer, path)
    of the roots of the trees."""
    paths = None
    for k in range(len(layers) - 1, -1, -1):
        own = ended.where(F.col("layer") == k).select("tree", F.lit(0).cast("long").alias("block"), "path")
        paths = own if paths is None else own.unionByName(paths)
        blocks = layers[k].join(paths, ["tree", "block"])
        paths = save(_paths_below(blocks), name) if k else None
        yield blocks, paths


def check(m: Manifest) -> DataFrame:
    """Per leaf: doc_id, leaf, subroot, root, proof_sha256 of its siblings up to
    the root, the root that ``other`` leads to with them, and whether it is the
    manifest's."""
    empty = F.expr(f"cast(array() as {PATH})")
    top = list(_down(m.top, m.top[-1].where("block = 0").select("tree", "layer", empty.alias("path")), "merkle-path"))[-1][0]
    tree_paths = save(_paths_below(top).select(F.col("block").alias("tree"), "path"), "merkle-path")
    ended = m.subroots.join(tree_paths, "tree")
    blocks = list(_down(m.layers, ended.select("tree", "layer", "path"), "merkle-path"))[-1][0]
    blocks = blocks.join(m.subroots.select("tree", F.col("root").alias("subroot")), "tree")
    root = (m.root or "").encode()
    head = blocks.select("tree", "block", F.lit(-1).cast("long").alias("pos"), "levels", "n", "nodes", "path", "subroot",
                         F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("leaf"), F.lit(None).cast("string").alias("other"))
    rows = m.leaves.select("tree", F.expr(f"pos div {SPAN}").alias("block"), "pos", F.lit(None).cast("int").alias("levels"), F.lit(None).cast("int").alias("n"),
                           F.lit(None).cast("binary").alias("nodes"), F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"),
                           "doc_id", "leaf", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, number), parts in _blocks_of(batches):
            r = parts[0].slice(0, 1).to_pylist()[0]      # the block sorts before its leaves
            p = Prover(_stored(r), [(s["left"].encode(), s["right"].encode()) for s in r["path"]])
            parts[0] = parts[0].slice(1)
            for b in parts:
                index = (b.column("pos").to_numpy() - number * SPAN).tolist()
                others = b.column("other").to_pylist()
                folded = [p.fold(r["levels"] - 1, i, x.encode()) for i, x in zip(index, others)]
                k = len(index)
                yield pa.RecordBatch.from_arrays([
                    b.column("doc_id"), b.column("leaf"), pa.array([r["subroot"]] * k, pa.string()), pa.array([root.decode()] * k, pa.string()),
                    pa.array([p.proof(i) for i in index], pa.string()), pa.array([x.decode() for x in folded], pa.string()),
                    pa.array([x == root for x in folded], pa.bool_())],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    both = head.unionByName(rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return map_arrow(both, run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def check_lowered(docs: DataFrame) -> DataFrame:
    """Check the table against its manifest after the texts of the rows whose
    id's crc32 5 divides were put in lower case (A-Z)."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.col("text").cast("string")
    return check(build(docs, changed=lambda: {"text": F.when(hit, ascii_lower(text)).otherwise(text)}))
