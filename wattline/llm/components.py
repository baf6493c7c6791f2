"""Connected components by contraction, as Spark joins.

Each round every vertex goes to the smallest of itself and its neighbours and
edges are drawn between the new vertices; equal edges fall together, so a hot
vertex costs one row per task.  Vertices are hashes, so the order is random
and the number of edges shrinks by a constant factor a round.  The last
``FEW`` edges, a checked number, are finished by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import drop_saved, map_arrow, save


#: Edges that one task joins by itself.
FEW = 10_000


def _finish(edges: DataFrame) -> DataFrame:
    """(u, m) for the vertices of at most FEW edges: union-find in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
                a, b = root(u), root(v)
                parent[max(a, b)] = min(a, b)
        if parent:
            names = list(parent)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([root(x) for x in names], pa.int64())], names=["u", "m"])

    return map_arrow(edges.repartition(1), run, "u long, m long")


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of links (a, b)."""
    edges = save(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).where("u != v").distinct(), "edges", 2 * links.count())
    label, most = None, edges.count()       # a vertex has an edge, so no table has more rows than the first edges
    while (left := edges.count()) > 0:
        step = _finish(edges) if left <= FEW else edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        step = save(step, "contract", left)
        if label is None:
            new = step.select(F.col("u").alias("v"), F.col("m").alias("root"))
        else:
            new = label.join(step, label["root"] == step["u"], "left").select("v", F.coalesce("m", "root").alias("root"))
        new = save(new, "labels", most)
        if left <= FEW:
            for old in (edges, step, label):
                if old is not None:
                    drop_saved(old)
            return new
        to_u, to_v = step.select("u", F.col("m").alias("mu")), step.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        moved = edges.join(to_u, "u").join(to_v, "v").select(F.col("mu").alias("u"), F.col("mv").alias("v")).where("u != v").distinct()
        moved = save(moved, "edges", left)
        for old in (edges, step, label):
            if old is not None:
                drop_saved(old)
        edges, label = moved, new
    drop_saved(edges)
    if label is None:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root")).where("false")
    return label
