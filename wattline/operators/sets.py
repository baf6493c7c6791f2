"""Set algebra over key sets stored as (set_id, key) rows.

The sets are those in the data.  Pairwise overlaps come from each key's sorted
list of sets (at most the number of sets) and the counts of equal lists: no
self-join of keys, so no pair is emitted per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def memberships(members: DataFrame, set_col: str, key: str) -> DataFrame:
    """key -> sorted distinct ids (as text) of the sets that hold it."""
    m = members.select(key, F.col(set_col).cast("string").alias("_s")).where(F.col(key).isNotNull() & F.col("_s").isNotNull())
    return m.groupBy(key).agg(F.array_sort(F.collect_set("_s")).alias("sets"))


def _pairs(sets: Column) -> Column:
    """All (earlier, later) pairs of a sorted array."""
    return F.flatten(F.transform(sets, lambda a, i: F.transform(
        F.slice(sets, i + 2, F.size(sets)), lambda b: F.struct(a.alias("set_a"), b.alias("set_b")))))


def pairwise_overlap(members: DataFrame, set_col: str, key: str) -> DataFrame:
    """|S_i n S_j| for every pair of sets, plus their mean (``avg_overlap``)."""
    kinds = memberships(members, set_col, key).groupBy("sets").agg(F.count(F.lit(1)).alias("keys"))
    inside = (kinds.select("keys", F.explode(_pairs(F.col("sets"))).alias("p")).select("keys", "p.*")
              .groupBy("set_a", "set_b").agg(F.sum("keys").alias("overlap")))
    # one row: the ids of all sets, and from it the n (n - 1) / 2 pairs
    every = kinds.select(F.explode("sets").alias("_s")).agg(F.array_sort(F.collect_set("_s")).alias("sets"))
    every = every.select(F.explode(_pairs(F.col("sets"))).alias("p")).select("p.*")
    per_pair = every.join(inside, ["set_a", "set_b"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    avg = per_pair.agg(F.avg("overlap").alias("avg_overlap"))
    return per_pair.crossJoin(F.broadcast(avg))


def in_exactly_k(members: DataFrame, set_col: str, key: str, k: int) -> DataFrame:
    m = members.where(F.col(key).isNotNull() & F.col(set_col).isNotNull())
    return m.groupBy(key).agg(F.count_distinct(set_col).alias("_n")).where(F.col("_n") == k).select(key)


def key_set(df: DataFrame, key: str, cond=None) -> DataFrame:
    d = df if cond is None else df.where(cond)
    return d.select(key).where(F.col(key).isNotNull())


def intersect_all_sets(sets: Sequence[DataFrame]) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.intersect(s)
    return out


def union_distinct(sets: Sequence[DataFrame]) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.union(s)
    return out.distinct()


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def inverted_index(df: DataFrame, value: str, key: str) -> DataFrame:
    """value -> its keys, in long form (value, key, n_keys): no key list is
    gathered into one row, so a value shared by most keys stays spread out;
    the counts are a partial aggregate joined back on the value."""
    pairs = df.select(value, key).where(F.col(value).isNotNull()).distinct()
    counts = pairs.groupBy(value).agg(F.count(F.lit(1)).alias("n_keys"))
    return pairs.join(counts, value, "inner")
