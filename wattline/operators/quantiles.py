"""Exact grouped percentiles that stay balanced when one group, or one value
of it, is huge.  Groups fall into slots by the hash of their keys; slots are
counted first (a few numbers per task).  Groups of small slots, usually all,
are dealt by their keys and sorted whole.  Those of large slots take four steps:

1. rows are counted per (keys, value): copies of a value fall together inside
   each map task, and the rest is dealt by (keys, value);
2. values fall into buckets by a fixed monotone function of the value alone
   (logarithmic, ``STEPS`` a factor e), so buckets need no sampling and come
   out the same whenever they are computed;
3. bucket counts per group give the buckets that hold the wanted ranks;
4. only values of these buckets are sorted, each bucket by itself.

The plan is lazy: building it runs no job.  Keys may be null (null-safe
joins).  Results are the linear interpolation of ``percentile_cont`` at
``pos = (n - 1) * p``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each factor e in the magnitude of a value.
STEPS = 16384


def value_bucket(v: Column) -> Column:
    """Monotone bucket number of a double; NaN is the largest value, as in a sort."""
    size = F.floor(F.log(1.0 + F.abs(v) * 1e6) * STEPS)
    return F.when(F.isnan(v), F.lit((1 << 63) - 1)).when(v < 0, -size).otherwise(size).cast("long")


#: Slots that groups fall into by the hash of their keys, and the rows from
#: which a slot's groups are dealt by value instead of sorted whole.
SLOTS, HOT_ROWS = 1 << 16, 1 << 16


def grouped_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                        extra_aggs: list | None = None, large: bool = False) -> DataFrame:
    """One row per group with a non-null value: ``keys + extra + list(probs)``.

    ``extra_aggs`` are aggregate columns over the rows with a value.  ``large``:
    the groups are few (categories), so all are dealt by value at once."""
    v = F.col(value).cast("double")
    base = df.withColumn("_v", F.when(v == 0, F.lit(0.0)).otherwise(v)).where(F.col("_v").isNotNull())       # one zero
    if large or not keys:
        return _large_groups(base, keys, probs, extra_aggs)
    base = base.withColumn("_slot", F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int"))
    # at most SLOTS rows, whatever the number of groups
    hot = F.broadcast(base.groupBy("_slot").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > HOT_ROWS).select("_slot"))
    return _small_groups(base.join(hot, "_slot", "left_anti"), keys, probs, extra_aggs).unionByName(
        _large_groups(base.join(hot, "_slot", "left_semi"), keys, probs, extra_aggs))


def _large_groups(base: DataFrame, keys: list[str], probs: dict[str, float], extra_aggs: list | None) -> DataFrame:
    """Groups of any size, dealt by value; ``extra_aggs`` are one more
    aggregation, joined per group."""
    pct = _by_value(base, keys, probs)
    if not extra_aggs:
        return pct
    if not keys:
        return base.agg(*extra_aggs).crossJoin(F.broadcast(pct))     # one row each
    right = pct.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *probs)
    left = base.groupBy(*keys).agg(*extra_aggs)
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & left[k].eqNullSafe(right[f"_k{i}"])
    return left.join(right, cond).drop(*[f"_k{i}" for i in range(len(keys))])


def _between(rank: str, probs: dict[str, float]) -> list[Column]:
    """The percentiles of a group whose rows have their rank (from 0) and the group's size ``_n``."""
    out = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo = F.max(F.when(F.col(rank) == F.floor(pos), F.col("_v")))
        hi = F.max(F.when(F.col(rank) == F.ceil(pos), F.col("_v")))
        out.append(F.when(lo == hi, lo).otherwise(lo + F.max(pos - F.floor(pos)) * (hi - lo)).alias(name))
    return out


def _small_groups(base: DataFrame, keys: list[str], probs: dict[str, float], extra_aggs: list | None) -> DataFrame:
    """Groups of at most HOT_ROWS rows: one shuffle and one sort by group and value."""
    group = Window.partitionBy(*keys)
    rows = base.withColumn("_r", F.row_number().over(group.orderBy("_v")) - 1).withColumn("_n", F.count(F.lit(1)).over(group))
    return rows.groupBy(*keys).agg(*(extra_aggs or []), *_between("_r", probs))


def _by_value(base: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    counts = base.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", value_bucket(F.col("_v")))
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"))
    group = Window.partitionBy(*keys)
    # a group has at most a few thousand buckets for each magnitude of its values
    buckets = (buckets.withColumn("_start", F.coalesce(F.sum("_c").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("_n", F.sum("_c").over(group)))
    ranks = F.array_distinct(F.array(*[f((F.col("_n") - 1) * F.lit(float(p))).cast("long") for p in probs.values() for f in (F.floor, F.ceil)]))
    wanted = buckets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_wb"), "_start", "_n",
                            F.filter(ranks, lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_c"))).alias("_ranks")).where(F.size("_ranks") > 0)
    cond = counts["_b"] == wanted["_wb"]
    for i, k in enumerate(keys):
        cond = cond & counts[k].eqNullSafe(wanted[f"_k{i}"])
    rows = counts.join(wanted, cond)
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    upto = F.col("_start") + F.sum("_c").over(inside)
    rows = rows.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_c"))
    rows = rows.withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_to")))))
    return rows.groupBy(*keys).agg(*_between("_r", probs))
