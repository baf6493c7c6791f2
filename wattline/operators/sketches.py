"""Mergeable day sketches beside the exact aggregates.

A day is summed up once, as a row per key: counts, a HyperLogLog sketch of the
distinct items and a KLL sketch of the values.  Rows of sketches are a few KB,
whatever the traffic; any range of days is a merge of them, without reading
the days again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the sketches: 2**LG_K registers, and the KLL parameter.
LG_K, KLL_K = 12, 400
#: Bounds that hold with high probability: three standard errors of the
#: distinct count, and the rank error of a quantile.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / math.sqrt(1 << LG_K), 0.015


def day_sketches(rows: DataFrame, keys: Sequence[str], item: str, value: str, day: str = "day") -> DataFrame:
    """(keys, day, n, items, values): one row per key and day.  Sketches are
    built on every task and merged, so a hot key costs one sketch a task."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, day).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(item, LG_K).alias("items"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("values"))


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of the keys over all days that are given."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values").alias("values"))


def estimates(sketches: DataFrame, quantiles: dict[str, float]) -> DataFrame:
    """Adds ``distinct_est`` and a column per quantile."""
    return sketches.withColumns({"distinct_est": F.hll_sketch_estimate("items"),
                                 **{c: F.kll_sketch_get_quantile_double("values", F.lit(q)) for c, q in quantiles.items()}}).drop("items", "values")


def rank_shares(rows: DataFrame, est: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """What part of the values lies below and up to each estimate: (keys,
    <quantile>_below, <quantile>_upto).  ``est`` has a row per key."""
    j = rows.where(F.col(value).isNotNull()).select(*keys, value).join(est.select(*keys, *quantiles), list(keys))
    return j.groupBy(*keys).agg(*[x for c in quantiles for x in (F.avg((F.col(value) < F.col(c)).cast("double")).alias(f"{c}_below"),
                                                                F.avg((F.col(value) <= F.col(c)).cast("double")).alias(f"{c}_upto"))])
