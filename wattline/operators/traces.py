"""Multi-day cloud trace aggregation (durations, app memory, invocations).

Aggregations are declared per day first and across days second: the mean
of daily means is semantic (each day counts once) and Catalyst cannot fold
it.  Both steps run partial aggregation before their shuffle, so a function
that dominates the trace is pre-reduced on every task and never lands as
raw rows on one reducer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.config import DEFAULT_MODEL, EnergyModel
from wattline.operators import projections as P
from wattline.operators.quantiles import grouped_percentiles


def two_level(df: DataFrame, keys: Sequence[str], day: str, spec: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``spec``: output -> (input column, "mean" | "sum").  Per (keys, day) the
    input is reduced by the named function, then across days again."""
    fn = {"mean": F.avg, "sum": F.sum}
    daily = df.groupBy(*keys, day).agg(*[fn[how](src).alias(out) for out, (src, how) in spec.items()])
    return daily.groupBy(*keys).agg(*[fn[how](out).alias(out) for out, (_, how) in spec.items()])


DURATION_SPEC = {
    "avg_duration_ms": ("average", "mean"), "invocation_count": ("cnt", "sum"),
    "min_duration_ms": ("minimum", "mean"), "max_duration_ms": ("maximum", "mean"),
    "p50_duration_ms": ("p50", "mean"), "p99_duration_ms": ("p99", "mean"),
}


def duration_summary(fn_day: DataFrame, min_invocations: int | None = 10) -> DataFrame:
    """Per (function, app): two-level duration statistics, optionally keeping
    functions with at least ``min_invocations`` calls over all days."""
    have = set(fn_day.columns)      # percentile columns are reduced only where the input has them
    out = two_level(fn_day, ["hash_function", "hash_app"], "day", {k: v for k, v in DURATION_SPEC.items() if v[0] in have})
    return out if min_invocations is None else P.min_count(out, "invocation_count", min_invocations)


MEMORY_SPEC = {"memory_allocated_mb": ("avg_mb", "mean"), "memory_p50_mb": ("p50_mb", "mean"), "memory_p99_mb": ("p99_mb", "mean")}


def memory_summary(app_day: DataFrame) -> DataFrame:
    """Two-level mean, median and 99th percentile of an app's memory."""
    return two_level(app_day, ["hash_app"], "day", MEMORY_SPEC)


def row_sum(cols: Sequence[str]) -> Column:
    """Sum across columns, nulls skipped, all-null -> 0: one array expression
    rather than a chain of additions (stays small for 1440 columns)."""
    return F.aggregate(F.array(*[F.col(c).cast("double") for c in cols]), F.lit(0.0),
                       lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def present_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    have = set(df.columns)
    return [c for c in wanted if c in have]


def invocation_summary(minutes: DataFrame, minute_cols: Sequence[str]) -> DataFrame:
    """Per function: mean daily invocation count and the trigger of its
    first day that has one (first by (day, trigger) order, so the result does
    not depend on file order)."""
    cols = present_columns(minutes, minute_cols)
    daily = minutes.select("hash_function", "trigger_type", "day", row_sum(cols).alias("daily_invocations"))
    return (daily.groupBy("hash_function")
            .agg(F.avg("daily_invocations").alias("daily_invocations"),
                 F.min_by("trigger_type", F.when(F.col("trigger_type").isNotNull(), F.struct("day", "trigger_type"))).alias("trigger_type")))


def trace_master(fn_day: DataFrame, app_day: DataFrame, minutes: DataFrame, minute_cols: Sequence[str],
                 m: EnergyModel = DEFAULT_MODEL) -> DataFrame:
    """Durations x invocations on the function, x app memory on the app,
    then validity filters and caps.  Joins are equi-joins on aggregated
    tables; AQE chooses broadcast when a side is small at run time and
    splits skewed partitions otherwise."""
    dur = duration_summary(fn_day, m.min_invocations)
    inv = invocation_summary(minutes, minute_cols)
    mem = memory_summary(app_day)
    master = dur.join(inv, "hash_function", "inner").join(mem, "hash_app", "inner")
    return P.valid_caps(master, "memory_allocated_mb", "avg_duration_ms", m.memory_cap_mb, m.duration_cap_ms)


def region_function_summary(inv: DataFrame, function="function_name", latency="latency_ms",
                            memory="memory_mb", runtime="runtime", order=("ts", "inv_id"),
                            min_invocations: int = 10, memory_cap: float = 3072.0,
                            duration_cap: float = 300_000.0, percentiles: bool = True) -> DataFrame:
    """Per function over raw invocation rows: mean / min / max / exact median
    and p99 latency, count, mean memory and first runtime; then the count and
    cap filters.  Percentiles use the range-partitioned exact method; without
    them no raw row is shuffled."""
    valid = inv.where((F.col(latency) > 0) & (F.col(memory) > 0))
    summary = [F.avg(latency).alias("avg_duration_ms"), F.min(latency).alias("min_duration_ms"),
               F.max(latency).alias("max_duration_ms"), F.count(F.lit(1)).alias("invocation_count"),
               F.avg(memory).alias("memory_allocated_mb"), F.min_by(runtime, F.struct(*order)).alias("runtime")]
    if percentiles:
        out = grouped_percentiles(valid, [function], latency, {"p50_duration_ms": 0.5, "p99_duration_ms": 0.99},
                                  extra_aggs=summary)
    else:
        out = valid.groupBy(function).agg(*summary)
    return out.where((F.col("invocation_count") >= min_invocations)
                     & (F.col("memory_allocated_mb") <= memory_cap) & (F.col("avg_duration_ms") <= duration_cap))


def value_share(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Count and percentage per category, largest first (ties by value).
    Rows without a category are in the total, but are no category.
    The total is the sum of the counts, a one-row aggregate joined by
    broadcast (size 1: bounded);
    ``top`` uses ordered take (per-task top-k, then a merge)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))      # from the counts: no second pass over df
    out = (counts.where(F.col(col).isNotNull()).crossJoin(F.broadcast(total))
           .select(col, "n", (F.col("n") * 100.0 / F.col("_total")).alias("pct")))
    if top is not None:
        out = out.orderBy(F.desc("n"), F.asc(col)).limit(top)
    return out
