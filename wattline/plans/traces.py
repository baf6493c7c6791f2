"""Trace aggregation, joins and the trace master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions import rounding as R

from wattline.functions import energy as E
from wattline.operators import traces as T
from wattline.plans.registry import register
from wattline.sources.tables import Catalog

# Twelve month columns stand for the 1440 minute columns of a daily file;
# the wanted list is longer than what is present, as in real files.
MINUTE_COLS = [f"m{i}" for i in range(1, 25)]


def r9(c: str):
    return R.half_up(c, 9).alias(c)


def master(cat: Catalog) -> DataFrame:
    return T.trace_master(cat.v_fn_day, cat.v_app_day, cat.v_fn_minutes, MINUTE_COLS)


def basic_master(cat: Catalog) -> DataFrame:
    """The master table for reports that need no duration percentiles."""
    return T.trace_master(cat.v_fn_day_basic, cat.v_app_day, cat.v_fn_minutes, MINUTE_COLS)


@register("src_minute_wide")
def src_minute_wide(cat: Catalog) -> DataFrame:
    m = cat.v_fn_minutes
    return m.select("hash_function", "trigger_type", "day", *T.present_columns(m, MINUTE_COLS))


@register("agg_row_sum_minutes")
def agg_row_sum_minutes(cat: Catalog) -> DataFrame:
    m = cat.v_fn_minutes
    return m.select("hash_function", "trigger_type", "day",
                    T.row_sum(T.present_columns(m, MINUTE_COLS)).alias("daily_invocations"))


@register("agg_invocations")
def agg_invocations(cat: Catalog) -> DataFrame:
    return T.invocation_summary(cat.v_fn_minutes, MINUTE_COLS).select(
        "hash_function", r9("daily_invocations"), "trigger_type")


_DUR_OUT = ["avg_duration_ms", "min_duration_ms", "max_duration_ms", "p50_duration_ms", "p99_duration_ms"]


@register("agg_two_level_duration")
def agg_two_level_duration(cat: Catalog) -> DataFrame:
    d = T.duration_summary(cat.v_fn_day, None)
    return d.select("hash_function", "hash_app", "invocation_count", *[r9(c) for c in _DUR_OUT])


@register("agg_two_level_memory")
def agg_two_level_memory(cat: Catalog) -> DataFrame:
    return T.memory_summary(cat.v_app_day).select("hash_app", r9("memory_allocated_mb"), r9("memory_p50_mb"), r9("memory_p99_mb"))


@register("agg_distinct_counts")
def agg_distinct_counts(cat: Catalog) -> DataFrame:
    """Distinct functions overall, and the sum of per-day distinct counts
    (the "raw unique" figure, which counts a function once per day)."""
    d = cat.v_fn_day_basic
    per_day = d.groupBy("day").agg(F.countDistinct("hash_function").alias("n"))
    overall = d.agg(F.countDistinct("hash_function").alias("distinct_functions"))
    return overall.crossJoin(per_day.agg(F.sum("n").alias("raw_unique_sum")))


@register("agg_day_sketches")
def agg_day_sketches(cat: Catalog) -> DataFrame:
    """Days as stored sketches, merged per app: the calls, the exact number of
    functions, and whether the merged estimates of functions and of the median
    and 99th percentile duration keep the stated errors."""
    import uuid

    from wattline.operators import sketches as S
    from wattline.session import checkpoint_dir
    folder = f"{checkpoint_dir(cat.spark).rstrip('/')}/sketches/{uuid.uuid4().hex[:12]}"
    S.day_sketches(cat.v_inv, ["app_id"], "function_name", "latency_ms").write.parquet(folder)
    q = {"p50": 0.5, "p99": 0.99}
    est = S.estimates(S.merged(cat.spark.read.parquet(folder), ["app_id"]), q)
    exact = cat.v_inv.groupBy("app_id").agg(F.countDistinct("function_name").alias("functions"))
    j = est.join(exact, "app_id").join(S.rank_shares(cat.v_inv, est, ["app_id"], "latency_ms", q), "app_id")
    kept = lambda c: ((F.col(f"{c}_below") <= q[c] + S.RANK_ERROR) & (F.col(f"{c}_upto") >= q[c] - S.RANK_ERROR)).alias(f"{c}_kept")
    near = F.abs(F.col("distinct_est") - F.col("functions")) <= F.col("functions") * S.DISTINCT_ERROR + 1
    return j.select("app_id", "n", "functions", near.alias("functions_kept"), kept("p50"), kept("p99"))


@register("join_duration_invocations")
def join_duration_invocations(cat: Catalog) -> DataFrame:
    dur = T.duration_summary(cat.v_fn_day_basic)
    inv = T.invocation_summary(cat.v_fn_minutes, MINUTE_COLS)
    return dur.join(inv, "hash_function", "inner").select(
        "hash_function", "hash_app", "invocation_count", r9("avg_duration_ms"), r9("daily_invocations"), "trigger_type")


@register("join_function_memory")
def join_function_memory(cat: Catalog) -> DataFrame:
    dur = T.duration_summary(cat.v_fn_day_basic)
    return dur.join(T.memory_summary(cat.v_app_day), "hash_app", "inner").select(
        "hash_function", "hash_app", r9("avg_duration_ms"), r9("memory_allocated_mb"))


_MASTER_COLS = ["hash_function", "hash_app", "invocation_count", "trigger_type"]


@register("trace_master")
def trace_master_q(cat: Catalog) -> DataFrame:
    m = master(cat)
    return m.select(*_MASTER_COLS, *[r9(c) for c in _DUR_OUT], r9("daily_invocations"), r9("memory_allocated_mb"),
                    r9("memory_p50_mb"), r9("memory_p99_mb"))


@register("trace_energy_top_functions")
def trace_energy_top_functions(cat: Catalog) -> DataFrame:
    """Flagship: functions with the highest energy per call, top 20."""
    m = basic_master(cat).withColumn("energy_wh", E.energy_wh("memory_allocated_mb", "avg_duration_ms"))
    top = m.orderBy(F.desc("energy_wh"), F.asc("hash_function"), F.asc("hash_app")).limit(20)
    return top.select("hash_function", "hash_app", "trigger_type", r9("avg_duration_ms"), r9("memory_allocated_mb"),
                      R.half_up("energy_wh", 9).alias("energy_wh"),
                      R.half_up(F.col("energy_wh") * 1000.0, 6).alias("energy_mwh"))


@register("agg_trace_functions")
def agg_trace_functions(cat: Catalog) -> DataFrame:
    s = T.region_function_summary(cat.v_inv)
    return s.select("function_name", "invocation_count", "runtime", "min_duration_ms", "max_duration_ms",
                    r9("avg_duration_ms"), r9("p50_duration_ms"), r9("p99_duration_ms"), r9("memory_allocated_mb"))


@register("agg_value_share")
def agg_value_share(cat: Catalog) -> DataFrame:
    return T.value_share(basic_master(cat), "trigger_type").select("trigger_type", "n", r9("pct"))


@register("agg_value_share_top")
def agg_value_share_top(cat: Catalog) -> DataFrame:
    return T.value_share(cat.v_inv, "runtime", top=3).select("runtime", "n", r9("pct"))
