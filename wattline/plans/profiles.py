"""Telemetry, profiles, lookups, overrides, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions import rounding as R

from wattline.operators import profiles as PR
from wattline.operators import projections as P
from wattline.plans.registry import register
from wattline.plans.rowwise import part_function_names
from wattline.sources.tables import Catalog

FALLBACK_NUMERIC = ("memory_config_mb", "aws_duration_ms", "lines_of_code", "cyclomatic_complexity",
                    "local_cpu_percent")
CATEGORICAL = ("function_type", "input_size")
#: Profile columns and the live values that override them.
LIVE_COLUMNS = {"aws_duration_ms": "live_duration_ms", "memory_config_mb": "live_memory_mb", "aws_memory_used_mb": "live_memory_mb"}


def telemetry(cat: Catalog) -> DataFrame:
    """The compiled telemetry table: invocations, metrics of the source of
    document ``<doc_id>`` as the code of function ``fn-<doc_id>``, derived
    columns."""
    return PR.compile_telemetry(cat.v_inv, function_code(cat))


def function_code(cat: Catalog) -> DataFrame:
    return PR.parsed_code_metrics(cat.v_source, F.concat(F.lit("fn-"), F.col("path")), "content")


def profile(cat: Catalog, materialized: bool = False) -> DataFrame:
    """Function profile; ``materialized`` checkpoints it for plans that read
    it several times (lookup + fallback medians + fallback modes)."""
    p = PR.profile_from_parts(cat.v_inv, function_code(cat))
    if materialized:
        from wattline.session import materialize
        p = materialize(p)
    return p


def lookup_requests(cat: Catalog) -> DataFrame:
    """Requested names: one per customer key (known functions) plus the
    live-traffic names (unknown to the profile: fallback path)."""
    known = cat.customer.select(F.concat(F.lit("fn-"), F.col("c_custkey").cast("string")).alias("function_name"))
    return known.unionByName(cat.v_live.select("function_name")).distinct()


def r9(c: str):
    return R.half_up(c, 9).alias(c)


@register("ml_compile_dataset")
def ml_compile_dataset(cat: Catalog) -> DataFrame:
    t = telemetry(cat)
    return t.select(*[r9(c) if dict(t.dtypes)[c] == "double" else F.col(c) for c in t.columns])


@register("src_function_inventory")
def src_function_inventory(cat: Catalog) -> DataFrame:
    """Inventory rows with two alternative name keys; unnamed rows dropped,
    runtime and memory defaults filled."""
    p = part_function_names(cat, keep=("p_size",))
    raw = p.select(
        "p_partkey",
        F.when(F.col("p_size") % 3 != 0, F.col("name")).alias("FunctionName"),
        F.when((F.col("p_size") % 3 == 0) & (F.col("p_size") % 2 == 0), F.col("name")).alias("function_name"),
        F.when(F.col("p_size") % 4 != 0, F.element_at(F.array(*[F.lit(x) for x in
               ("python3.9", "nodejs14", "java11", "php7", "go1")]), (F.col("p_partkey") % 5 + 1).cast("int")))
        .alias("Runtime"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 64).alias("MemorySize"))
    out = raw.select("p_partkey", F.coalesce("FunctionName", "function_name").alias("function_name"),
                     F.coalesce("Runtime", F.lit("python3.9")).alias("runtime"),
                     F.coalesce("MemorySize", F.lit(128)).alias("memory_mb"))
    return out.where(F.col("function_name").isNotNull() & (F.col("function_name") != ""))


def live_points(cat: Catalog) -> DataFrame:
    live = cat.v_live.withColumn("is_error", (F.col("function_name") == "fn-error").cast("int"))   # the name is the event type
    return PR.hourly_points(live)


@register("src_metric_points")
def src_metric_points(cat: Catalog) -> DataFrame:
    pts = live_points(cat)
    return pts.where((F.col("metric") == "Duration")
                     & F.col("ts").between(F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"),
                                           F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))) \
        .select("function_name", "metric", "ts", r9("average"), r9("maximum"), r9("sum"))


@register("agg_metric_rollup")
def agg_metric_rollup(cat: Catalog) -> DataFrame:
    now_df = cat.events.agg((F.max("ts") + F.expr("INTERVAL 12 HOURS")).alias("now"))
    pts = live_points(cat).crossJoin(F.broadcast(now_df))
    reqs = cat.v_live.select("function_name").unionByName(
        cat.region.select(F.concat(F.lit("fn-"), F.lower("r_name")).alias("function_name")))
    out = PR.metric_rollup(pts, reqs, F.col("now"))
    return out.select("function_name", r9("avg_duration_ms"), "max_memory_mb", "invocations", "errors", "data_source")


@register("agg_function_profile")
def agg_function_profile(cat: Catalog) -> DataFrame:
    return profile(cat).select("function_name", *[r9(c) for c in PR.TELEMETRY_NUMERIC])


@register("agg_mode")
def agg_mode(cat: Catalog) -> DataFrame:
    return PR.grouped_mode(PR.invocation_telemetry(cat.v_inv), ["function_name"], "input_size")


@register("join_profile_modes")
def join_profile_modes(cat: Catalog) -> DataFrame:
    p = profile(cat)
    return p.select("function_name", *CATEGORICAL, *[r9(c) for c in FALLBACK_NUMERIC])


@register("agg_median_fallback")
def agg_median_fallback(cat: Catalog) -> DataFrame:
    f = PR.profile_fallback(profile(cat, materialized=True), FALLBACK_NUMERIC, CATEGORICAL)
    return f.select(*[r9(c) for c in FALLBACK_NUMERIC], *CATEGORICAL)


@register("join_lookup_fallback")
def join_lookup_fallback(cat: Catalog) -> DataFrame:
    prof = profile(cat, materialized=True)
    fb = PR.profile_fallback(prof, FALLBACK_NUMERIC, CATEGORICAL)
    out = PR.lookup_with_fallback(lookup_requests(cat), prof, fb, [*FALLBACK_NUMERIC, *CATEGORICAL])
    return out.select("function_name", *[r9(c) for c in FALLBACK_NUMERIC], *CATEGORICAL, "is_fallback")


def live_by_user(cat: Catalog) -> DataFrame:
    """Live duration and memory of function ``fn-<user_id>``."""
    return (cat.v_live.groupBy(F.concat(F.lit("fn-"), F.col("user_id").cast("string")).alias("function_name"))
            .agg((F.avg("duration_ms") * 100).alias("live_duration_ms"), (F.max("user_id") * 10.0).alias("live_memory_mb")))


@register("join_live_override")
def join_live_override(cat: Catalog) -> DataFrame:
    """Profile values replaced by live values (> 0) where a function has live
    traffic (function ``fn-<user_id>``)."""
    prof = profile(cat).select("function_name", "aws_duration_ms", "memory_config_mb", "aws_memory_used_mb")
    out = PR.live_override(prof, live_by_user(cat), LIVE_COLUMNS)
    return out.select("function_name", r9("aws_duration_ms"), r9("memory_config_mb"), r9("aws_memory_used_mb"))


@register("prj_monthly_projection_profile")
def prj_monthly_projection_profile(cat: Catalog) -> DataFrame:
    """Monthly projection from the profile table (energy = target mean)."""
    p = profile(cat)
    out = P.monthly_projection(p, "energy_target_wh", "memory_config_mb", "aws_duration_ms")
    return out.select("function_name", "energy_wh_per_invocation", "monthly_invocations", "monthly_carbon_kg",
                      "monthly_cost_inr")
