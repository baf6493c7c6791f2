"""Metric, verdict, distribution and summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions import rounding as R

from wattline.config import DEFAULT_MODEL
from wattline.functions import energy as E
from wattline.operators import metrics as M
from wattline.operators import projections as P
from wattline.operators import traces as T
from wattline.operators.sampling import seeded_sample
from wattline.plans.registry import register
from wattline.plans.traces import MINUTE_COLS
from wattline.sources.tables import Catalog


def r9(c: str):
    return R.half_up(c, 9).alias(c)


def azure_like(cat: Catalog) -> DataFrame:
    """Trace master scored with a stand-in (median-duration) prediction."""
    m = T.trace_master(cat.v_fn_day, cat.v_app_day, cat.v_fn_minutes, MINUTE_COLS)
    return m.select("hash_function", "trigger_type", "memory_allocated_mb", "avg_duration_ms", "invocation_count",
                    E.energy_wh("memory_allocated_mb", "avg_duration_ms").alias("actual_wh"),
                    E.energy_wh("memory_allocated_mb", "p50_duration_ms").alias("predicted_wh"))


def alibaba_like(cat: Catalog) -> DataFrame:
    s = T.region_function_summary(cat.v_inv)
    return s.select("function_name", "runtime",
                    E.energy_wh("memory_allocated_mb", "avg_duration_ms").alias("actual_wh"),
                    E.energy_wh("memory_allocated_mb", "p50_duration_ms").alias("predicted_wh"))


@register("agg_regression_metrics")
def agg_regression_metrics(cat: Catalog) -> DataFrame:
    return M.regression_metrics(cat.v_pred)


@register("agg_metrics_by_trigger")
def agg_metrics_by_trigger(cat: Catalog) -> DataFrame:
    return M.metrics_by(cat.v_pred, "trigger_type", ["http", "timer", "queue", "storage"], "trigger_type")


@register("agg_metrics_by_runtime")
def agg_metrics_by_runtime(cat: Catalog) -> DataFrame:
    return M.metrics_by(cat.v_pred, P.runtime_category(F.col("runtime")), ["python", "nodejs", "java", "php"],
                        "runtime_category")


@register("agg_metrics_by_tier")
def agg_metrics_by_tier(cat: Catalog) -> DataFrame:
    return M.metrics_by(cat.v_pred, "memory_mb",
                        list(DEFAULT_MODEL.memory_tiers), "memory_tier", others=None)


@register("agg_metrics_by_bucket")
def agg_metrics_by_bucket(cat: Catalog) -> DataFrame:
    b = P.duration_bucket(F.col("latency_ms") * F.col("quantity"))
    return M.metrics_by(cat.v_pred, b, [x[2] for x in P.DURATION_BUCKETS], "duration_bucket",
                        others=None, keep_empty=False)


@register("agg_transfer_verdict")
def agg_transfer_verdict(cat: Catalog) -> DataFrame:
    m = M.regression_metrics(azure_like(cat))
    return m.withColumn("verdict", M.transfer_verdict(F.col("r2")))


@register("agg_platform_compare")
def agg_platform_compare(cat: Catalog) -> DataFrame:
    parts = [M.regression_metrics(df).withColumn("platform", F.lit(name))
             for name, df in (("aws", cat.v_pred), ("azure", azure_like(cat)), ("alibaba", alibaba_like(cat)))]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    long = u.unpivot(["platform"], ["r2", "mae", "rmse", "mape", "accuracy"], "metric", "value")
    return long.groupBy("metric").pivot("platform", ["aws", "azure", "alibaba"]).agg(F.first("value"))


@register("agg_ape_distribution")
def agg_ape_distribution(cat: Catalog) -> DataFrame:
    d = M.ape_distribution(cat.v_pred)
    return d.select(*[r9(c) for c in d.columns])


@register("agg_histogram")
def agg_histogram(cat: Catalog) -> DataFrame:
    return M.fixed_width_histogram(cat.v_pred, M.ape(), 1.0, 50)


@register("agg_histogram_equal")
def agg_histogram_equal(cat: Catalog) -> DataFrame:
    return M.equal_bins_histogram(cat.v_pred, "actual_wh", 10)


@register("agg_box_stats")
def agg_box_stats(cat: Catalog) -> DataFrame:
    b = M.box_stats(cat.v_pred, ["memory_mb", "cold_start"], "actual_wh")
    return b.select("memory_mb", "cold_start", *[r9(c) for c in ("q1", "median", "q3")],
                    "whisker_low", "whisker_high", "outliers", "n")


CORR_FEATURES = ["memory_mb", "latency_ms", "cold_start", "quantity", "discount", "tax"]


@register("agg_correlation")
def agg_correlation(cat: Catalog) -> DataFrame:
    c = M.correlation_with(cat.v_pred, "actual_wh", CORR_FEATURES)
    return c.select("feature", r9("corr"), "rank_desc", "rank_asc")


@register("agg_describe")
def agg_describe(cat: Catalog) -> DataFrame:
    v = cat.v_pred.withColumn("dataset", F.when(F.col("day") <= 1995, "old").otherwise("new"))
    d = M.describe(v, ["dataset"], ["latency_ms", "memory_mb", "actual_wh"])
    return d.select("dataset", "column", "count", "min", "max", *[r9(c) for c in ("mean", "std", "median")])


@register("agg_flag_share")
def agg_flag_share(cat: Catalog) -> DataFrame:
    return (cat.v_inv.groupBy("runtime")
            .agg(R.half_up(F.avg("cold_start") * 100.0, 9).alias("cold_start_pct"),
                 F.count(F.lit(1)).alias("n")))


@register("agg_cost_total")
def agg_cost_total(cat: Catalog) -> DataFrame:
    m = DEFAULT_MODEL
    gb = E.gb_seconds("memory_mb", "latency_ms")
    t = cat.v_inv.groupBy("runtime").agg(F.sum(gb).alias("gb_seconds"), F.count(F.lit(1)).alias("requests"))
    comp = F.col("gb_seconds") * m.usd_per_gb_s
    req = F.col("requests") * m.usd_per_request
    return t.select("runtime", "requests", R.half_up("gb_seconds", 6).alias("gb_seconds"),
                    R.half_up(comp, 6).alias("compute_usd"), R.half_up(req, 6).alias("request_usd"),
                    R.half_up(comp + req, 6).alias("total_usd"))


@register("agg_pivot_distinct")
def agg_pivot_distinct(cat: Catalog) -> DataFrame:
    tiers = list(DEFAULT_MODEL.memory_tiers)
    return (cat.v_inv.groupBy("trigger_type").pivot("memory_mb", tiers)
            .agg(F.countDistinct("function_name")).na.fill(0))


@register("agg_argmax_row")
def agg_argmax_row(cat: Catalog) -> DataFrame:
    v = cat.v_pred
    best = v.agg(F.max_by(F.struct("inv_id", "function_name", "predicted_wh"),
                          F.struct("predicted_wh", "inv_id")).alias("b"))
    return best.select("b.inv_id", "b.function_name", "b.predicted_wh")


@register("agg_scatter_points")
def agg_scatter_points(cat: Catalog) -> DataFrame:
    """60 seeded points (actual, predicted) with R2 and MAE over them."""
    pts = seeded_sample(cat.v_pred, "inv_id", 60, seed=42).select("inv_id", "actual_wh", "predicted_wh")
    m = M.regression_metrics(pts, digits=None).select(R.half_up("r2", 4).alias("r2"), R.half_up("mae", 4).alias("mae"))
    return pts.crossJoin(F.broadcast(m))


@register("agg_correlation_matrix")
def agg_correlation_matrix(cat: Catalog) -> DataFrame:
    m = M.correlation_matrix(cat.v_pred, [*CORR_FEATURES, "actual_wh"])
    return m.select("a", "b", r9("corr"))
