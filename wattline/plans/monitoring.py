"""Streaming monitors run as catch-up jobs over the landed event files
(SURVEY 2.9).  Each query runs the Structured Streaming job to completion
(``availableNow``) and returns the table it produced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions import rounding as R
from wattline.plans.registry import register
from wattline.sources.tables import Catalog
from wattline.streaming import monitor as MON


def r9(c: str):
    return R.half_up(c, 9).alias(c)


def hourly(cat: Catalog) -> DataFrame:
    return MON.hourly_traffic_table(cat.spark, cat.sf_dir)


@register("str_hourly_traffic")
def str_hourly_traffic(cat: Catalog) -> DataFrame:
    return hourly(cat)


def earlier(cat: Catalog) -> DataFrame:
    """The forecast of what came before the middle of the covered time."""
    e = cat.events
    return MON.forecast_from_history(e.join(F.broadcast(MON.forecast_cut(e)), F.col("ts") < F.col("cut")).drop("cut"))


def judged(cat: Catalog, hours: DataFrame) -> DataFrame:
    return hours.join(F.broadcast(MON.forecast_cut(cat.events)), F.col("window_start") >= F.col("cut")).drop("cut")


def status(cat: Catalog) -> DataFrame:
    return MON.drift_status(judged(cat, hourly(cat)), earlier(cat))


@register("str_drift_status")
def str_drift_status(cat: Catalog) -> DataFrame:
    s = status(cat)
    return s.select("function_name", "window_start", "actual_rph", r9("predicted_rph"), r9("deviation_pct"), "status")


@register("str_drift_alerts")
def str_drift_alerts(cat: Catalog) -> DataFrame:
    a = MON.drift_alerts(status(cat))
    return a.select("function_name", "window_start", r9("deviation_pct"), "severity", "title", "headline", "direction",
                    "cost_estimate_inr", "saving_estimate_inr", "detail", "advice")


@register("str_live_history")
def str_live_history(cat: Catalog) -> DataFrame:
    return MON.live_history_table(cat.spark, cat.sf_dir, 12)


@register("str_alert_stream")
def str_alert_stream(cat: Catalog) -> DataFrame:
    """Alerts from inside the stream: hours in which a function's tier changes."""
    a = MON.run_alerts(cat.spark, cat.sf_dir, MON.forecast_versions(cat.events))
    return a.select("function_name", "window_start", "actual_rph", r9("predicted_rph"), r9("deviation_pct"), "tier", "last_tier")


@register("str_gap_stream")
def str_gap_stream(cat: Catalog) -> DataFrame:
    """Live energy per call in the second half of the covered time against
    each function's mean before it (``str_gap_model`` has the model's)."""
    cut = F.broadcast(MON.forecast_cut(cat.events))
    energy = (F.lit(10.0) + F.lit(0.2) * (F.col("user_id") * 10.0)) * F.col("value") / F.lit(3600000.0)
    hist = cat.events.join(cut, F.col("ts") < F.col("cut")).select(F.concat(F.lit("fn-"), F.col("event_type")).alias("function_name"), energy.alias("e"))
    ref = hist.groupBy("function_name").agg(F.avg("e").alias("predicted_wh"))
    live = MON.event_stream(cat.spark, cat.sf_dir).join(cut, F.col("ts").cast("timestamp_ntz") >= F.col("cut")).drop("cut")
    out = MON.run_append_parquet(MON.gap_stream(live, ref), "gap_stream")
    d = cat.spark.read.parquet(out)
    return d.select("event_id", "function_name", "actual_wh", r9("predicted_wh"), r9("gap_accuracy_pct"), "gap_verdict")


@register("join_forecast_actual")
def join_forecast_actual(cat: Catalog) -> DataFrame:
    """Batch form: actual requests per function-hour next to the forecast."""
    e = cat.events
    hourly_b = (e.groupBy(F.concat(F.lit("fn-"), F.col("event_type")).alias("function_name"),
                          F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start"))
                .agg(F.count(F.lit(1)).alias("actual_rph")))
    return judged(cat, hourly_b).join(earlier(cat), "function_name", "inner") \
        .select("function_name", "window_start", "actual_rph", r9("predicted_rph"))
