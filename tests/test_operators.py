"""Operator behaviour the fixture tables do not exercise."""

import datetime as dt

from pyspark.sql import functions as F

from wattline.operators import profiles as PR
from wattline.operators import windows as W
from wattline.streaming import monitor as MON


def test_metric_rollup_windows_and_defaults(spark):
    now = dt.datetime(2024, 1, 30, 12, 0, 0)
    pts = [("a", "Duration", now - dt.timedelta(hours=2), 10.0, 10.0, 10.0),
           ("a", "Duration", now - dt.timedelta(days=3), 99.0, 99.0, 99.0),      # ignored: a has last-24h data
           ("b", "Duration", now - dt.timedelta(days=5), 40.0, 40.0, 40.0),      # only 14-day data
           ("b", "Invocations", now - dt.timedelta(days=5), 7.0, 7.0, 7.0),
           ("c", "Duration", now - dt.timedelta(days=20), 5.0, 5.0, 5.0)]        # too old: defaults
    df = spark.createDataFrame(pts, "function_name string, metric string, ts timestamp_ntz, average double, "
                                    "maximum double, sum double")
    reqs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "function_name string")
    out = {r.function_name: r for r in PR.metric_rollup(df, reqs, F.lit(now).cast("timestamp_ntz")).collect()}
    assert out["a"].avg_duration_ms == 10.0 and out["a"].data_source == "live_aws"
    assert out["b"].avg_duration_ms == 40.0 and out["b"].invocations == 7.0
    assert out["c"].avg_duration_ms == 0.0 and out["c"].max_memory_mb == 128.0
    assert out["d"].data_source == "live_aws_no_data"


def test_lookup_with_fallback(spark):
    prof = spark.createDataFrame([("f1", 100.0, "io"), ("f2", 300.0, "cpu"), ("f3", 200.0, "io")],
                                 "function_name string, mem double, function_type string")
    fb = PR.profile_fallback(prof, ["mem"], ["function_type"])
    req = spark.createDataFrame([("f2",), ("unknown",)], "function_name string")
    got = {r.function_name: r for r in PR.lookup_with_fallback(req, prof, fb, ["mem", "function_type"]).collect()}
    assert (got["f2"].mem, got["f2"].is_fallback) == (300.0, False)
    assert (got["unknown"].mem, got["unknown"].function_type, got["unknown"].is_fallback) == (200.0, "io", True)


def test_drift_alert_tiers_and_cost(spark):
    rows = [("f", dt.datetime(2024, 1, 1, h), a, 100.0) for h, a in enumerate((105, 85, 130, 200, 40))]
    st = spark.createDataFrame(rows, "function_name string, window_start timestamp_ntz, actual_rph long, "
                                     "predicted_rph double") \
        .withColumn("deviation_pct", MON.deviation_pct(F.col("actual_rph").cast("double"), F.col("predicted_rph")))
    got = [(r.severity, r.title, r.direction, r.cost_estimate_inr)
           for r in MON.drift_alerts(st).orderBy("window_start").collect()]
    assert got == [("ok", "System Healthy", "over", None),
                   ("warning", "Mild Drift Detected", "under", None),
                   ("critical", "Significant Anomaly", "over", 720),          # 30 % of 2400
                   ("critical", "Critical Deviation", "over", 6000),          # 100 % of 6000
                   ("critical", "Critical Deviation", "under", None)]


def test_consecutive_pairs_with_gap(spark):
    df = spark.createDataFrame([(x,) for x in (1, 4, 5, 8, 11, 12, 15)], "k long")
    got = sorted((r.a, r.b) for r in W.consecutive_pairs_with_gap(df, "k", 3).collect())
    assert got == [(1, 4), (5, 8), (8, 11), (12, 15)]


def test_day_sketches_merge(spark):
    """Days merged in any order give the whole within the stated errors; small keys are exact."""
    from wattline.operators import sketches as S
    rows = spark.range(60_000).selectExpr("id % 30 day", "case when id % 10 < 9 then 'hot' else 'cold' end app", "concat('f', id % 7001) fn",
                                          "cast(pmod(xxhash64(id), 100000) as double) ms").unionByName(
        spark.createDataFrame([(1, "tiny", "x", 5.0), (2, "tiny", "x", 7.0), (2, "tiny", "y", None)], "day long, app string, fn string, ms double"))
    q = {"p50": 0.5, "p99": 0.99}
    days = S.day_sketches(rows, ["app"], "fn", "ms").persist()
    est = S.estimates(S.merged(days, ["app"]), q)
    twice = S.estimates(S.merged(S.merged(days.withColumn("h", F.col("day") % 3), ["app", "h"]), ["app"]), q)
    share = {r.app: r for r in S.rank_shares(rows, est, ["app"], "ms", q).collect()}
    other = {r.app: r for r in twice.collect()}
    for r in est.collect():
        exact = rows.where((F.col("app") == r.app) & F.col("ms").isNotNull())
        assert r.n == exact.count() == other[r.app].n
        want = exact.select("fn").distinct().count()
        assert abs(r.distinct_est - want) <= want * S.DISTINCT_ERROR + 1 and abs(other[r.app].distinct_est - want) <= want * S.DISTINCT_ERROR + 1
        for c, p in q.items():
            assert share[r.app][f"{c}_below"] <= p + S.RANK_ERROR and share[r.app][f"{c}_upto"] >= p - S.RANK_ERROR
    assert other["tiny"].distinct_est == 1 and other["tiny"].p99 == 7.0
    days.unpersist()
