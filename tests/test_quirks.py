"""Hand-made frames for the semantic quirks."""

import pytest
from pyspark.sql import functions as F

from wattline.operators import metrics as M
from wattline.operators import projections as P
from wattline.operators import traces as T
from wattline.operators.profiles import grouped_mode
from wattline.operators.quantiles import grouped_percentiles
from wattline.operators.sampling import stratified_sample


def test_r2_can_be_negative_and_one_row_group_is_zero(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, -1.0), (3.0, 9.0)], "actual_wh double, predicted_wh double")
    r = M.regression_metrics(df).first()
    assert r.r2 < 0
    one = spark.createDataFrame([(1.0, 3.0)], "actual_wh double, predicted_wh double")
    assert M.regression_metrics(one).first().r2 == 0.0


def test_empty_category_gets_zero_row(spark):
    df = spark.createDataFrame([("http", 1.0, 1.0)], "trigger_type string, actual_wh double, predicted_wh double")
    rows = {r.trigger_type: r for r in M.metrics_by(df, "trigger_type", ["http", "timer"], "trigger_type").collect()}
    assert rows["timer"].n == 0 and rows["timer"].mape == 0.0
    assert rows["others"].n == 0


def test_zero_actual_uses_floor_and_accuracy_floored(spark):
    df = spark.createDataFrame([(0.0, 1e-9), (2.0, 1.0), (1.0, 3.0)], "actual_wh double, predicted_wh double")
    out = P.error_columns(df).collect()
    assert abs(out[0].percentage_error - 100.0) < 1e-9      # |0 - 1e-9| / 1e-9
    assert out[1].accuracy_pct == 50.0                      # APE exactly 50
    assert out[2].accuracy_pct == 0.0                       # floored at 0 in batch
    g = P.gap_verdict(df).collect()
    assert g[2].gap_accuracy_pct < 0                        # online accuracy may go negative


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("f", "b"), ("f", "a"), ("f", "b"), ("f", "a"), ("g", "z")], "k string, v string")
    got = {r.k: r.v for r in grouped_mode(df, ["k"], "v").collect()}
    assert got == {"f": "a", "g": "z"}


def test_name_without_dash_has_empty_category(spark):
    df = spark.createDataFrame([("hello",), ("etl-transform-10",)], "n string")
    got = [r.c for r in df.select(P.name_category(F.col("n")).alias("c")).collect()]
    assert got == ["", "etl-transform"]


def test_duration_bucket_edges_left_closed(spark):
    df = spark.createDataFrame([(999.0,), (1000.0,), (10000.0,), (67000.0,)], "d double")
    got = [r.b for r in df.select(P.duration_bucket(F.col("d")).alias("b")).collect()]
    assert got == ["<1s", "1-10s", "10-30s", ">67s"]


def test_caps_inclusive_and_floor(spark):
    df = spark.createDataFrame([(1500.0, 300000.0), (1500.1, 10.0), (None, 5.0), (0.0, 1.0)],
                               "memory_allocated_mb double, avg_duration_ms double")
    assert P.valid_caps(df).count() == 1
    p = spark.createDataFrame([(0.0,), (-1.0,), (None,)], "p double")
    got = [r.f for r in p.select(P.E.floor_prediction("p", 0.0001).alias("f")).collect()]
    assert got == [0.0001, 0.0001, None]


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(0.0,), (49.99,), (50.0,), (80.0,)], "x double")
    got = {r.bin: r.n for r in M.fixed_width_histogram(df, F.col("x"), 1.0, 50).collect()}
    assert got == {0: 1, 49: 3}


def test_mean_of_daily_means_is_not_flattened(spark):
    df = spark.createDataFrame([("f", 1, 10.0), ("f", 1, 20.0), ("f", 1, 30.0), ("f", 2, 100.0)],
                               "k string, day int, v double")
    r = T.two_level(df, ["k"], "day", {"m": ("v", "mean")}).first()
    assert r.m == 60.0      # (20 + 100) / 2, not 160 / 4


def skewed(spark, n):
    """A hot key, a hot value in it, a hot null key, a constant and small groups."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 3 == 1, F.lit(None)).when(i % 999 == 2, "one").otherwise(F.concat(F.lit("k"), i % 500))
    v = (F.when((i % 3 == 0) & (i % 2 == 0), F.lit(17.25)).when(i % 999 == 2, F.lit(3.0)).when(i % 7 == 0, -F.sqrt(i.cast("double")))
         .otherwise(F.pow((i * 7919 % 100003) / 100.0, 1.5)))
    return spark.range(n).select(key.alias("k"), F.when(i % 101 != 5, v).alias("v"))


@pytest.mark.parametrize("parts", [3, 16, 64])
@pytest.mark.parametrize("reuse", ["true", "false"])
def test_percentiles_equal_builtin_under_skew(spark, parts, reuse):
    probs = {"p25": 0.25, "p50": 0.5, "p99": 0.99}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = skewed(spark, 600_000).repartition(parts)
        got = grouped_percentiles(df, ["k"], "v", probs, extra_aggs=[F.count("*").alias("n")])
        want = df.where("v is not null").groupBy("k").agg(*[F.percentile("v", p).alias(f"w_{n}") for n, p in probs.items()], F.count("*").alias("w_n"))
        j = got.join(want.withColumnRenamed("k", "wk"), F.col("k").eqNullSafe(F.col("wk")), "full")
        bad = j.where("n is null or w_n is null or n != w_n or " + " or ".join(f"abs({n} - w_{n}) > 1e-9 * (1 + abs(w_{n}))" for n in probs))
        assert bad.count() == 0 and j.count() == want.count() > 100
        one = grouped_percentiles(df, [], "v", probs).first()
        assert [one[n] for n in probs] == [pytest.approx(x) for x in df.agg(*[F.percentile("v", p) for p in probs.values()]).first()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_percentiles_edge_values(spark):
    rows = [("a", x) for x in (0.0, -0.0, 1e-9, -1e-9, 1e300, -1e300, float("inf"), float("nan"), None)] + [("b", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = grouped_percentiles(df, ["k"], "v", {"lo": 0.0, "mid": 3 / 7, "hi": 6 / 7}).collect()
    assert [r["k"] for r in got] == ["a"] and got[0]["lo"] == -1e300 and got[0]["mid"] == 0.0 and got[0]["hi"] == float("inf")


def test_percentile_plan_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "plan-only")
    try:
        grouped_percentiles(spark.range(10).selectExpr("id % 2 k", "double(id) v"), ["k"], "v", {"m": 0.5})
        assert list(tracker.getJobIdsForGroup("plan-only")) == []
    finally:
        spark.sparkContext.setJobGroup("", "")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_small_groups_are_dealt_once(spark):
    """Many groups of a few rows: beside the slots' counts, one shuffle of the rows."""
    df = spark.range(30_000).select((F.col("id") % 9000).cast("string").alias("k"), (F.col("id") * 7919 % 1009).cast("double").alias("v"))
    got = grouped_percentiles(df, ["k"], "v", {"p50": 0.5}, extra_aggs=[F.max("v").alias("most")])
    plan = final_plan(got)
    assert 1 <= plan.count("Exchange hashpartitioning(") <= 2 and "_wb" not in plan
    want = df.groupBy("k").agg(F.percentile("v", 0.5).alias("p50"), F.max("v").alias("most"))
    assert sorted(map(tuple, got.select("k", "p50", "most").collect())) == sorted(map(tuple, want.select("k", "p50", "most").collect()))


def test_small_and_large_groups_give_the_same(spark, monkeypatch):
    from wattline.operators import quantiles as Q
    df, probs = skewed(spark, 20_000), {"p25": 0.25, "p50": 0.5, "p99": 0.99}
    out = []
    for hot_rows in (0, 1000, 1 << 40):
        monkeypatch.setattr(Q, "HOT_ROWS", hot_rows)
        rows = grouped_percentiles(df, ["k"], "v", probs, extra_aggs=[F.count("*").alias("n")]).collect()
        out.append(sorted(((r["k"] is not None, r["k"] or "", r["n"], *[round(r[p], 9) for p in probs]) for r in rows)))
    assert out[0] == out[1] == out[2] and len(out[0]) > 100


def test_strata_are_not_shuffled(spark):
    from wattline.operators.sampling import stratified_hash_split
    df = spark.createDataFrame([(f"r{i}", "a" if i % 10 else None) for i in range(200)], "id string, s string")
    out = stratified_hash_split(df, "id", "s", {"train": 0.8, "test": 0.2})
    joins = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "LeftOuter" in x]
    assert joins and all("BroadcastHashJoin" in x for x in joins) and out.count() == 200


def test_stratified_sample_quota_null_stratum_and_size(spark):
    rows = [(f"id{i}", "big" if i < 90 else ("tiny" if i == 90 else None)) for i in range(100)]
    df = spark.createDataFrame(rows, "id string, s string")
    out = stratified_sample(df, "id", "s", 10, seed=1, materialize_input=False).collect()
    assert len(out) == 10
    assert sum(1 for r in out if r.s == "tiny") == 1      # max(1, round(0.01 * 10)) = 1
    again = stratified_sample(df.repartition(5), "id", "s", 10, seed=1, materialize_input=False).collect()
    assert sorted(r.id for r in out) == sorted(r.id for r in again)


def test_sets_come_from_the_data(spark):
    from wattline.operators.sets import pairwise_overlap
    rows = [("a", 1), ("b", 1), ("c", 1), ("a", 2), ("c", 2), ("d", 3), (None, 1), ("a", None), ("a", 1)]
    df = spark.createDataFrame(rows, "s string, k int")
    got = {(r.set_a, r.set_b): r.overlap for r in pairwise_overlap(df, "s", "k").collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("a", "d"): 0, ("b", "c"): 1, ("b", "d"): 0, ("c", "d"): 0}


def test_null_trigger_is_not_the_first(spark):
    rows = [("f", None, 1, 5.0), ("f", "http", 2, 7.0), ("g", None, 1, 1.0)]
    df = spark.createDataFrame(rows, "hash_function string, trigger_type string, day int, m1 double")
    got = {r.hash_function: (r.trigger_type, r.daily_invocations) for r in T.invocation_summary(df, ["m1"]).collect()}
    assert got == {"f": ("http", 6.0), "g": (None, 1.0)}


def test_null_is_no_category_but_counts_in_the_total(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    got = T.value_share(df, "t").collect()
    assert [(r.t, r.n) for r in got] == [("a", 2)] and abs(got[0].pct - 200 / 3) < 1e-9


def test_nan_is_coerced_to_zero(spark):
    df = spark.createDataFrame([(float("nan"), "nan", "x", 2.5), (1.0, "7", None, None)], "a double, b string, c string, d double")
    got = P.align_features(df, ["a", "b", "c", "d", "e"]).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 0.0, 2.5, 0.0), (1.0, 7.0, 0.0, 0.0, 0.0)]


def test_two_apps_of_a_function_are_two_rows(spark):
    df = spark.createDataFrame([("f", "x", "t"), ("f", "y", "t"), ("g", "x", "t")], "f string, a string, s string") \
        .withColumn("id", F.concat_ws("|", "f", "a"))
    out = stratified_sample(df, "id", "s", 2, seed=1, materialize_input=False)
    rest = df.join(out.select("f", "a"), ["f", "a"], "left_anti")
    assert out.count() == 2 and rest.count() == 1


def test_value_shares_sum_to_100(spark):
    df = spark.createDataFrame([(x,) for x in "aabbbcdddd"], "t string")
    rows = T.value_share(df, "t").collect()
    assert abs(sum(r.pct for r in rows) - 100.0) < 1e-9
    top = T.value_share(df, "t", top=2).collect()
    assert [r.t for r in top] == ["d", "b"]


def test_exactly_k_matches_count_per_key(spark):
    from wattline.operators.sets import in_exactly_k
    rows = [("s1", k) for k in range(10)] + [("s2", k) for k in range(5, 15)] + [("s3", k) for k in range(8, 12)]
    df = spark.createDataFrame(rows, "s string, k int")
    got = sorted(r.k for r in in_exactly_k(df, "s", "k", 2).collect())
    want = sorted(r.k for r in df.distinct().groupBy("k").count().where("count = 2").collect())
    assert got == want


def test_stratified_split_exact_per_stratum(spark):
    from wattline.operators.sampling import stratified_hash_split
    rows = [(f"r{i}", "a" if i % 10 < 7 else "b") for i in range(2000)]
    out = stratified_hash_split(spark.createDataFrame(rows, "id string, s string"), "id", "s",
                                {"train": 0.64, "validation": 0.16, "test": 0.2})
    for r in out.groupBy("s").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("tr"),
                                  F.count_if(F.col("split") != "test").alias("trv")).collect():
        assert abs(r.tr - 0.64 * r.n) <= 1 and abs(r.trv - 0.8 * r.n) <= 1


def test_json_value_leaves_at_any_depth(spark):
    from wattline.plans.workloads import value_leaves
    doc = '{"value": 1.5, "a": [{"value": -2, "b": {"c": {"value": 3e2}}}, {"text": "\\"value\\": 9", "value": "x"}]}'
    got = spark.createDataFrame([(doc,)], "d string").select(value_leaves(F.col("d")).alias("v")).first().v
    assert [float(x) for x in got] == [1.5, -2.0, 300.0]
