"""Window, top-k, set and attribution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions import rounding as R
from wattline.operators import attributions as A
from wattline.operators import metrics as M
from wattline.operators import sets as S
from wattline.operators import traces as T
from wattline.operators import windows as W
from wattline.operators.sampling import seeded_sample, stratified_sample
from wattline.plans.registry import register
from wattline.plans.rowwise import function_energy_profile
from wattline.plans.traces import MINUTE_COLS
from wattline.sources.tables import Catalog

SAMPLE_N = 5000
GRID = 60


def r9(c: str):
    return R.half_up(c, 9).alias(c)


def master(cat: Catalog) -> DataFrame:
    return T.trace_master(cat.v_fn_day_basic, cat.v_app_day, cat.v_fn_minutes, MINUTE_COLS)


def stratified(cat: Catalog) -> DataFrame:
    """A trace row is a function of one app, so both name it."""
    return stratified_sample(master(cat).withColumn("_id", F.concat_ws("|", "hash_function", "hash_app")), "_id", "trigger_type", SAMPLE_N, seed=42)


@register("win_stratified_sample")
def win_stratified_sample(cat: Catalog) -> DataFrame:
    return stratified(cat).select("hash_function", "hash_app", "trigger_type")


@register("join_anti_remaining")
def join_anti_remaining(cat: Catalog) -> DataFrame:
    keys = ["hash_function", "hash_app"]
    return master(cat).join(stratified(cat).select(keys), keys, "left_anti").select(*keys, "trigger_type")


@register("win_seeded_sample")
def win_seeded_sample(cat: Catalog) -> DataFrame:
    return seeded_sample(cat.v_pred, "inv_id", 100, seed=42).select("inv_id", "actual_wh", "predicted_wh")


@register("win_last_n")
def win_last_n(cat: Catalog) -> DataFrame:
    return W.last_n(cat.v_live, "function_name", "ts", 12, tie="event_id") \
        .select("function_name", "event_id", "ts", "duration_ms", "rank")


def shap_importance(cat: Catalog) -> DataFrame:
    return A.global_importance(cat.v_attr, "shap_value")


def lime_importance(cat: Catalog) -> DataFrame:
    return A.global_importance(cat.v_attr, "lime_weight")


@register("win_rank_features")
def win_rank_features(cat: Catalog) -> DataFrame:
    return shap_importance(cat).select("feature", r9("importance"), "rank", r9("relative_pct"))


@register("topk_importance")
def topk_importance(cat: Catalog) -> DataFrame:
    return shap_importance(cat).orderBy(F.desc("importance"), "feature").limit(15).select("feature", r9("importance"))


@register("topk_attributions")
def topk_attributions(cat: Catalog) -> DataFrame:
    return A.top_attributions(cat.v_attr, "shap_value", 5)


def aligned(cat: Catalog) -> DataFrame:
    shap = cat.v_attr.select("row_id", "feature", "shap_value")
    lime = cat.v_attr.select("row_id", "feature", "lime_weight")
    return A.align_methods(shap, lime)


@register("join_attributions")
def join_attributions(cat: Catalog) -> DataFrame:
    return aligned(cat)


@register("agg_global_importance")
def agg_global_importance(cat: Catalog) -> DataFrame:
    s = shap_importance(cat).select("feature", F.col("importance").alias("shap_importance"), F.col("rank").alias("shap_rank"))
    li = lime_importance(cat).select("feature", F.col("importance").alias("lime_importance"), F.col("rank").alias("lime_rank"))
    return s.join(li, "feature", "inner").select("feature", r9("shap_importance"), r9("lime_importance"),
                                                 "shap_rank", "lime_rank")


@register("agg_importance_normalised")
def agg_importance_normalised(cat: Catalog) -> DataFrame:
    n = A.importance_normalised(shap_importance(cat), lime_importance(cat), 10)
    return n.select("feature", r9("shap_norm"), r9("lime_norm"))


@register("agg_attribution_agreement")
def agg_attribution_agreement(cat: Catalog) -> DataFrame:
    return A.agreement(aligned(cat), 10)


def attr_with_base(cat: Catalog) -> DataFrame:
    base = cat.v_pred.agg(F.avg("actual_wh").alias("base_wh"))
    a = cat.v_attr.crossJoin(F.broadcast(base))
    pred = a.groupBy("row_id").agg((F.first("base_wh") + F.sum("shap_value")).alias("predicted_wh"))
    return a.join(pred, "row_id", "inner")


@register("agg_attribution_flow")
def agg_attribution_flow(cat: Catalog) -> DataFrame:
    f = A.flow(attr_with_base(cat), "shap_value", "base_wh", "predicted_wh", 5)
    return f.select("row_id", *[r9(c) for c in ("base_mwh", "predicted_mwh", "total_pos_mwh", "total_neg_mwh",
                                                "base_pct", "pos_pct", "neg_pct", "diff_pct")],
                    "relationship", "top_driver", "top_code_driver")


@register("win_waterfall")
def win_waterfall(cat: Catalog) -> DataFrame:
    w = A.waterfall(attr_with_base(cat), "shap_value", "base_wh")
    # inputs are averages (last-bit noise between runs): report mWh at 6 digits
    return w.select("row_id", "feature", "step", R.half_up("value_mwh", 6).alias("value_mwh"),
                    R.half_up("cumulative_mwh", 6).alias("cumulative_mwh"))


@register("topk_per_group_avg")
def topk_per_group_avg(cat: Catalog) -> DataFrame:
    li = cat.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("category"),
                             F.col("l_extendedprice").alias("score"), "l_orderkey", "l_linenumber")
    top = W.top_k_per_group(li, ["category"], [F.desc("score"), F.asc("l_orderkey"), F.asc("l_linenumber")], 100)
    return top.groupBy("category").agg(R.half_up(F.avg("score"), 6).alias("avg_top_score"),
                                       F.count(F.lit(1)).alias("n"))


@register("topk_correlated")
def topk_correlated(cat: Catalog) -> DataFrame:
    from wattline.plans.metrics import CORR_FEATURES
    c = M.correlation_with(cat.v_pred, "actual_wh", CORR_FEATURES)
    top = c.where(F.col("rank_desc") <= 10).withColumn("kind", F.lit("top"))
    bottom = c.where(F.col("rank_asc") <= 10).withColumn("kind", F.lit("bottom"))
    return top.unionByName(bottom).select("kind", "feature", r9("corr"))


@register("sort_table")
def sort_table(cat: Catalog) -> DataFrame:
    return cat.orders.orderBy(F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "o_totalprice")


@register("win_spike_projection")
def win_spike_projection(cat: Catalog) -> DataFrame:
    h = W.spike_hours(function_energy_profile(cat).select("function_name", "energy_wh"))
    return h.select("function_name", "hour", "predicted_req_per_hour", "predicted_energy_kwh")


@register("win_spike_totals")
def win_spike_totals(cat: Catalog) -> DataFrame:
    from wattline.functions import energy as E
    prof = function_energy_profile(cat).select(
        "function_name", "energy_wh", E.cost_per_call_inr("memory_mb", "duration_ms").alias("cost_per_call"))
    return W.spike_totals(W.spike_hours(prof), cost_per_call="cost_per_call")


@register("win_adjacent_pairs")
def win_adjacent_pairs(cat: Catalog) -> DataFrame:
    p = W.consecutive_pairs_with_gap(cat.orders, "o_custkey", 2)
    return p.agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("a") + F.col("b")).alias("pair_sum"))


@register("win_date_deltas")
def win_date_deltas(cat: Catalog) -> DataFrame:
    return W.date_deltas(cat.orders, "o_orderdate")


@register("fn_date_series")
def fn_date_series(cat: Catalog) -> DataFrame:
    b = cat.orders.agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    s = b.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 5 DAYS"))).alias("d"))
    return s.select(F.date_format("d", "yyyy-MM-dd").alias("date"), F.dayofweek("d").alias("weekday"))


@register("win_trapezoid")
def win_trapezoid(cat: Catalog) -> DataFrame:
    e = cat.events
    first = e.agg(F.to_date(F.min("ts")).alias("d0"))
    daily = (e.groupBy(F.to_date("ts").alias("d")).agg(F.sum("value").alias("y"))
             .crossJoin(F.broadcast(first)).select(F.datediff("d", "d0").alias("x"), "y"))
    return W.trapezoid_area(daily, "x", "y").select(r9("area"), "segments")


def grid(cat: Catalog) -> DataFrame:
    """A GRID x GRID image from the line items: cell (order key, part key)
    modulo GRID, value = summed quantity modulo 256."""
    li = cat.lineitem
    return (li.groupBy((F.col("l_orderkey") % GRID).cast("int").alias("r"),
                       (F.col("l_partkey") % GRID).cast("int").alias("c"))
            .agg((F.sum("l_quantity") % 256).alias("v")))


@register("win_grid_blur")
def win_grid_blur(cat: Catalog) -> DataFrame:
    b = W.grid_blur(grid(cat), GRID)
    total = b.agg(F.sum("blurred").alias("pixel_sum"))
    kept = b.where((F.col("r") % 2 == 0) & (F.col("c") % 2 == 0))
    return kept.crossJoin(F.broadcast(total)).select("r", "c", r9("blurred"), r9("pixel_sum"))


@register("agg_grid_sums")
def agg_grid_sums(cat: Catalog) -> DataFrame:
    """Row sums, column sums and the overall sum / min / max in one
    aggregation: a cube over (r, c) keeping the (r), (c) and () levels."""
    c = grid(cat).cube("r", "c").agg(F.sum("v").alias("total"), F.min("v").alias("_mn"), F.max("v").alias("_mx"),
                                     F.grouping_id().alias("gid"))
    c = c.where(F.col("gid") > 0)
    dim = F.when(F.col("gid") == 1, "row").when(F.col("gid") == 2, "col").otherwise("all")
    idx = F.when(F.col("gid") == 1, F.col("r")).when(F.col("gid") == 2, F.col("c")).otherwise(F.lit(-1))
    is_all = F.col("gid") == 3
    return c.select(dim.alias("dim"), idx.alias("idx"), "total", F.when(is_all, F.col("_mn")).alias("min_v"),
                    F.when(is_all, F.col("_mx")).alias("max_v"))


@register("set_union_all")
def set_union_all(cat: Catalog) -> DataFrame:
    c = cat.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"),
                            F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"),
                            F.lit("customer").alias("source"))
    s = cat.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"),
                            F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("source"))
    return c.unionByName(s, allowMissingColumns=True)


def flag_sets(cat: Catalog) -> list[DataFrame]:
    li = cat.lineitem
    return [S.key_set(li, "l_partkey", F.col("l_returnflag") == f) for f in ("A", "N", "R")]


@register("set_intersect3")
def set_intersect3(cat: Catalog) -> DataFrame:
    return S.intersect_all_sets(flag_sets(cat))


@register("set_union_distinct")
def set_union_distinct(cat: Catalog) -> DataFrame:
    return S.union_distinct(flag_sets(cat))


@register("set_except")
def set_except(cat: Catalog) -> DataFrame:
    a, n, _ = flag_sets(cat)
    return S.except_distinct(a, n)


@register("set_except_customers")
def set_except_customers(cat: Catalog) -> DataFrame:
    """Customers without orders: c_custkey minus o_custkey."""
    return S.except_distinct(cat.customer.select(F.col("c_custkey").alias("custkey")),
                             cat.orders.select(F.col("o_custkey").alias("custkey")))


def memberships(cat: Catalog) -> DataFrame:
    return cat.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("set_id"), "l_partkey")


@register("set_pairwise_overlap")
def set_pairwise_overlap(cat: Catalog) -> DataFrame:
    return S.pairwise_overlap(memberships(cat), "set_id", "l_partkey").select(
        "set_a", "set_b", "overlap", r9("avg_overlap"))


@register("agg_in_exactly_k")
def agg_in_exactly_k(cat: Catalog) -> DataFrame:
    return S.in_exactly_k(memberships(cat), "set_id", "l_partkey", 3)


@register("agg_inverted_index")
def agg_inverted_index(cat: Catalog) -> DataFrame:
    common = S.intersect_all_sets(flag_sets(cat))
    j = common.join(cat.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey", "inner")
    return S.inverted_index(j, "p_brand", "l_partkey")
