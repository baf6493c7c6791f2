"""Projection, filter and check queries over the domain views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions import rounding as R

from wattline.config import DEFAULT_CODE_METRICS, DEFAULT_AWS_DURATION_MS, DEFAULT_LOCAL_DURATION_MS
from wattline.functions import labels as L
from wattline.functions.text import loc_count
from wattline.operators import projections as P
from wattline.operators.checks import missing_values, missing_required
from wattline.plans.registry import register
from wattline.sources.tables import Catalog


def function_energy_profile(cat: Catalog) -> DataFrame:
    """Per function: mean energy, memory and duration of its invocations."""
    return (cat.v_pred.groupBy("function_name")
            .agg(F.avg("actual_wh").alias("energy_wh"), F.avg("predicted_wh").alias("predicted_wh"),
                 F.avg("memory_mb").alias("memory_mb"), F.avg("latency_ms").alias("duration_ms"),
                 F.count(F.lit(1)).alias("invocations")))


@register("prj_energy")
def prj_energy(cat: Catalog) -> DataFrame:
    return P.with_energy(cat.v_inv.select("inv_id", "function_name", "memory_mb", "latency_ms"))


@register("prj_carbon")
def prj_carbon(cat: Catalog) -> DataFrame:
    return P.with_carbon(cat.v_pred.select("inv_id", "actual_wh"), "actual_wh")


@register("prj_cost")
def prj_cost(cat: Catalog) -> DataFrame:
    return P.with_cost(cat.v_inv.select("inv_id", "memory_mb", "latency_ms")).drop("memory_mb", "latency_ms")


@register("prj_monthly_projection")
def prj_monthly_projection(cat: Catalog) -> DataFrame:
    prof = function_energy_profile(cat)
    return (P.monthly_projection(prof, "energy_wh", "memory_mb", "duration_ms")
            .select("function_name", "energy_wh_per_invocation", "monthly_invocations",
                    "monthly_carbon_kg", "monthly_cost_inr"))


@register("prj_flat_spike")
def prj_flat_spike(cat: Catalog) -> DataFrame:
    out = P.flat_spike(function_energy_profile(cat), "energy_wh")
    return out.select("function_name", "spike_requests",
                      R.half_up("spike_energy_kwh", 6).alias("spike_energy_kwh"),
                      R.half_up("spike_carbon_kg", 6).alias("spike_carbon_kg"))


@register("prj_formula_gap")
def prj_formula_gap(cat: Catalog) -> DataFrame:
    return P.formula_gap(cat.v_pred.select("inv_id", "memory_mb", "latency_ms", "predicted_wh")) \
        .select("inv_id", "theoretical_wh", "formula_gap_wh")


@register("prj_derived_ratios")
def prj_derived_ratios(cat: Catalog) -> DataFrame:
    return P.derived_ratios(cat.v_inv.select("inv_id", "memory_mb", "latency_ms")) \
        .drop("memory_mb", "latency_ms")


def document_code_metrics(cat: Catalog) -> DataFrame:
    """Source role: each document is the source of function ``fn-<doc_id>``."""
    d = cat.documents
    return d.select(F.concat(F.lit("fn-"), F.col("doc_id").cast("string")).alias("function_name"),
                    loc_count(F.col("text")).cast("double").alias("lines_of_code"))


@register("prj_default_metrics")
def prj_default_metrics(cat: Catalog) -> DataFrame:
    fns = cat.v_inv.groupBy("function_name").agg(F.avg("latency_ms").alias("aws_duration_ms"))
    joined = fns.join(document_code_metrics(cat), "function_name", "left")
    filled = P.fill_defaults(joined, {**DEFAULT_CODE_METRICS, "local_duration_ms": DEFAULT_LOCAL_DURATION_MS})
    return filled.select("function_name", *DEFAULT_CODE_METRICS, "local_duration_ms",
                         R.half_up(F.coalesce("aws_duration_ms", F.lit(DEFAULT_AWS_DURATION_MS)), 6)
                         .alias("aws_duration_ms"))


@register("prj_error_columns")
def prj_error_columns(cat: Catalog) -> DataFrame:
    return P.error_columns(cat.v_pred.select("inv_id", "actual_wh", "predicted_wh")) \
        .drop("actual_wh", "predicted_wh")


@register("prj_gap_verdict")
def prj_gap_verdict(cat: Catalog) -> DataFrame:
    return P.gap_verdict(cat.v_pred.select("inv_id", "actual_wh", "predicted_wh")) \
        .drop("actual_wh", "predicted_wh")


@register("prj_floor_prediction")
def prj_floor_prediction(cat: Catalog) -> DataFrame:
    raw = (F.col("predicted_wh") - 0.002).alias("raw_pred_wh")
    base = cat.v_pred.select("inv_id", raw)
    return base.select("inv_id", "raw_pred_wh",
                       P.E.floor_prediction("raw_pred_wh", 0.0001).alias("online_pred_wh"),
                       P.E.floor_prediction("raw_pred_wh", 0.0).alias("batch_pred_wh"))


_RUNTIME_MODEL = {"python3.9": "xgboost", "nodejs14": "rf", "java11": "nn", "php7": "neural_net"}


@register("prj_confidence")
def prj_confidence(cat: Catalog) -> DataFrame:
    alias = F.coalesce(F.create_map(*[F.lit(x) for kv in _RUNTIME_MODEL.items() for x in kv])[F.col("runtime")],
                       F.lit("random_forest"))
    v = cat.v_inv.select("inv_id", P.normalise_model_alias(alias).alias("model"),
                         (F.col("memory_mb") == 3000).alias("is_fallback"))
    return P.confidence(v)


@register("prj_badges")
def prj_badges(cat: Catalog) -> DataFrame:
    prof = (P.error_columns(cat.v_pred.select("function_name", "actual_wh", "predicted_wh"))
            .groupBy("function_name")
            .agg(F.avg("accuracy_pct").alias("efficiency"), F.avg("actual_wh").alias("energy_wh")))
    return P.badges(prof).select("function_name", "efficiency_badge", "energy_badge")


@register("prj_runtime_category")
def prj_runtime_category(cat: Catalog) -> DataFrame:
    return cat.v_inv.select("inv_id", "runtime", P.runtime_category(F.col("runtime")).alias("runtime_category"))


@register("prj_trigger_flags")
def prj_trigger_flags(cat: Catalog) -> DataFrame:
    return P.trigger_flags(cat.v_inv.select("inv_id", "trigger_type")).drop("trigger_type")


def part_function_names(cat: Catalog, keep: tuple[str, ...] = ()) -> DataFrame:
    """Named workloads: a family chosen by size, suffixed by the key; every
    seventh size gives a name without a dash."""
    fam = F.element_at(F.array(*[F.lit(x) for x in
                                 ("etl-transform", "image-proc", "rest-api", "ml-inference", "fibonacci")]),
                       (F.col("p_size") % 5 + 1).cast("int"))
    name = F.when(F.col("p_size") % 7 == 0, F.lit("hello")) \
        .otherwise(F.concat(fam, F.lit("-"), F.col("p_partkey").cast("string")))
    return cat.part.select("p_partkey", name.alias("name"), *keep)


@register("prj_name_category")
def prj_name_category(cat: Catalog) -> DataFrame:
    n = F.col("name")
    return part_function_names(cat).select("p_partkey", "name", P.name_category(n).alias("category"),
                                           P.name_function_type(n).alias("function_type"))


@register("prj_duration_bucket")
def prj_duration_bucket(cat: Catalog) -> DataFrame:
    d = (F.col("latency_ms") * F.col("quantity"))
    return cat.v_inv.select("inv_id", d.alias("duration_ms"), P.duration_bucket(d).alias("duration_bucket"),
                            P.duration_bucket_order(d).alias("bucket_order"))


@register("prj_feature_label")
def prj_feature_label(cat: Catalog) -> DataFrame:
    f = cat.v_attr.select("feature").distinct()
    raw = L.raw_feature_name(F.col("feature"))
    return f.select("feature", raw.alias("raw_name"), L.feature_label(raw).alias("label"),
                    L.feature_label(F.col("feature")).alias("short_label"))


@register("prj_align_features")
def prj_align_features(cat: Catalog) -> DataFrame:
    v = P.trigger_flags(cat.v_inv.select(
        "inv_id", "trigger_type", F.col("memory_mb").alias("memory_config_mb"), "cold_start",
        F.col("latency_ms").alias("aws_duration_ms"), "quantity"))
    return P.align_features(v, L.FEATURE_ORDER, keep=["inv_id"])


@register("prj_numeric_coerce")
def prj_numeric_coerce(cat: Catalog) -> DataFrame:
    e = cat.events
    k = F.regexp_extract("props", r'"k":\s*([0-9.]+)', 1)
    return e.select("event_id", P.numeric_coerce(k).alias("k_num"),
                    P.numeric_coerce(F.col("event_type")).alias("type_num"),
                    P.numeric_coerce(F.col("value")).alias("value_num"))


@register("prj_drop_leakage")
def prj_drop_leakage(cat: Catalog) -> DataFrame:
    return P.drop_leakage(P.derived_ratios(cat.v_inv.select("inv_id", "memory_mb", "latency_ms")))


_TRACE_RENAMES = {"hash_function": "HashFunction", "hash_app": "HashApp", "average": "avg_duration_ms",
                  "cnt": "invocation_count", "minimum": "min_duration_ms", "maximum": "max_duration_ms",
                  "p50": "p50_duration_ms", "p99": "p99_duration_ms"}


@register("prj_rename_order")
def prj_rename_order(cat: Catalog) -> DataFrame:
    out = P.rename_order(cat.v_fn_day, _TRACE_RENAMES, ["HashApp", "HashFunction", "day", *list(_TRACE_RENAMES.values())[2:]])
    return out.select(*[R.half_up(c, 6).alias(c) if c in ("avg_duration_ms", "p50_duration_ms", "p99_duration_ms")
                        else F.col(c) for c in out.columns])


@register("flt_valid_caps")
def flt_valid_caps(cat: Catalog) -> DataFrame:
    v = cat.v_inv.select("inv_id", (F.col("memory_mb") / 2).alias("memory_allocated_mb"),
                         (F.col("latency_ms") * F.col("quantity") * 3).alias("avg_duration_ms"))
    return P.valid_caps(v)


@register("flt_min_count")
def flt_min_count(cat: Catalog) -> DataFrame:
    c = cat.v_inv.groupBy("function_name").agg(F.count(F.lit(1)).alias("invocation_count"))
    return P.min_count(c)


@register("flt_name_search")
def flt_name_search(cat: Catalog) -> DataFrame:
    return P.name_search(part_function_names(cat), "ETL-TRANSFORM-1", col="name")


@register("flt_negative_pred")
def flt_negative_pred(cat: Catalog) -> DataFrame:
    """Score every function profile with a linear stand-in and report the
    negative predictions."""
    prof = function_energy_profile(cat)
    score = F.col("predicted_wh") * 2 - F.lit(0.15)
    return prof.select("function_name", R.half_up(score, 9).alias("prediction")).where(F.col("prediction") < 0)


@register("flt_out_of_range")
def flt_out_of_range(cat: Catalog) -> DataFrame:
    from wattline.operators.checks import out_of_range
    from wattline.config import RANGE_CHECK_FEATURES
    from wattline.plans.profiles import LIVE_COLUMNS, live_by_user, profile, telemetry
    from wattline.operators.profiles import live_override
    train = telemetry(cat)
    req = live_override(profile(cat).select("function_name", *RANGE_CHECK_FEATURES), live_by_user(cat), LIVE_COLUMNS)
    # stand-in score: the power formula, shifted so that some rows fall below 0
    req = req.withColumn("prediction", P.E.energy_wh("memory_config_mb", "aws_duration_ms") * 3 - 0.2)
    out = out_of_range(req, train, RANGE_CHECK_FEATURES, "prediction", train.agg(F.max("energy_target_wh").alias("target_max")))
    return out.select("function_name", "is_low_confidence", "reasons", "confidence", "confidence_status", "confidence_message")


@register("flt_energy_gate")
def flt_energy_gate(cat: Catalog) -> DataFrame:
    d = cat.documents.select("doc_id", loc_count(F.col("text")).cast("double").alias("lines_of_code"),
                             (1.0 + (F.length("text") - F.length(F.regexp_replace("text", ",", ""))) / 10.0)
                             .alias("cyclomatic_complexity"))
    return P.energy_gate(d).select("doc_id", R.half_up("gate_energy_wh", 6).alias("gate_energy_wh"), "gate_status")


@register("chk_missing_values")
def chk_missing_values(cat: Catalog) -> DataFrame:
    return missing_values(cat.v_fn_minutes)


@register("chk_missing_inputs")
def chk_missing_inputs(cat: Catalog) -> DataFrame:
    """Requests that lack raw inputs and encoded ones: one per customer, with
    all raw inputs, all encoded ones, all raw but one, or two thirds of them."""
    from wattline.config import RAW_INPUTS
    from wattline.functions.labels import FEATURE_ORDER
    from wattline.operators.checks import missing_inputs
    names = lambda own: F.array(*[F.lit(n) for n in own])
    k = F.col("c_custkey")
    given = (F.when(k % 4 == 0, names(RAW_INPUTS)).when(k % 4 == 1, names(FEATURE_ORDER))
             .when(k % 4 == 2, F.filter(names(RAW_INPUTS), lambda x, i: i != k % len(RAW_INPUTS)))
             .otherwise(F.filter(names(RAW_INPUTS), lambda x, i: i % 3 != k % 3)))
    requests = cat.customer.select("c_custkey", F.map_from_arrays(given, F.transform(given, lambda x: F.lit(1.0))).alias("inputs"))
    return missing_inputs(requests, "c_custkey", RAW_INPUTS, FEATURE_ORDER)


@register("chk_required_features")
def chk_required_features(cat: Catalog) -> DataFrame:
    months = [f"m{i}" for i in range(1, 13)]
    return missing_required(cat.v_fn_minutes, ["hash_function", "trigger_type", "day"], months)
