"""Features, models, explanations, code metrics and file I/O (SURVEY 2.1,
2.3, 2.4, 2.10)."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.config import FALLBACK_MEANS, NUMERIC_FEATURES, RANGE_CHECK_FEATURES
from wattline.functions import rounding as R
from wattline.functions.labels import FEATURE_ORDER
from wattline.models import attribution as AT
from wattline.models import codemetrics as CM
from wattline.models import explain as X
from wattline.models import features as FE
from wattline.models import forest as FO
from wattline.models import store as ST
from wattline.models import trees as TR
from wattline.models.mlp import DistributedMLP
from wattline.operators import metrics as M
from wattline.operators import projections as P
from wattline.operators import traces as T
from wattline.operators.profiles import invocation_telemetry
from wattline.operators.sampling import hash_split, seeded_sample
from wattline.plans.profiles import CATEGORICAL, lookup_requests, profile, telemetry
from wattline.plans.registry import register
from wattline.plans.traces import MINUTE_COLS
from wattline.session import checkpoint_dir
from wattline.sources import files as IO
from wattline.sources.tables import Catalog

SPLITS = {"train": 0.64, "validation": 0.16, "test": 0.20}
# The inputs that traces lack, imputed by training means.
MEAN_FEATURES = ("cold_start", "lines_of_code", "num_loops", "num_conditionals", "num_function_calls",
                 "cyclomatic_complexity", "max_nesting_depth", "local_cpu_percent", "memory_efficiency")
_MODELS: dict = {}
_PREPARED: dict = {}


def r9(c: str):
    return R.half_up(c, 9).alias(c)


def scratch(cat: Catalog, name: str) -> str:
    return f"{checkpoint_dir(cat.spark).rstrip('/')}/io/{name}-{uuid.uuid4().hex[:12]}"


# ------------------------------------------------------------------ features
def split_features(cat: Catalog) -> DataFrame:
    f = FE.telemetry_features(telemetry(cat), keep=("inv_id",))
    return hash_split(f, "inv_id", SPLITS).withColumn("is_validation", F.col("split") == "validation")


def fingerprint(cat: Catalog) -> tuple:
    """Names, sizes and times of the files that models are trained on, so a
    model of replaced data is not used again."""
    from wattline.session import file_versions
    return tuple(file_versions(cat.spark, f"{cat.sf_dir}/{t}.parquet") for t in ("lineitem", "part", "documents"))


def prepared(cat: Catalog) -> DataFrame:
    """The split feature table, saved once per session and data folder by
    columns (most are sparse or constant): model fits, test scoring, explained
    / background rows and the LIME scales all read theirs of it instead of
    rebuilding the telemetry."""
    from wattline.session import saved_table
    key = (cat.spark.sparkContext.applicationId, cat.sf_dir, fingerprint(cat))
    if key not in _PREPARED:
        _PREPARED[key] = saved_table(split_features(cat), "features")
    return _PREPARED[key]


@register("ml_one_hot")
def ml_one_hot(cat: Catalog) -> DataFrame:
    t = invocation_telemetry(cat.v_inv)
    return FE.OneHot(["function_type", "input_size"]).fit(t).transform(t, keep=["inv_id"])


SCALE_COLS = ["memory_config_mb", "aws_duration_ms", "local_cpu_percent", "lines_of_code"]


@register("ml_scale")
def ml_scale(cat: Catalog) -> DataFrame:
    s = FE.scaled_by_aggregate(telemetry(cat).select("inv_id", *SCALE_COLS), SCALE_COLS)
    return s.select("inv_id", *[R.half_up(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in SCALE_COLS])


@register("ml_split")
def ml_split(cat: Catalog) -> DataFrame:
    return hash_split(cat.v_inv.select("inv_id"), "inv_id", SPLITS)


def means_of(t: DataFrame) -> DataFrame:
    """One row: means of the imputed inputs and shares of the function types;
    of an empty table, the fixed fallback means."""
    share = lambda kind: F.avg(F.when(F.col("function_type") == kind, 1.0).otherwise(0.0))
    return t.agg(*[F.coalesce(F.avg(c), F.lit(FALLBACK_MEANS[c])).alias(f"mean_{c}") for c in MEAN_FEATURES],
                 F.coalesce(share("io"), F.lit(FALLBACK_MEANS["share_io"])).alias("share_io"),
                 F.coalesce(share("memory"), F.lit(FALLBACK_MEANS["share_memory"])).alias("share_memory"))


def training_means(cat: Catalog) -> DataFrame:
    return means_of(telemetry(cat))


def trace_master(cat: Catalog) -> DataFrame:
    return T.trace_master(cat.v_fn_day_basic, cat.v_app_day, cat.v_fn_minutes, MINUTE_COLS)


@register("join_broadcast_means")
def join_broadcast_means(cat: Catalog) -> DataFrame:
    """Every trace row gets the training means (one row, broadcast)."""
    j = trace_master(cat).select("hash_function", "trigger_type").crossJoin(F.broadcast(training_means(cat)))
    return j.select("hash_function", "trigger_type", *[r9(f"mean_{c}") for c in MEAN_FEATURES],
                    r9("share_io"), r9("share_memory"))


def cross_platform_features(master: DataFrame, means: DataFrame, keep: tuple[str, ...] = ("hash_function",), shares: bool = False) -> DataFrame:
    """Trace rows mapped to the model inputs: measured memory and duration,
    code metrics imputed by training means, name and input-size dummies zero.
    The function type comes from the trigger or, for traces without triggers,
    from the training shares."""
    j = master.crossJoin(F.broadcast(means))
    mem, dur = F.col("memory_allocated_mb"), F.col("avg_duration_ms")
    cols = {"memory_config_mb": mem, "local_duration_ms": dur, "local_memory_mb": mem, "aws_duration_ms": dur,
            "aws_memory_used_mb": mem, "duration_ratio": F.lit(1.0)}
    cols.update({c: F.col(f"mean_{c}") for c in MEAN_FEATURES})
    if shares:
        cols.update({"function_type_io": F.col("share_io"), "function_type_memory": F.col("share_memory")})
    else:
        t = F.lower(F.coalesce(F.col("trigger_type"), F.lit("")))
        cols.update({"function_type_io": t.isin("queue", "event").cast("double"), "function_type_memory": (t == "storage").cast("double")})
    return j.select(*keep, *[(cols[f] if f in cols else F.lit(0.0)).cast("double").alias(f)
                                       for f in FEATURE_ORDER])


@register("ml_cross_platform_features")
def ml_cross_platform_features(cat: Catalog) -> DataFrame:
    f = cross_platform_features(trace_master(cat), training_means(cat))
    return f.select("hash_function", *[r9(c) for c in FEATURE_ORDER])


# ------------------------------------------------------------------ models
def model(cat: Catalog, kind: str):
    """Fitted once per session and data folder on the saved split
    table, so every pass of the learner reads it directly."""
    key = (cat.spark.sparkContext.applicationId, cat.sf_dir, fingerprint(cat), kind)
    if key not in _MODELS:
        data = prepared(cat).where(F.col("split") != "test")      # 80 %; boosting stops early on its validation part
        _MODELS[key] = fitted(data, kind)
    return _MODELS[key]


def fitted(data: DataFrame, kind: str, **params):
    if kind == "mlp":
        return DistributedMLP(list(FEATURE_ORDER), TR.TARGET, **params).fit(data)
    if kind == "rf":
        return FO.fit_forests(data, FEATURE_ORDER, TR.TARGET, FO.Settings(**params), F.col("inv_id"))[0]
    return TR.fit(data, **params)


def scored(m, df: DataFrame, floor: float | None = 0.0) -> DataFrame:
    """``df`` with the model's ``prediction``."""
    return TR.predict(m, df, floor=floor) if isinstance(m, PipelineModel) else m.transform(df, floor=floor)


def scorer(cat: Catalog, kind: str, floor: float | None = 0.0):
    m = model(cat, kind)
    return lambda df: scored(m, df, floor)


def test_split(cat: Catalog) -> DataFrame:
    return prepared(cat).where(F.col("split") == "test")


def test_predictions(cat: Catalog, kind: str) -> DataFrame:
    return scorer(cat, kind)(test_split(cat)).select("inv_id", F.col("energy_target_wh").alias("actual_wh"),
                                                     F.col("prediction").alias("predicted_wh"))


@register("ml_gbt")
def ml_gbt(cat: Catalog) -> DataFrame:
    return test_predictions(cat, "gbt")


@register("ml_rf")
def ml_rf(cat: Catalog) -> DataFrame:
    return test_predictions(cat, "rf")


@register("ml_mlp")
def ml_mlp(cat: Catalog) -> DataFrame:
    return test_predictions(cat, "mlp")


@register("agg_model_compare")
def agg_model_compare(cat: Catalog) -> DataFrame:
    parts = [M.regression_metrics(test_predictions(cat, k)).withColumn("model", F.lit(k)) for k in ("gbt", "rf", "mlp")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SAMPLE_FUNCTIONS = 5000


_SCORED: dict = {}


def trace_predictions(cat: Catalog, platform: str) -> DataFrame:
    """Sampled trace functions of a platform with actual and predicted energy
    (boosted model): (function, group, avg_duration_ms, memory_allocated_mb,
    actual_wh, predicted_wh), saved once per session and data folder."""
    from wattline.functions import energy as E
    from wattline.operators.sampling import stratified_sample
    from wattline.session import materialize
    key = (cat.spark.sparkContext.applicationId, cat.sf_dir, fingerprint(cat))
    if (*key, platform) in _SCORED:
        return _SCORED[(*key, platform)]
    if platform == "azure":
        m = trace_master(cat).withColumn("function", F.concat_ws("|", "hash_function", "hash_app")).withColumn("group", F.col("trigger_type"))
        m = stratified_sample(m, "function", "trigger_type", SAMPLE_FUNCTIONS, seed=42)
    else:
        m = T.region_function_summary(cat.v_inv, percentiles=False).withColumn("group", P.runtime_category(F.col("runtime"))).withColumn("function", F.col("function_name"))
        m = stratified_sample(m, "function", "group", SAMPLE_FUNCTIONS, seed=42)
    if key not in _SCORED:
        _SCORED[key] = materialize(training_means(cat))
    m = m.withColumn("actual_wh", E.energy_wh("memory_allocated_mb", "avg_duration_ms"))
    keep = ("function", "group", "avg_duration_ms", "memory_allocated_mb", "actual_wh")
    feats = cross_platform_features(m, _SCORED[key], keep=keep, shares=platform == "alibaba")
    _SCORED[(*key, platform)] = materialize(scorer(cat, "gbt", floor=0.0)(feats).select(*keep, F.col("prediction").alias("predicted_wh")))
    return _SCORED[(*key, platform)]


#: The groups that each platform's report lists.
VALIDATION_GROUPS = {"azure": ["http", "timer", "queue", "storage"], "alibaba": ["python", "nodejs", "java", "php"]}


def validation_report(pred: DataFrame, platform: str) -> DataFrame:
    """Error metrics over all rows, with the transfer verdict, and per group."""
    overall = M.regression_metrics(pred).select(F.lit(platform).alias("platform"), F.lit("overall").alias("group"), "r2", "mae", "rmse", "mape",
                                                "accuracy", "n", M.transfer_verdict(F.col("r2")).alias("verdict"))
    by = M.metrics_by(pred, "group", VALIDATION_GROUPS[platform], "group").select(
        F.lit(platform).alias("platform"), "group", "r2", "mae", "rmse", "mape", "accuracy", "n", F.lit(None).cast("string").alias("verdict"))
    return overall.unionByName(by)


@register("ml_trace_validation")
def ml_trace_validation(cat: Catalog) -> DataFrame:
    """Both platforms' traces scored by the trained model: trace -> sample ->
    features -> prediction -> error metrics -> verdict."""
    a, b = (validation_report(trace_predictions(cat, p), p) for p in ("azure", "alibaba"))
    return a.unionByName(b)


def validation_summary(pred: DataFrame, platform: str) -> DataFrame:
    """One nested row: overall metrics, metrics per group, verdict."""
    m = M.regression_metrics(pred)
    by = M.metrics_by(pred, "group", VALIDATION_GROUPS[platform], "group")
    return m.crossJoin(by.agg(F.map_from_entries(F.collect_list(F.struct("group", F.struct("r2", "mae", "rmse", "mape", "accuracy", "n")))).alias("by_group"))).select(
        F.lit(platform).alias("platform"), F.struct("r2", "mae", "rmse", "mape", "accuracy", "n").alias("overall"), "by_group", M.transfer_verdict(F.col("r2")).alias("verdict"))


@register("ml_validation_files")
def ml_validation_files(cat: Catalog) -> DataFrame:
    """The files of a model-scored validation: per platform a detail CSV with
    error columns and a summary JSON, written and read back; one row per
    platform with the summary's figures and those that the detail gives."""
    out = None
    for platform in ("azure", "alibaba"):
        pred, folder = trace_predictions(cat, platform), scratch(cat, f"validation-{platform}")
        detail = P.error_columns(pred)
        IO.write_csv(detail, f"{folder}/detail")
        summary = validation_summary(pred, platform)
        IO.write_summary_json(summary, f"{folder}/summary")
        back = cat.spark.read.schema(detail.schema).option("header", True).csv(f"{folder}/detail")
        again = back.agg(F.count(F.lit(1)).alias("detail_rows"), F.avg("absolute_error_wh").alias("detail_mae"), F.avg("accuracy_pct").alias("detail_accuracy"))
        row = IO.read_summary_json(cat.spark, f"{folder}/summary", summary.schema).crossJoin(again)
        row = row.select("platform", "overall.*", "verdict", F.map_keys("by_group").alias("groups"), "detail_rows", r9("detail_mae"), r9("detail_accuracy"))
        out = row if out is None else out.unionByName(row)
    return out


def training_ends(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two rows with the least and largest value of each range-checked input,
    and one with the largest target: one pass over the training rows."""
    from wattline.session import materialize
    cols = list(RANGE_CHECK_FEATURES)
    ends = materialize(train.agg(*[fn(c).alias(f"{name}_{c}") for c in cols for name, fn in (("lo", F.min), ("hi", F.max))],
                                 F.max("energy_target_wh").alias("target_max")))
    rows = F.array(*[F.struct(*[F.col(f"{name}_{c}").alias(c) for c in cols]) for name in ("lo", "hi")])
    return ends.select(F.explode(rows).alias("e")).select("e.*"), ends.select("target_max")


@register("gap_analysis")
def gap_analysis(cat: Catalog) -> DataFrame:
    """Live roll-up -> inputs with live overrides -> prediction -> range check
    -> floor -> accuracy and verdict, per live function."""
    from wattline.operators import gap as G
    from wattline.operators.profiles import lookup_with_fallback, metric_rollup, profile_fallback
    from wattline.plans.profiles import live_points
    now = cat.events.agg((F.max("ts") + F.expr("INTERVAL 12 HOURS")).alias("now"))
    live = metric_rollup(live_points(cat).crossJoin(F.broadcast(now)), cat.v_live.select("function_name").distinct(), F.col("now"))
    prof = profile(cat, materialized=True)
    cols = list(NUMERIC_FEATURES)
    req = lookup_with_fallback(live.select("function_name"), prof, profile_fallback(prof, cols, CATEGORICAL), [*cols, *CATEGORICAL])
    inputs = FE.telemetry_features(req.withColumn("cold_start", F.bround("cold_start", 0)).withColumn("energy_target_wh", F.lit(None).cast("double")),
                                   keep=("function_name", "is_fallback")).drop("energy_target_wh")
    out = G.gap_report(inputs, live, *training_ends(telemetry(cat)), scorer(cat, "gbt", floor=None))
    return out.select("function_name", "is_fallback", "data_source", *[r9(c) for c in ("actual_wh", "predicted_wh", "absolute_error_wh", "accuracy_pct")],
                      "verdict", "confidence", "confidence_status", "confidence_message")


@register("ml_importance")
def ml_importance(cat: Catalog) -> DataFrame:
    return TR.importances(cat.spark, model(cat, "gbt"))


def online_predictions(cat: Catalog) -> DataFrame:
    """Batch scoring of requested functions: profile lookup with fallback,
    feature alignment, model chosen by each request's alias (xgboost / rf /
    nn, spread over the requests by a hash of the name), online floor and
    confidence.  Each model scores only its own requests.  Saved once per
    session and data folder."""
    from wattline.operators.profiles import lookup_with_fallback, profile_fallback
    from wattline.session import materialize
    key = (cat.spark.sparkContext.applicationId, cat.sf_dir, fingerprint(cat), "online")
    if key in _SCORED:
        return _SCORED[key]
    prof = profile(cat, materialized=True)
    cols = list(NUMERIC_FEATURES)
    fb = profile_fallback(prof, cols, CATEGORICAL)
    req = lookup_with_fallback(lookup_requests(cat), prof, fb, [*cols, *CATEGORICAL])
    alias = F.element_at(F.array(F.lit("xgboost"), F.lit("rf"), F.lit("nn")),
                         (F.pmod(F.xxhash64("function_name"), F.lit(3)) + 1).cast("int"))
    # a mean of flags goes in as the nearest flag
    req = req.withColumn("cold_start", F.bround("cold_start", 0)).withColumn("model", P.normalise_model_alias(alias))
    feats = FE.telemetry_features(req.withColumn("energy_target_wh", F.lit(None).cast("double")),
                                  keep=("function_name", "is_fallback", "model"))
    kinds = {"xgboost": "gbt", "random_forest": "rf", "neural_network": "mlp"}
    keep = ("function_name", "model", "is_fallback", "memory_config_mb", "aws_duration_ms", "prediction")
    parts = [scorer(cat, kind, floor=0.0001)(feats.where(F.col("model") == name)).select(*keep) for name, kind in kinds.items()]
    _SCORED[key] = materialize(P.confidence(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    return _SCORED[key]


@register("ml_predict")
def ml_predict(cat: Catalog) -> DataFrame:
    return online_predictions(cat).select("function_name", "model", "is_fallback", "prediction", "confidence")


@register("online_analysis")
def online_analysis(cat: Catalog) -> DataFrame:
    """Analysis of each requested function from its model's prediction: energy
    per call, confidence, monthly calls, carbon and cost."""
    p = P.monthly_projection(online_predictions(cat), "prediction", "memory_config_mb", "aws_duration_ms")
    return p.select("function_name", "model", "is_fallback", "prediction", "energy_wh_per_invocation", "confidence", "monthly_invocations",
                    "monthly_carbon_kg", "monthly_cost_inr")


def online_spike_hours(cat: Catalog) -> DataFrame:
    from wattline.functions import energy as E
    from wattline.operators import windows as W
    p = online_predictions(cat).withColumn("cost_per_call", E.cost_per_call_inr("memory_config_mb", "aws_duration_ms"))
    return W.spike_hours(p.select("function_name", "prediction", "cost_per_call"), energy="prediction", jitter_seed=42)


@register("online_spike")
def online_spike(cat: Catalog) -> DataFrame:
    """Spike totals of each requested function from its model's prediction:
    hourly requests with jitter, summed to energy, carbon and cost."""
    from wattline.operators import windows as W
    return W.spike_totals(online_spike_hours(cat), energy="prediction", cost_per_call="cost_per_call")


@register("online_results")
def online_results(cat: Catalog) -> DataFrame:
    """Analyses and spike forecasts appended to one results table each and
    read back: one row per function with what both tables hold of it."""
    folder = scratch(cat, "online")
    IO.append_results(online_analysis(cat), f"{folder}/analyses")
    IO.append_results(online_spike(cat), f"{folder}/forecasts")
    read = cat.spark.read.parquet
    return read(f"{folder}/analyses").join(read(f"{folder}/forecasts"), "function_name").select(
        "function_name", "model", "energy_wh_per_invocation", "monthly_carbon_kg", "monthly_cost_inr", "total_requests", "energy_kwh", "carbon_kg", "cost_inr")


#: The original cross-validation's settings (the network stops early).
CV_SETTINGS = {"gbt": {"max_iter": 500}, "rf": {"trees": 100}, "mlp": {"epochs": 100}}


def cross_validate(data: DataFrame, kinds: dict[str, dict], folds: int = 5, seed: int = 7) -> DataFrame:
    """R2, MAE and RMSE per model and fold (folds by seeded hash).  The forests
    of all folds grow in the same jobs from one binned table; the other fits
    run side by side.  Boosting stops early on a fifth of the fold's training
    rows."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    from wattline.session import materialize
    spark = data.sparkSession
    data = materialize(hash_split(data.drop("split", "is_validation"), "inv_id", {f"f{i}": 1 / folds for i in range(folds)}, seed=seed)
                       .withColumn("fold", F.substring("split", 2, 9).cast("int")).drop("split"))
    models: dict = {}
    if "rf" in kinds:
        forests = FO.fit_forests(data, FEATURE_ORDER, TR.TARGET, FO.Settings(**kinds["rf"]), F.col("inv_id"), F.col("fold"), range(folds))
        models.update({("rf", k): m for k, m in enumerate(forests)})

    def fit_one(kind: str, k: int):
        train = data.where(F.col("fold") != k).withColumn("is_validation", F.pmod(F.xxhash64("inv_id", F.lit(seed)), F.lit(5)) == 0)
        return fitted(train, kind, **kinds[kind])

    todo = [(kind, k) for kind in kinds if kind != "rf" for k in range(folds)]
    with ThreadPoolExecutor(max_workers=folds) as pool:
        models.update(zip(todo, pool.map(inheritable_thread_target(spark)(lambda x: fit_one(*x)), todo)))
    out = None
    for kind in kinds:
        for k in range(folds):
            pred = scored(models[kind, k], data.where(F.col("fold") == k))
            row = M.regression_metrics(pred.select(F.col(TR.TARGET).alias("actual_wh"), F.col("prediction").alias("predicted_wh"))).select(
                F.lit(kind).alias("model"), F.lit(k).alias("fold"), "r2", "mae", "rmse", "n")
            out = row if out is None else out.unionByName(row)
    return out


@register("ml_cv")
def ml_cv(cat: Catalog) -> DataFrame:
    """5-fold cross-validation of the three models on the training part."""
    return cross_validate(prepared(cat).where(F.col("split") != "test"), CV_SETTINGS)


# ------------------------------------------------------------------ explanations
#: Rows that attributions explain, rows of the background, and centres of the
#: network's background: the original's numbers.
EXPLAINED, BACKGROUND, CENTRES = 100, 100, 5


def explained_rows(cat: Catalog, n: int | None = None) -> DataFrame:
    """The test split, or ``n`` rows of it where the original draws so many."""
    rows = test_split(cat)
    return (rows if n is None else seeded_sample(rows, "inv_id", n, seed=42)).withColumn("row_id", F.col("inv_id"))


def background_rows(cat: Catalog, n: int = BACKGROUND) -> DataFrame:
    return seeded_sample(prepared(cat).where(F.col("split") == "train"), "inv_id", n, seed=7)


def attributions(cat: Catalog, kind: str, rows: DataFrame, background: DataFrame) -> DataFrame:
    """Shapley values by the model's own algorithm: exact for the trees,
    kernel-weighted coalitions for the network, whose background is k-means
    centres weighted by their clusters."""
    m, features = model(cat, kind), list(FEATURE_ORDER)
    if kind == "mlp":
        centres = X.background_kmeans(background, features, k=CENTRES)
        centres = centres.select(*[F.col("center")[i].alias(f) for i, f in enumerate(features)], "weight")
        return AT.kernel_shap(rows, centres, features, m.predictor(), weight="weight")
    nodes = AT.forest_nodes(m) if kind == "rf" else AT.ensemble_nodes(m, features, scratch(cat, "trees"))
    return AT.tree_shap(rows, background, features, nodes)


@register("ml_shap")
def ml_shap(cat: Catalog) -> DataFrame:
    """100 rows against 100 background rows, each of the three models."""
    from wattline.session import materialize
    rows, background = materialize(explained_rows(cat, EXPLAINED)), materialize(background_rows(cat))
    out = None
    for kind in ("gbt", "rf", "mlp"):
        s = attributions(cat, kind, rows, background).select(F.lit(kind).alias("model"), "row_id", "feature", "shap_value", "base_value", "prediction")
        out = s if out is None else out.unionByName(s)
    return out


def matrix_scorer(cat: Catalog, kind: str) -> X.MatrixScorer:
    """The model as a function of plain values, without a floor."""
    m, features = model(cat, kind), list(FEATURE_ORDER)
    if kind == "mlp":
        return X.MatrixScorer(tuple(range(len(features))), m.predictor())
    nodes = AT.forest_nodes(m) if kind == "rf" else AT.ensemble_nodes(m, features, scratch(cat, "trees"))
    uses = AT.used_features(nodes)
    own = AT.with_places(nodes, uses)
    return X.MatrixScorer(tuple(uses), lambda x: AT.ensemble_predict(own, x))


def lime_rows(cat: Catalog, rows: DataFrame, kind: str, n_samples: int = 1000) -> DataFrame:
    """Discretised LIME; bins from all training rows."""
    train = prepared(cat).where(F.col("split") == "train").select(*FEATURE_ORDER)
    return X.lime_discretised(rows, X.quartile_bins(train, list(FEATURE_ORDER)), list(FEATURE_ORDER), matrix_scorer(cat, kind), n_samples=n_samples)


@register("ml_lime_global")
def ml_lime_global(cat: Catalog) -> DataFrame:
    """Mean absolute LIME weight of each feature over 50 rows, ranked."""
    from wattline.operators import attributions as A
    return A.global_importance(lime_rows(cat, explained_rows(cat, 50), "gbt"), "lime_weight").select("feature", "importance", "rank", "relative_pct")


@register("ml_shap_global")
def ml_shap_global(cat: Catalog) -> DataFrame:
    """Mean absolute Shapley value of each feature over the background rows
    themselves (boosted model, exact), ranked."""
    from wattline.operators import attributions as A
    from wattline.session import materialize
    background = materialize(background_rows(cat).withColumn("row_id", F.col("inv_id")))
    return A.global_importance(attributions(cat, "gbt", background, background), "shap_value").select("feature", "importance", "rank", "relative_pct")


@register("ml_lime")
def ml_lime(cat: Catalog) -> DataFrame:
    """Each row of the test split explained."""
    return lime_rows(cat, explained_rows(cat), "gbt")


@register("ml_background_kmeans")
def ml_background_kmeans(cat: Catalog) -> DataFrame:
    return X.background_kmeans(background_rows(cat), list(NUMERIC_FEATURES), k=5)


# ------------------------------------------------------------------ code metrics
@register("ml_code_metrics")
def ml_code_metrics(cat: Catalog) -> DataFrame:
    return CM.source_metrics(cat.v_source)


@register("agg_code_bundle")
def agg_code_bundle(cat: Catalog) -> DataFrame:
    return CM.bundle_metrics(CM.source_metrics(cat.v_source))


# ------------------------------------------------------------------ file sources and sinks
@register("src_code_bundle")
def src_code_bundle(cat: Catalog) -> DataFrame:
    """Bundles landed as text files (a folder per source, a file per document),
    each file read back whole."""
    root = scratch(cat, "bundles")
    IO.write_code_bundle(cat.documents, root, "source", "text")
    b = IO.read_code_bundle(cat.spark, root, glob="*.txt")
    text = F.regexp_replace("content", "\n\\z", "")
    return b.select(F.regexp_replace("bundle", "^source=", "").alias("bundle"), F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("content_md5"))


@register("src_telemetry_csv")
def src_telemetry_csv(cat: Catalog) -> DataFrame:
    """Telemetry written as CSV (cold start as True/False text for half the
    rows, as some exports do) and read back with the declared schema."""
    t = telemetry(cat).drop("inv_id")
    t = t.withColumn("cold_start", F.when(F.col("memory_config_mb") > 600,
                                          F.when(F.col("cold_start") == 1, "True").otherwise("False"))
                     .otherwise(F.col("cold_start").cast("string")))
    path = scratch(cat, "telemetry_csv")
    IO.write_csv(t, path)
    rows, report = IO.read_telemetry_csv(cat.spark, path)
    IO.write_report(report, path)
    return rows


@register("src_trace_glob")
def src_trace_glob(cat: Catalog) -> DataFrame:
    """Daily duration files (one folder per day) read through a glob, with
    the day taken from each file's path."""
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType
    path = scratch(cat, "trace_days")
    IO.write_csv(cat.v_fn_day.select(F.col("hash_app").alias("HashApp"), F.col("hash_function").alias("HashFunction"),
                                     F.col("average").alias("Average"), F.col("cnt").alias("Count"),
                                     F.col("minimum").alias("Minimum"), F.col("maximum").alias("Maximum"),
                                     F.col("p50").alias("percentile_Average_50"),
                                     F.col("p99").alias("percentile_Average_99"), "day"), path, ["day"])
    schema = StructType([StructField("HashApp", StringType()), StructField("HashFunction", StringType()),
                         StructField("Average", DoubleType()), StructField("Count", LongType()),
                         StructField("Minimum", DoubleType()), StructField("Maximum", DoubleType()),
                         StructField("percentile_Average_50", DoubleType()),
                         StructField("percentile_Average_99", DoubleType())])
    d, report = IO.read_trace_glob(cat.spark, f"{path}/day=*/*.csv", schema, ["HashApp", "HashFunction", "Average", "Count"])
    IO.write_report(report, path)
    return d.select("HashApp", "HashFunction", R.half_up("Average", 9).alias("Average"), "Count", "day")


def summary(cat: Catalog) -> DataFrame:
    """One nested summary row: overall metrics, per-trigger map, verdict."""
    from wattline.plans.metrics import azure_like
    from wattline.session import materialize
    az = materialize(azure_like(cat).select("trigger_type", "actual_wh", "predicted_wh"))     # read by both aggregations
    overall = M.regression_metrics(az)
    by = M.metrics_by(az, "trigger_type", ["http", "timer", "queue", "storage"], "trigger_type")
    entries = by.agg(F.map_from_entries(F.collect_list(F.struct(
        "trigger_type", F.struct("r2", "mae", "rmse", "mape", "accuracy", "n")))).alias("breakdown_by_trigger"))
    return overall.crossJoin(entries).select(
        F.struct(F.col("r2").alias("r2_score"), F.col("mae").alias("mae_wh"), F.col("rmse").alias("rmse_wh"),
                 F.col("mape").alias("mape_pct"), F.col("accuracy").alias("mean_accuracy_pct")).alias("overall_metrics"),
        "breakdown_by_trigger", F.col("n").alias("sample_size"),
        M.transfer_verdict(F.col("r2")).alias("generalizability_verdict"))


@register("sink_summary_json")
def sink_summary_json(cat: Catalog) -> DataFrame:
    """The summary written as JSON and read back without a schema."""
    path = scratch(cat, "summary_json")
    IO.write_summary_json(summary(cat), path)
    back = IO.read_summary_json(cat.spark, path)
    return back.select(*[R.half_up(F.col(f"overall_metrics.{c}"), 6).alias(c) for c in ("r2_score", "mae_wh", "rmse_wh", "mape_pct", "mean_accuracy_pct")],
                       "sample_size", "generalizability_verdict")


@register("src_json_summary")
def src_json_summary(cat: Catalog) -> DataFrame:
    """Read a nested summary (multi-line JSON) and flatten the per-group map."""
    path, nested = scratch(cat, "summary_src"), summary(cat)
    IO.write_summary_json(nested, path)
    s = IO.read_summary_json(cat.spark, path, nested.schema)
    return s.select("generalizability_verdict", F.explode("breakdown_by_trigger").alias("trigger_type", "m")) \
        .select("generalizability_verdict", "trigger_type", "m.*")


@register("sink_detail_csv")
def sink_detail_csv(cat: Catalog) -> DataFrame:
    """Per-function detail results with error columns, written as CSV."""
    from wattline.plans.metrics import azure_like
    d = P.error_columns(azure_like(cat)).select("hash_function", "trigger_type", "avg_duration_ms",
                                                "memory_allocated_mb", "invocation_count", "actual_wh", "predicted_wh",
                                                "absolute_error_wh", "percentage_error", "accuracy_pct")
    path = scratch(cat, "detail_csv")
    IO.write_csv(d, path)
    back = cat.spark.read.schema(d.schema).option("header", True).csv(path)
    return back.select(*[r9(c) if t == "double" else F.col(c) for c, t in back.dtypes])


@register("sink_append_result")
def sink_append_result(cat: Catalog) -> DataFrame:
    """Two analysis runs appended to one results table."""
    from wattline.plans.rowwise import prj_monthly_projection
    path = scratch(cat, "results")
    base = prj_monthly_projection(cat)
    for run in ("run-1", "run-2"):
        IO.append_results(base.withColumn("run", F.lit(run)), path)
    return cat.spark.read.parquet(path)


def saved_models(cat: Catalog, root: str, version: int = 1) -> str:
    """All three models, the scaler and the feature list below ``root``."""
    folder = f"{root}/v={version}"
    ST.save(cat.spark, ST.Models(list(FEATURE_ORDER), *(model(cat, k) for k in ST.KINDS)), folder)
    return folder


@register("sink_model")
def sink_model(cat: Catalog) -> DataFrame:
    """The artefact saved, loaded back and used: each model's scores of the
    test split, and whether they are those of the models in memory."""
    loaded = ST.load(cat.spark, saved_models(cat, scratch(cat, "models")))
    out = None
    for kind in ST.KINDS:
        mine = test_predictions(cat, kind).select("inv_id", F.col("predicted_wh").alias("own"))
        read = loaded.predict(kind, test_split(cat)).select("inv_id", F.col("prediction").alias("predicted_wh"))
        rows = read.join(mine, "inv_id").select(F.lit(kind).alias("model"), "inv_id", "predicted_wh", (F.col("predicted_wh") == F.col("own")).alias("same"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("str_gap_model")
def str_gap_model(cat: Catalog) -> DataFrame:
    """Live samples scored in the stream by the stored boosted model, as
    inputs that the function's profile and the sample give."""
    from wattline.operators.profiles import lookup_with_fallback, profile_fallback
    from wattline.session import materialize
    from wattline.streaming import monitor as MON
    root = scratch(cat, "served")
    saved_models(cat, root)
    prof = profile(cat, materialized=True)
    cols = [*NUMERIC_FEATURES, *CATEGORICAL]
    known = materialize(lookup_with_fallback(cat.v_live.select("function_name").distinct(), prof, profile_fallback(prof, list(NUMERIC_FEATURES), CATEGORICAL), cols))
    out = MON.run_scored(MON.event_stream(cat.spark, cat.sf_dir), known, root, FE.telemetry_features)
    return cat.spark.read.parquet(out).select("event_id", "function_name", r9("actual_wh"), r9("predicted_wh"), r9("gap_accuracy_pct"), "gap_verdict", "model_version")


@register("join_predictions_back")
def join_predictions_back(cat: Catalog) -> DataFrame:
    """Test-split predictions (carrying only the row id) joined back to the
    original invocation attributes on that id."""
    preds = hash_split(cat.v_pred.select("inv_id", "predicted_wh"), "inv_id", SPLITS) \
        .where(F.col("split") == "test").drop("split")
    attrs = cat.v_inv.select("inv_id", "function_name", "trigger_type", "memory_mb", "latency_ms")
    return preds.join(attrs, "inv_id", "inner")


@register("ml_split_stratified")
def ml_split_stratified(cat: Catalog) -> DataFrame:
    """80/20 then 80/20 of train, exact within each function type."""
    from wattline.operators.sampling import stratified_hash_split
    return stratified_hash_split(invocation_telemetry(cat.v_inv).select("inv_id", "function_type"), "inv_id", "function_type", SPLITS)
