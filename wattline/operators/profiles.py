"""Telemetry compilation, function profiles, lookups with fallback, live
overrides and metric roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.config import DEFAULT_CODE_METRICS, NUMERIC_FEATURES
from wattline.functions import energy as E
from wattline.models.codemetrics import source_metrics
from wattline.operators import projections as P
from wattline.operators.quantiles import grouped_percentiles

TELEMETRY_NUMERIC = (
    "memory_config_mb", "cold_start", "lines_of_code", "num_loops", "num_conditionals", "num_function_calls",
    "cyclomatic_complexity", "max_nesting_depth", "local_duration_ms", "local_cpu_percent", "local_memory_mb",
    "local_energy_wh", "aws_duration_ms", "aws_memory_used_mb", "aws_cold_start", "aws_energy_estimate_wh",
    "duration_ratio", "memory_efficiency", "energy_target_wh", "calibration_ratio",
)
CODE_METRICS = tuple(DEFAULT_CODE_METRICS)


def parsed_code_metrics(docs: DataFrame, key: Column, text: str = "text") -> DataFrame:
    """Static metrics of each function's source from its parsed code, one
    source per function: LOC (at least 1), loops, conditionals, calls, deepest
    nesting and the mean complexity of its blocks (1 without any)."""
    src = docs.select(key.alias("bundle"), key.alias("path"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    m = source_metrics(src)
    cc = F.when(F.col("cc_blocks") > 0, F.col("cc_sum") / F.col("cc_blocks")).otherwise(F.lit(1.0))
    return m.select(F.col("bundle").alias("function_name"), F.greatest(F.lit(1), F.col("loc")).cast("double").alias("lines_of_code"),
                    *[F.col(c).cast("double").alias(c) for c in ("num_loops", "num_conditionals", "num_function_calls")],
                    cc.cast("double").alias("cyclomatic_complexity"), F.col("max_nesting_depth").cast("double").alias("max_nesting_depth"))


def invocation_telemetry(inv: DataFrame) -> DataFrame:
    """The telemetry columns that depend on the invocation only (no code
    metrics): type, input size, memory, cold start, local / cloud figures,
    derived ratios and targets."""
    ftype = (F.when(F.lower("trigger_type").isin("queue", "event"), "io")
             .when(F.lower("trigger_type") == "storage", "memory").otherwise("cpu"))
    size = F.when(F.col("quantity") < 17, "Small").when(F.col("quantity") < 34, "Medium").otherwise("Large")
    d = P.derived_ratios(inv.withColumn("memory_config_mb", F.col("memory_mb").cast("double")),
                         "memory_config_mb", "latency_ms")
    return d.select(
        "inv_id", "function_name", ftype.alias("function_type"), size.alias("input_size"),
        "memory_config_mb", F.col("cold_start").cast("int").alias("cold_start"),
        "local_duration_ms", (15.0 + (F.col("tax") - 0.04) * 50.0).alias("local_cpu_percent"),
        "local_memory_mb", "local_energy_wh", F.col("latency_ms").alias("aws_duration_ms"),
        (F.col("memory_config_mb") * (0.5 + F.col("discount") * 5.0)).alias("aws_memory_used_mb"),
        F.col("cold_start").cast("double").alias("aws_cold_start"),
        E.energy_wh("memory_config_mb", "latency_ms").alias("aws_energy_estimate_wh"),
        "duration_ratio", "memory_efficiency", "energy_target_wh", "calibration_ratio")


def profile_from_parts(inv: DataFrame, code: DataFrame, numeric: Sequence[str] = TELEMETRY_NUMERIC,
                       categorical: Sequence[str] = ("function_type", "input_size")) -> DataFrame:
    """The function profile without building the per-invocation telemetry:
    invocation columns are aggregated per function first (partial
    aggregation, so only one row per function and task is shuffled), then
    the per-function code metrics are joined at function granularity (the
    mean of a per-function constant is the constant itself)."""
    tel = invocation_telemetry(inv)
    inv_cols = [c for c in numeric if c not in CODE_METRICS]
    agg = tel.groupBy("function_name").agg(*[F.avg(c).alias(c) for c in inv_cols],
                                           *[F.mode(c, deterministic=True).alias(c) for c in categorical])
    j = P.fill_defaults(agg.join(code, "function_name", "left"), DEFAULT_CODE_METRICS)
    return j.select("function_name", *[F.col(c).cast("double").alias(c) if c in CODE_METRICS else F.col(c)
                                       for c in numeric], *categorical)


def compile_telemetry(inv: DataFrame, code: DataFrame) -> DataFrame:
    """Invocations + code metrics + derived columns -> the 23-column
    telemetry table (plus ``inv_id``).  Code metrics missing for a function
    take the fixed defaults.  One left join on the function name."""
    j = inv.join(code, "function_name", "left")
    j = P.fill_defaults(j, DEFAULT_CODE_METRICS)
    ftype = (F.when(F.lower("trigger_type").isin("queue", "event"), "io")
             .when(F.lower("trigger_type") == "storage", "memory").otherwise("cpu"))
    size = F.when(F.col("quantity") < 17, "Small").when(F.col("quantity") < 34, "Medium").otherwise("Large")
    d = P.derived_ratios(j.withColumn("memory_config_mb", F.col("memory_mb").cast("double")),
                         "memory_config_mb", "latency_ms")
    return d.select(
        "inv_id", "function_name", ftype.alias("function_type"), size.alias("input_size"),
        "memory_config_mb", F.col("cold_start").cast("int").alias("cold_start"), *CODE_METRICS,
        "local_duration_ms", (15.0 + (F.col("tax") - 0.04) * 50.0).alias("local_cpu_percent"),
        "local_memory_mb", "local_energy_wh", F.col("latency_ms").alias("aws_duration_ms"),
        (F.col("memory_config_mb") * (0.5 + F.col("discount") * 5.0)).alias("aws_memory_used_mb"),
        F.col("cold_start").cast("double").alias("aws_cold_start"),
        E.energy_wh("memory_config_mb", "latency_ms").alias("aws_energy_estimate_wh"),
        "duration_ratio", "memory_efficiency", "energy_target_wh", "calibration_ratio")


def grouped_mode(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Most frequent non-null value per group, smallest on a tie.  Counts
    per (group, value) are partial aggregates, so a huge group is reduced on
    every task; only (group, value) pairs are shuffled afterwards."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    top = c.groupBy(*keys).agg(F.max("_n").alias("_mx"))
    j = c.join(top, list(keys), "inner") if keys else c.crossJoin(F.broadcast(top))
    return j.where(F.col("_n") == F.col("_mx")).groupBy(*keys).agg(F.min(value).alias(value))


def profile_fallback(profile: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """One row: exact median of each numeric and mode of each categorical
    over the profile table (the "typical unseen function")."""
    long = profile.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in numeric])).alias("kv")) \
        .select("kv.column", "kv.value")
    med = grouped_percentiles(long, ["column"], "value", {"median": 0.5}, large=True)
    wide = med.groupBy().pivot("column", list(numeric)).agg(F.first("median"))
    for c in categorical:
        wide = wide.crossJoin(grouped_mode(profile, [], c))
    return wide


def lookup_with_fallback(requests: DataFrame, profile: DataFrame, fallback: DataFrame,
                         columns: Sequence[str], name: str = "function_name") -> DataFrame:
    """Left join requests to the profile; a miss takes the fallback row's
    values (one row, broadcast) and ``is_fallback = true``."""
    prof = profile.select(name, *columns, F.lit(True).alias("_hit"))
    fb = fallback.select(*[F.col(c).alias(f"_fb_{c}") for c in columns])
    j = requests.join(prof, name, "left").crossJoin(F.broadcast(fb))
    return j.select(name, *[F.coalesce(F.col(c), F.col(f"_fb_{c}")).alias(c) for c in columns],
                    F.col("_hit").isNull().alias("is_fallback"))


def live_override(base: DataFrame, live: DataFrame, mapping: dict[str, str], key: str = "function_name",
                  positive_only: bool = True) -> DataFrame:
    """Replace base columns by live values where a live value exists (and is
    > 0 when ``positive_only``).  ``mapping``: base column -> live column."""
    j = base.join(live, key, "left")
    cols = []
    for c in base.columns:
        if c in mapping:
            lv = F.col(mapping[c])
            ok = lv.isNotNull() & (lv > 0) if positive_only else lv.isNotNull()
            cols.append(F.when(ok, lv).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def metric_rollup(points: DataFrame, requests: DataFrame, now: Column, key: str = "function_name") -> DataFrame:
    """Per function and metric: the statistic over hourly points of the last
    24 h, else of the last 14 days, else a default.  Average -> mean of
    bucket averages, Maximum -> max, Sum -> sum.  Defaults: duration 0,
    memory 128 MB, invocations 0, errors 0.  ``points``: (key, metric, ts,
    average, maximum, sum); ``now`` a column (e.g. from a one-row frame)."""
    age_h = (F.unix_timestamp(now) - F.unix_timestamp("ts")) / 3600.0
    p = points.where((age_h >= 0) & (age_h <= 14 * 24))
    in24 = age_h <= 24
    stats = p.groupBy(key).agg(*[x for m, stat in (("Duration", "average"), ("MaxMemoryUsed", "maximum"),
                                                   ("Invocations", "sum"), ("Errors", "sum"))
                                 for x in _window_stat(m, stat, in24)])
    r = requests.select(key).distinct().join(stats, key, "left")
    pick = lambda a, b: F.coalesce(F.col(a), F.col(b))
    dur, mem = pick("Duration_24", "Duration_14"), pick("MaxMemoryUsed_24", "MaxMemoryUsed_14")
    inv, err = pick("Invocations_24", "Invocations_14"), pick("Errors_24", "Errors_14")
    status = F.when(dur.isNotNull() | inv.isNotNull() | mem.isNotNull(), "live_aws").otherwise("live_aws_no_data")
    return r.select(key, F.coalesce(dur, F.lit(0.0)).alias("avg_duration_ms"),
                    F.coalesce(mem, F.lit(128.0)).alias("max_memory_mb"),
                    F.coalesce(inv, F.lit(0.0)).alias("invocations"), F.coalesce(err, F.lit(0.0)).alias("errors"),
                    status.alias("data_source"))


def _window_stat(metric: str, stat: str, in24: Column) -> list[Column]:
    is_m = F.col("metric") == metric
    v = F.col(stat)
    fn = {"average": F.avg, "maximum": F.max, "sum": F.sum}[stat]
    return [fn(F.when(is_m & in24, v)).alias(f"{metric}_24"), fn(F.when(is_m, v)).alias(f"{metric}_14")]


def hourly_points(live: DataFrame, key: str = "function_name") -> DataFrame:
    """Metric datapoints per function and hour from raw live events:
    Duration (average), MaxMemoryUsed (maximum), Invocations and Errors (sum)."""
    h = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    g = live.groupBy(key, h.alias("ts")).agg(
        F.avg("duration_ms").alias("_dur"), F.max(F.col("user_id") * 10.0).alias("_mem"),
        F.count(F.lit(1)).cast("double").alias("_inv"), F.sum(F.col("is_error")).cast("double").alias("_err"))
    return g.select(key, "ts", F.explode(F.array(
        F.struct(F.lit("Duration").alias("metric"), F.col("_dur").alias("average"),
                 F.col("_dur").alias("maximum"), F.col("_dur").alias("sum")),
        F.struct(F.lit("MaxMemoryUsed").alias("metric"), F.col("_mem").alias("average"),
                 F.col("_mem").alias("maximum"), F.col("_mem").alias("sum")),
        F.struct(F.lit("Invocations").alias("metric"), F.col("_inv").alias("average"),
                 F.col("_inv").alias("maximum"), F.col("_inv").alias("sum")),
        F.struct(F.lit("Errors").alias("metric"), F.col("_err").alias("average"),
                 F.col("_err").alias("maximum"), F.col("_err").alias("sum")))).alias("p")) \
        .select(key, "ts", "p.*")


MODEL_NUMERIC = NUMERIC_FEATURES
