"""Prediction-quality metrics, overall and per category.

Every metric of a group comes out of one aggregation (one shuffle, partial
aggregation on each task), so a dominant category is pre-reduced map-side.
R2 is ``1 - SSE / SST`` (it may be negative), not SQL's ``regr_r2``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattline.config import DEFAULT_MODEL, EnergyModel
from wattline.functions import rounding as R
from wattline.operators.quantiles import grouped_percentiles

METRIC_COLS = ("r2", "mae", "rmse", "mape", "accuracy", "n")


def _metric_aggs(actual: str, pred: str) -> list[Column]:
    a, p = F.col(actual), F.col(pred)
    err = a - p
    safe = F.greatest(a, F.lit(1e-9))
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(err * err).alias("_sse"),
        (F.var_pop(a) * F.count(a)).alias("_sst"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.abs(err) / safe) * 100.0).alias("mape"),
        F.avg(F.greatest(F.lit(0.0), 100.0 - F.abs(err) / safe * 100.0)).alias("accuracy"),
    ]


def _finish(df: DataFrame, keys: Sequence[str], digits: int | None) -> DataFrame:
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    r2 = (F.when(n < 2, F.lit(0.0))
          .when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1.0 - F.col("_sse") / F.col("_sst")))

    def fmt(c: Column, name: str) -> Column:
        c = F.coalesce(c, F.lit(0.0))
        return (R.half_up(c, digits) if digits is not None else c).alias(name)

    return df.select(*keys, fmt(r2, "r2"), fmt(F.col("mae"), "mae"), fmt(F.col("rmse"), "rmse"),
                     fmt(F.col("mape"), "mape"), fmt(F.col("accuracy"), "accuracy"), n.alias("n"))


def regression_metrics(df: DataFrame, actual: str = "actual_wh", pred: str = "predicted_wh",
                       digits: int | None = 9) -> DataFrame:
    """One row: R2, MAE, RMSE, MAPE, mean floored accuracy, n (n < 2 -> R2 0,
    n = 0 -> all zeros)."""
    return _finish(df.agg(*_metric_aggs(actual, pred)), [], digits)


def metrics_by(df: DataFrame, group: Column | str, categories: Sequence, name: str,
               actual: str = "actual_wh", pred: str = "predicted_wh", others: str | None = "others",
               keep_empty: bool = True, digits: int | None = 9) -> DataFrame:
    """Metrics per category of a fixed list; values outside go to ``others``
    (or are dropped when ``others`` is None).  ``keep_empty`` emits a zero row
    (n = 0) for categories without rows, through a left join from the
    category list (a literal table of a few rows)."""
    g = F.col(group) if isinstance(group, str) else group
    cats = list(categories) + ([others] if others is not None else [])
    lit_cats = [F.lit(c) for c in categories]
    key = F.when(g.isin(*lit_cats), g).otherwise(F.lit(others)) if others is not None else g
    rows = df.select(key.alias(name), actual, pred).where(F.col(name).isNotNull())
    if others is None:
        rows = rows.where(F.col(name).isin(*lit_cats))
    agg = rows.groupBy(name).agg(*_metric_aggs(actual, pred))
    if keep_empty:
        kt = rows.schema[name].dataType
        dim = df.sparkSession.createDataFrame([(c,) for c in cats], [name]).select(F.col(name).cast(kt).alias(name))
        agg = F.broadcast(dim).join(agg, name, "left")
    return _finish(agg, [name], digits)


def transfer_verdict(r2: Column, m: EnergyModel = DEFAULT_MODEL) -> Column:
    return (F.when(r2 >= m.transfer_strong_r2, "STRONG").when(r2 >= m.transfer_moderate_r2, "MODERATE")
            .when(r2 >= m.transfer_limited_r2, "LIMITED").otherwise("WEAK"))


def ape(actual: str = "actual_wh", pred: str = "predicted_wh") -> Column:
    return F.abs(F.col(actual) - F.col(pred)) / F.greatest(F.col(actual), F.lit(1e-9)) * 100.0


def ape_distribution(df: DataFrame, actual: str = "actual_wh", pred: str = "predicted_wh") -> DataFrame:
    e = ape(actual, pred)
    return df.agg(*[(F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100.0).alias(name) for name, cond in (
        ("pct_le_5", e <= 5), ("pct_le_15", e <= 15), ("pct_le_30", e <= 30), ("pct_gt_30", e > 30))])


def fixed_width_histogram(df: DataFrame, value: Column, width: float, bins: int, lo: float = 0.0) -> DataFrame:
    """Counts per bin ``[lo + i w, lo + (i+1) w)``; values past the end are
    clipped into the last bin, which is closed on the right."""
    b = F.least(F.floor((F.greatest(value, F.lit(lo)) - lo) / width), F.lit(bins - 1)).cast("int")
    return df.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def equal_bins_histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """``bins`` equal bins over [min, max] (bounds from a one-row aggregate,
    broadcast); the maximum falls in the last bin."""
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    j = df.select(value).crossJoin(F.broadcast(bounds))
    w = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(w == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_lo")) / w), F.lit(bins - 1))).cast("int")
    return (j.select(b.alias("bin"), "_lo", "_hi").groupBy("bin")
            .agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("lo"), F.first("_hi").alias("hi")))


def box_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles (exact, skew-safe), whiskers at the furthest values inside
    1.5 IQR, and the outlier count, per group.  Second pass joins each row
    with its group's quartiles (one row per group)."""
    q = grouped_percentiles(df, list(keys), value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, large=True)
    q = q.withColumns({"iqr": F.col("q3") - F.col("q1")})
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    j = df.select(*keys, value).join(q, list(keys), "inner")
    v = F.col(value)
    inside = (v >= lo_f) & (v <= hi_f)
    return j.groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("n"))


def correlation_with(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of each feature with the target (one aggregation),
    unpivoted to (feature, corr), ranked descending and ascending."""
    from pyspark.sql import Window
    one = df.agg(*[F.corr(f, target).alias(f) for f in features])
    long = one.unpivot([], list(features), "feature", "corr")
    # a handful of rows (one per feature): a global window is bounded here
    return long.select("feature", "corr",
                       F.row_number().over(Window.orderBy(F.desc("corr"), "feature")).alias("rank_desc"),
                       F.row_number().over(Window.orderBy(F.asc("corr"), "feature")).alias("rank_asc"))


def describe(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """mean, median (exact), sample std, min, max of each column, per key."""
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_kv")) \
        .select(*keys, "_kv.column", "_kv.value")
    k = [*keys, "column"]
    base = long.groupBy(*k).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                F.min("value").alias("min"), F.max("value").alias("max"),
                                F.count("value").alias("count"))
    med = grouped_percentiles(long, k, "value", {"median": 0.5}, large=True)
    return base.join(med, k, "left")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns in one aggregation pass
    (k * (k - 1) / 2 partial aggregates), as a long (a, b, corr) table with
    both orientations and a unit diagonal."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("corr"))
                    for a, b in pairs]
                  + [F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"{a}__{b}").alias("corr"))
                     for a, b in pairs]
                  + [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("corr")) for c in columns])
    return one.select(F.explode(arr).alias("p")).select("p.a", "p.b", "p.corr")
