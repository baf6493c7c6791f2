"""Explanation tables in long form: (row_id, feature, value).

Groups are one explained row (bounded by the feature count), so windows per
row are small; global importances aggregate per feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wattline.functions.labels import feature_label

CODE_METRIC_FEATURES = ("lines_of_code", "num_loops", "num_conditionals", "cyclomatic_complexity",
                        "max_nesting_depth")


def top_attributions(df: DataFrame, value: str, k: int = 5, row: str = "row_id",
                     feature: str = "feature") -> DataFrame:
    w = Window.partitionBy(row).orderBy(F.desc(F.abs(value)), F.asc(feature))
    return (df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(row, "rank", feature, value,
                    F.when(F.col(value) >= 0, "increases").otherwise("decreases").alias("direction")))


def global_importance(df: DataFrame, value: str, feature: str = "feature") -> DataFrame:
    """Mean |attribution| per feature with its rank and share of the top."""
    imp = df.groupBy(feature).agg(F.avg(F.abs(value)).alias("importance"))
    # one row per feature: bounded, a global window is fine
    w = Window.orderBy(F.desc("importance"), F.asc(feature))
    return imp.select(feature, "importance", F.row_number().over(w).alias("rank"),
                      (F.col("importance") / F.max("importance").over(Window.partitionBy()) * 100.0)
                      .alias("relative_pct"))


def align_methods(shap: DataFrame, lime: DataFrame, keys=("row_id", "feature")) -> DataFrame:
    """SHAP rows left-joined with LIME weights; a missing weight is 0."""
    return (shap.join(lime, list(keys), "left")
            .withColumn("lime_weight", F.coalesce(F.col("lime_weight"), F.lit(0.0))))


def importance_normalised(shap_imp: DataFrame, lime_imp: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` features by SHAP importance, both importances scaled by
    their own maximum over those features (max 0 -> divide by 1)."""
    top = shap_imp.orderBy(F.desc("importance"), F.asc("feature")).limit(k) \
        .select("feature", F.col("importance").alias("shap_importance"))
    j = top.join(lime_imp.select("feature", F.col("importance").alias("lime_importance")), "feature", "left") \
        .withColumn("lime_importance", F.coalesce("lime_importance", F.lit(0.0)))
    w = Window.partitionBy()          # k rows
    ms = F.max("shap_importance").over(w)
    ml = F.max("lime_importance").over(w)
    return j.select("feature", F.coalesce(F.try_divide("shap_importance", F.when(ms != 0, ms).otherwise(1.0)), F.lit(0.0))
                    .alias("shap_norm"),
                    F.coalesce(F.try_divide("lime_importance", F.when(ml != 0, ml).otherwise(1.0)), F.lit(0.0))
                    .alias("lime_norm"))


def agreement(aligned: DataFrame, k: int = 10, row: str = "row_id") -> DataFrame:
    """Per row: sign agreement of the two methods on its top ``k`` features
    by |SHAP|; Strong >= 8, Moderate >= 5, else Low."""
    w = Window.partitionBy(row).orderBy(F.desc(F.abs("shap_value")), F.asc("feature"))
    top = aligned.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    agree = ((F.col("shap_value") >= 0) == (F.col("lime_weight") >= 0)).cast("int")
    g = top.groupBy(row).agg(F.sum(agree).alias("agreements"), F.count(F.lit(1)).alias("compared"))
    label = (F.when(F.col("agreements") >= 8, "Strong Agreement")
             .when(F.col("agreements") >= 5, "Moderate Agreement").otherwise("Low Agreement"))
    return g.withColumn("agreement", label)


def flow(attr: DataFrame, value: str, base: str, predicted: str, k: int = 5, row: str = "row_id") -> DataFrame:
    """Per explained row over its top ``k`` features: positive / negative
    totals in mWh, shares of base / positive / negative, difference of the
    prediction against the base in %, top driver and top code-level driver."""
    top = top_attributions(attr.select(row, "feature", value), value, k, row)
    rows = top.join(attr.select(row, base, predicted).distinct(), row, "inner")
    v = F.col(value) * 1000.0
    g = rows.groupBy(row).agg(
        F.sum(F.when(v >= 0, v).otherwise(0.0)).alias("total_pos_mwh"),
        F.sum(F.when(v < 0, F.abs(v)).otherwise(0.0)).alias("total_neg_mwh"),
        F.first(F.col(base) * 1000.0).alias("base_mwh"), F.first(F.col(predicted) * 1000.0).alias("predicted_mwh"),
        F.min_by("feature", "rank").alias("top_driver"),
        F.min_by(F.when(F.col("feature").isin(*CODE_METRIC_FEATURES), F.col("feature")),
                 F.when(F.col("feature").isin(*CODE_METRIC_FEATURES), F.col("rank"))).alias("top_code_driver"))
    tot = F.col("base_mwh") + F.col("total_pos_mwh") + F.col("total_neg_mwh")
    share = lambda c: F.when(tot > 0, F.col(c) / tot * 100.0).otherwise(F.lit(33.3))
    diff = (F.col("predicted_mwh") - F.col("base_mwh")) / F.greatest(F.col("base_mwh"), F.lit(0.001)) * 100.0
    return g.select(row, "base_mwh", "predicted_mwh", "total_pos_mwh", "total_neg_mwh",
                    share("base_mwh").alias("base_pct"), share("total_pos_mwh").alias("pos_pct"),
                    share("total_neg_mwh").alias("neg_pct"), diff.alias("diff_pct"),
                    F.when(diff >= 0, "higher").otherwise("lower").alias("relationship"),
                    feature_label(F.col("top_driver")).alias("top_driver"),
                    feature_label(F.col("top_code_driver")).alias("top_code_driver"))


def waterfall(attr: DataFrame, value: str, base: str, row: str = "row_id") -> DataFrame:
    """Attributions of each row ordered by |value|, running total from the
    base (mWh)."""
    w = Window.partitionBy(row).orderBy(F.desc(F.abs(value)), F.asc("feature"))
    cum = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return attr.select(row, "feature", F.row_number().over(w).alias("step"),
                       (F.col(value) * 1000.0).alias("value_mwh"),
                       ((F.col(base) + F.sum(value).over(cum)) * 1000.0).alias("cumulative_mwh"))
