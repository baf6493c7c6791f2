"""Gap analysis: live measurements against the model's prediction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.config import DEFAULT_MODEL, RANGE_CHECK_FEATURES, EnergyModel
from wattline.functions import energy as E
from wattline.operators.checks import out_of_range

FLOOR_WH = 0.0001


def gap_report(inputs: DataFrame, live: DataFrame, train: DataFrame, target_max: DataFrame,
               scorer: Callable[[DataFrame], DataFrame], key: str = "function_name", m: EnergyModel = DEFAULT_MODEL) -> DataFrame:
    """One row per live function.

    ``inputs``: model inputs per function; ``live``: (key, avg_duration_ms,
    max_memory_mb, ...).  A positive live duration replaces the duration
    input, a positive live memory both memory inputs.  The raw prediction is
    range-checked with the inputs; only then a negative one is replaced by the
    floor (zero stays zero)."""
    j = inputs.join(live, key, "inner")
    dur, mem = F.col("avg_duration_ms"), F.col("max_memory_mb")
    j = j.withColumns({"aws_duration_ms": F.when(dur > 0, dur).otherwise(F.col("aws_duration_ms")),
                       "memory_config_mb": F.when(mem > 0, mem).otherwise(F.col("memory_config_mb")),
                       "aws_memory_used_mb": F.when(mem > 0, mem).otherwise(F.col("aws_memory_used_mb"))})
    scored = out_of_range(scorer(j), train, RANGE_CHECK_FEATURES, "prediction", target_max,
                          high=m.gap_confidence_high, low=m.gap_confidence_low)
    raw = F.col("prediction")
    out = scored.withColumns({"actual_wh": E.energy_wh("max_memory_mb", "avg_duration_ms"),
                              "predicted_wh": F.when(raw < 0, F.lit(FLOOR_WH)).otherwise(raw)})
    error = F.abs(F.col("predicted_wh") - F.col("actual_wh"))
    acc = 100.0 - error / F.greatest(F.col("actual_wh"), F.lit(0.0001)) * 100.0
    return out.withColumns({"absolute_error_wh": error, "accuracy_pct": acc}).withColumn(
        "verdict", F.when(F.col("accuracy_pct") >= m.gap_excellent_pct, "Excellent")
        .when(F.col("accuracy_pct") >= m.gap_good_pct, "Good").otherwise("Needs Review"))
