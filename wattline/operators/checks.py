"""Data-quality checks: missing values, required inputs, training-range checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_values(df: DataFrame) -> DataFrame:
    """Null count per column, only columns with nulls: one aggregation pass
    (partial counts per task), then an unpivot of the single result row."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    long = counts.unpivot([], list(df.columns), "column_name", "missing_count")
    return long.where(F.col("missing_count") > 0)


def missing_inputs(requests: DataFrame, key: str, raw: Sequence[str], encoded: Sequence[str]) -> DataFrame:
    """Requests (key, inputs map<string, ...>) that can't be scored: some raw
    feature is missing and some encoded feature too.  Lists the raw ones."""
    lacking = lambda names: F.array_except(F.array(*[F.lit(n) for n in names]), F.map_keys("inputs"))
    r = requests.withColumn("inputs", F.coalesce("inputs", F.create_map().cast(dict(requests.dtypes)["inputs"])))
    return (r.select(key, lacking(raw).alias("_raw"), lacking(encoded).alias("_enc")).where((F.size("_raw") > 0) & (F.size("_enc") > 0))
            .select(key, F.concat(F.lit("Missing required features: "), F.array_join("_raw", ", ")).alias("message"), F.size("_raw").alias("n_missing")))


def missing_required(df: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Per row, the required inputs that are null (array_except on the
    present names); rows with nothing missing are dropped."""
    present = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in required]),
                       lambda x: x.isNotNull())
    missing = F.array_except(F.array(*[F.lit(c) for c in required]), present)
    return (df.select(*keys, missing.alias("_m"))
            .where(F.size("_m") > 0)
            .select(*keys, F.array_join("_m", ",").alias("missing"), F.size("_m").alias("n_missing")))


def training_bounds(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row of min / max per feature (partial aggregates: skew-proof)."""
    return train.agg(*[x for f in features for x in (F.min(f).alias(f"_min_{f}"), F.max(f).alias(f"_max_{f}"))])


def out_of_range(requests: DataFrame, train: DataFrame, features: Sequence[str], pred: str,
                 target_max: DataFrame, high: float = 0.9998, low: float = 0.5) -> DataFrame:
    """Flag rows with a feature outside ``[min - b, max + b]`` of the training
    data (``b`` = half the range, 1.0 when the range is 0), or a prediction
    <= 0 or above twice the largest training target; each reason is a
    readable sentence with the value and the range (one decimal).  The bounds are one
    row, so the cross join with a broadcast of it is a map-side projection."""
    bounds = training_bounds(train, features).crossJoin(target_max)
    j = requests.crossJoin(F.broadcast(bounds))
    flags = []
    for f in features:
        lo, hi = F.col(f"_min_{f}"), F.col(f"_max_{f}")
        rng = hi - lo
        buf = F.when(rng > 0, rng * 0.5).otherwise(F.lit(1.0))
        v = F.col(f).cast("double")
        text = F.format_string(f"{f} (%.1f) is out of typical range [%.1f, %.1f]", v, lo - buf, hi + buf)
        flags.append(F.when((v < lo - buf) | (v > hi + buf), text))
    p = F.col(pred)
    flags.append(F.when((p <= 0) | (p > F.col("target_max") * 2.0),
                        F.format_string("Predicted energy (%.4f Wh) is out of typical target bounds.", p)))
    reasons = F.filter(F.array(*flags), lambda x: x.isNotNull())
    return (j.withColumn("_r", reasons)
            .withColumns({"is_low_confidence": F.size("_r") > 0,
                          "reasons": F.array_join("_r", "; "),
                          "confidence": F.when(F.size("_r") > 0, F.lit(low)).otherwise(F.lit(high)),
                          "confidence_status": F.when(F.size("_r") > 0, "low").otherwise("high"),
                          # The two messages.
                          "confidence_message": F.when(F.size("_r") > 0, F.concat(
                              F.lit("this function's profile differs significantly from the training data; prediction may be less reliable. Reasons: "),
                              F.array_join("_r", "; "))).otherwise("Prediction is reliable based on training distribution similarity.")})
            .drop("_r", *[c for c in j.columns if c.startswith("_min_") or c.startswith("_max_")], "target_max"))
