"""Feature engineering: one-hot encoding, scaling, splits, feature vectors.

Fitted state (category lists, means / deviations) is small and lives on the
driver as literals in the plan, the way a fitted Spark ML model keeps its
parameters; the data itself never leaves the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.functions.labels import FEATURE_ORDER
from wattline.operators import projections as P


class OneHot:
    """Dummies for each category except the first in sort order (the
    dropped base), fitted with ``StringIndexer(alphabetAsc)``; ``frozen``
    pins the output columns (unknown categories encode as all zeros)."""

    def __init__(self, columns: Sequence[str], frozen: Sequence[str] | None = None):
        self.columns = list(columns)
        self.frozen = list(frozen) if frozen is not None else None
        self.levels: dict[str, list[str]] = {}

    def fit(self, df: DataFrame) -> "OneHot":
        for c in self.columns:
            model = StringIndexer(inputCol=c, outputCol=f"_{c}_idx", stringOrderType="alphabetAsc",
                                  handleInvalid="keep").fit(df.select(c))
            self.levels[c] = list(model.labels)
        return self

    def dummy_names(self) -> list[str]:
        if self.frozen is not None:
            return list(self.frozen)
        return [f"{c}_{v}" for c in self.columns for v in self.levels[c][1:]]

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        cols = [F.col(k) for k in keep]
        for name in self.dummy_names():
            col, _, val = next(((c, "_", name[len(c) + 1:]) for c in self.columns if name.startswith(c + "_")),
                               (None, None, None))
            expr = F.lit(0.0) if col is None else F.when(F.col(col) == val, 1.0).otherwise(0.0)
            cols.append(expr.alias(name))
        return df.select(*cols)


def usable_std(std: float, mean: float) -> float:
    """A deviation that is zero or only float noise (relative to the mean)
    is replaced by 1, so constant columns stay constant after scaling."""
    return std if std > 1e-9 * max(1.0, abs(mean)) else 1.0


class PopulationScaler:
    """``(x - mean) / std_pop`` with a zero (or float-noise) std replaced by
    1; the statistics come from one aggregation pass."""

    def __init__(self, columns: Sequence[str]):
        self.columns = list(columns)
        self.mean: dict[str, float] = {}
        self.std: dict[str, float] = {}

    def fit(self, df: DataFrame) -> "PopulationScaler":
        row = df.agg(*[x for c in self.columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
        for c in self.columns:
            self.mean[c] = float(row[f"m_{c}"] or 0.0)
            self.std[c] = usable_std(float(row[f"s_{c}"] or 0.0), self.mean[c])
        return self

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": (F.col(c) - self.mean[c]) / self.std[c] for c in self.columns})

    def inverse(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({c: F.col(f"{c}{suffix}") * self.std[c] + self.mean[c] for c in self.columns})


def scaled_by_aggregate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same scaling as a pure plan: statistics as a one-row aggregate
    joined by broadcast (for batch reports that should not run a job at
    definition time)."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    j = df.crossJoin(F.broadcast(stats))
    out = j.withColumns({f"{c}_scaled": (F.col(c) - F.col(f"_m_{c}")) /
                         F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns})
    return out.drop(*[x for c in columns for x in (f"_m_{c}", f"_s_{c}")])


def telemetry_features(tel: DataFrame, keep: Sequence[str] = ("inv_id",)) -> DataFrame:
    """Telemetry -> the 33 model inputs in model order (+ kept columns and
    the target).  Function-type and input-size dummies drop the first level
    in sort order; function-name dummies follow the frozen list, so names
    outside it encode as zeros."""
    t = tel.withColumns({
        "function_type_io": F.when(F.col("function_type") == "io", 1.0).otherwise(0.0),
        "function_type_memory": F.when(F.col("function_type") == "memory", 1.0).otherwise(0.0),
        "input_size_Medium": F.when(F.col("input_size") == "Medium", 1.0).otherwise(0.0),
        "input_size_Small": F.when(F.col("input_size") == "Small", 1.0).otherwise(0.0),
    })
    for f in FEATURE_ORDER:
        if f.startswith("function_name_"):
            t = t.withColumn(f, F.when(F.col("function_name") == f[len("function_name_"):], 1.0).otherwise(0.0))
    return P.align_features(t, FEATURE_ORDER, keep=[*keep, "energy_target_wh"])


def assemble(df: DataFrame, features: Sequence[str] = FEATURE_ORDER, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out,
                           handleInvalid="keep").transform(df)
