"""Boosted trees with Spark ML (distributed tree building).

GBTRegressor (Spark's gradient-boosted trees: no leaf L2 term, so its numbers
differ from other boosting libraries), a Pipeline stage after a
VectorAssembler; early stopping uses a validation-indicator column.  The
random forest is ``models/forest.py``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.functions.labels import FEATURE_ORDER

TARGET = "energy_target_wh"

# Model aliases accepted by the scoring path.
ALIASES = {"xgboost": "gbt", "gbt": "gbt", "random_forest": "rf", "rf": "rf",
           "neural_network": "mlp", "neural_net": "mlp", "nn": "mlp", "mlp": "mlp"}


def gbt_estimator(target: str = TARGET, max_iter: int = 1000, max_depth: int = 10, step: float = 0.1, seed: int = 42,
                  validation_col: str | None = "is_validation", validation_tol: float = 1e-5, max_bins: int = 256) -> GBTRegressor:
    """At most ``max_iter`` trees; with a validation column, boosting ends at
    the first tree that improves its error by less than the tolerance."""
    extra = {"validationIndicatorCol": validation_col, "validationTol": validation_tol} if validation_col else {}
    return GBTRegressor(featuresCol="features", labelCol=target, maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                        subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, maxBins=max_bins, maxMemoryInMB=1024, **extra)


def fit(train: DataFrame, features: Sequence[str] = FEATURE_ORDER, **params) -> PipelineModel:
    """``train`` holds the feature columns, the target and a boolean
    ``is_validation`` column."""
    # a column that never varies can't split; in the trees' feature subsets it
    # would only take the place of one that can
    row = train.agg(*[(F.min(f) != F.max(f)).alias(f) for f in features]).first()
    used = [f for f in features if row[f]] or list(features)
    asm = VectorAssembler(inputCols=used, outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[asm, gbt_estimator(**params)]).fit(train)


def predict(model: PipelineModel, df: DataFrame, floor: float | None = 0.0, out: str = "prediction") -> DataFrame:
    """Batch scoring; predictions clipped at ``floor`` (0 in batch jobs,
    0.0001 online).  The assembled vector is dropped again."""
    p = model.transform(df).drop("features")
    if floor is not None:
        p = p.withColumn(out, F.greatest(F.lit(float(floor)), F.col("prediction")))
    elif out != "prediction":
        p = p.withColumnRenamed("prediction", out)
    return p


def importances(spark: SparkSession, model: PipelineModel, features: Sequence[str] = FEATURE_ORDER) -> DataFrame:
    """Normalised feature importances of the fitted ensemble, ranked (one
    row per model input)."""
    imp = dict(zip(model.stages[0].getInputCols(), model.stages[-1].featureImportances.toArray().tolist()))
    total = sum(imp.values()) or 1.0
    rows = [(f, float(imp.get(f, 0.0)) / total) for f in features]
    df = spark.createDataFrame(rows, "feature string, importance double")
    from pyspark.sql import Window
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
