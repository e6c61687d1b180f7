"""Pair classifiers: fitting, scoring, saving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.functions.features import FEATURES


def logistic(train: DataFrame, names: Sequence[str] = FEATURES, penalty: float = 1.0, rounds: int = 1000) -> PipelineModel:
    """L2 logistic regression; penalty is the inverse of the usual C, so regParam is penalty / rows."""
    n = train.count()
    lr = LogisticRegression(featuresCol="x", labelCol="y", regParam=penalty / max(n, 1), standardization=False, maxIter=rounds)
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="x"), lr]).fit(train)


def boosted(train: DataFrame, names: Sequence[str] = FEATURES, depth: int = 6, rate: float = 0.05, rounds: int = 60, seed: int = 2028, validation: str | None = None) -> PipelineModel:
    """Gradient-boosted trees; rows whose `validation` column is true stop the fit early. Not the reference's algorithm: quality is comparable, trees are not."""
    gbt = GBTClassifier(featuresCol="x", labelCol="y", maxDepth=depth, stepSize=rate, maxIter=rounds, seed=seed)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="x"), gbt]).fit(train)


def probabilities(model: PipelineModel, pairs: DataFrame, names: Sequence[str] = FEATURES) -> DataFrame:
    """pairs with p, the probability of a link; missing or non-finite features raise an error."""
    absent = [n for n in names if n not in pairs.columns]
    if absent:
        raise ValueError(f"features are missing: {absent}")
    bad = F.greatest(*(F.when(F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf")), 1).otherwise(0) for n in names)) > 0
    checked = pairs.where(F.when(bad, F.raise_error(F.lit("a feature is not finite")).cast("boolean")).otherwise(True))
    out = model.transform(checked)
    return out.withColumn("p", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
