"""Feature assembly, training and scoring with Spark's gradient-boosted trees."""

from __future__ import annotations

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


def normalised(rows: DataFrame, columns: list[str], depth: str, target: float) -> DataFrame:
    """The listed features divided by depth / target where that is positive."""
    scale = F.col(depth) / target
    return rows.withColumns({c: F.when(scale > 0, F.col(c) / scale).otherwise(F.col(c)) for c in columns})


def train(rows: DataFrame, features: list[str], label: str, classes: int = 2, rounds: int = 10, depth: int = 4) -> PipelineModel:
    """Binary: boosted trees; more classes: a forest. Missing features count as -1."""
    rows = rows.fillna(-1, features)
    tree = GBTClassifier(labelCol=label, featuresCol="model_features", maxIter=rounds, maxDepth=depth, seed=7) if classes == 2 else RandomForestClassifier(labelCol=label, featuresCol="model_features", numTrees=rounds, maxDepth=depth, seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="model_features"), tree]).fit(rows)


def score(model: PipelineModel, rows: DataFrame, features: list[str]) -> DataFrame:
    """Appends ``probabilities``, an array by class; raises if the model was trained on other features."""
    known = list(model.stages[0].getInputCols())
    if known != list(features):
        raise ValueError(f"the model knows {known}, not {features}")
    out = model.transform(rows.fillna(-1, features)).withColumn("probabilities", vector_to_array("probability"))
    return out.drop("model_features", "rawPrediction", "probability", "prediction")
