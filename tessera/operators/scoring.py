"""Probabilities of pairs: a fixed rule as one expression, trained trees by MLlib, the threshold."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.functions.similarity import logistic
from tessera.operators.pairs import FEATURES


def small_ensemble() -> Column:
    """Three small trees over native features, as CASE expressions; for tests and as a model where none is trained."""
    c = F.col
    first = F.when(c("f1_n_exact") > 0.5, 2.0).when(c("f4_n_jaccard") > 0.5, 1.0).otherwise(-1.5)
    second = F.when(c("f10_a_jaccard") > 0.6, 1.5).when(c("f6_n_ngram") > 0.4, 0.5).otherwise(-0.8)
    third = F.when(c("f8_n_prefix") > 0.5, 0.6).otherwise(-0.4) - F.when(c("f7_n_len_diff") > 8, 0.5).otherwise(0.0)
    return logistic([(1.0, first), (1.0, second), (1.0, third), (0.5, c("f5_n_overlap"))], -0.25)


def score(features: DataFrame, threshold: float = DEFAULT.threshold) -> DataFrame:
    """s1_id, target_id, prob of the pairs with prob >= threshold."""
    # The generator keeps the features from being made anew for every place of the expression and of the filter.
    prob = F.explode(F.array(F.round(small_ensemble(), 6)))
    used = ("f1_n_exact", "f4_n_jaccard", "f5_n_overlap", "f6_n_ngram", "f7_n_len_diff", "f8_n_prefix", "f10_a_jaccard")
    once = features.select("s1_id", "target_id", F.explode(F.array(F.struct(*used))).alias("f")).select("s1_id", "target_id", "f.*")
    return once.select("s1_id", "target_id", prob.alias("prob")).where(F.col("prob") >= threshold)


def train(features: DataFrame, trees: int = 250, rate: float = 0.05, depth: int = 6, seed: int = DEFAULT.seed, validation: str | None = None, columns: tuple[str, ...] = FEATURES) -> PipelineModel:
    """Gradient-boosted trees on the feature columns and a label; validation names a boolean column that stops early."""
    trees_ = GBTClassifier(labelCol="label", featuresCol="x", maxIter=trees, stepSize=rate, maxDepth=depth, seed=seed)
    if validation:
        trees_ = trees_.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="x"), trees_]).fit(features)


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """The features with prob, the probability of a match."""
    return model.transform(features).withColumn("prob", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
