"""Baselines that a model has to beat, fitted with Spark ML on one split and scored on another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASSIFIERS = ("prior", "logistic", "trees", "perceptron")
REGRESSORS = ("mean", "ridge", "trees")


def _vectors(train: DataFrame, features: Sequence[str]):
    """Standardised feature vectors by the training rows' moments; rows with a null or NaN feature go."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="raw_vector", handleInvalid="skip"),
            StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True, withStd=True),
        ]
    ).fit(train)


def _constant(train: DataFrame, value: Column, rows: DataFrame, name: str) -> DataFrame:
    return rows.crossJoin(F.broadcast(train.agg(F.coalesce(value, F.lit(0.0)).alias(name))))  # exactly one row


def classified(train: DataFrame, rows: DataFrame, features: Sequence[str], label: str = "label", models: Sequence[str] = CLASSIFIERS, trees: int = 300, hidden: int = 64, seed: int = 7) -> DataFrame:
    """rows with p_<model>, the probability of label 1, for each baseline.

    prior is the training share of label 1; logistic weighs both labels alike; trees are boosted, of depth 4 at rate 0.05;
    perceptron has one hidden layer. Rows with a null or NaN feature are neither learnt from nor scored; training rows
    without a label aren't learnt from. Training rows need both labels.
    """
    known = train.where(F.col(label).isNotNull())
    vectors = _vectors(known, features)
    known, rows = vectors.transform(known).withColumn("target", F.col(label).cast("double")), vectors.transform(rows)
    share = known.agg(F.avg("target").alias("share"))
    known = known.crossJoin(F.broadcast(share))  # exactly one row
    known = known.withColumn("weight", F.when(F.col("target") == 1, 0.5 / F.col("share")).otherwise(0.5 / (1 - F.col("share"))))
    known = known.select("vector", "target", "weight").persist()  # the fits read it again and again
    common = {"featuresCol": "vector", "labelCol": "target", "predictionCol": "guess"}
    for name in models:
        if name == "prior":
            rows = _constant(known, F.avg("target"), rows, "p_prior")
            continue
        maker = {
            "logistic": lambda: LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=200, standardization=False, **common),
            "trees": lambda: GBTClassifier(maxDepth=4, stepSize=0.05, maxIter=trees, seed=seed, **common),
            "perceptron": lambda: MultilayerPerceptronClassifier(layers=[len(features), hidden, 2], seed=seed, **common),
        }[name]
        model = maker().setRawPredictionCol("raw_score").setProbabilityCol("chances").fit(known)
        rows = model.transform(rows).withColumn(f"p_{name}", vector_to_array("chances")[1]).drop("raw_score", "chances", "guess")
    known.unpersist()
    return rows.drop("raw_vector", "vector")


def regressed(train: DataFrame, rows: DataFrame, features: Sequence[str], target: str, models: Sequence[str] = REGRESSORS, trees: int = 300, ridge: float = 1e-3, seed: int = 7) -> DataFrame:
    """rows with mu_<model>, the expected target, for each baseline; null and NaN features as in classified()."""
    known = train.where(F.col(target).isNotNull())
    vectors = _vectors(known, features)
    known, rows = vectors.transform(known).select("vector", F.col(target).cast("double").alias("target")).persist(), vectors.transform(rows)
    common = {"featuresCol": "vector", "labelCol": "target"}
    for name in models:
        if name == "mean":
            rows = _constant(known, F.avg("target"), rows, "mu_mean")
            continue
        maker = {
            "ridge": lambda: LinearRegression(regParam=ridge, elasticNetParam=0.0, standardization=False, predictionCol="mu_ridge", **common),
            "trees": lambda: GBTRegressor(maxDepth=4, stepSize=0.05, maxIter=trees, seed=seed, predictionCol="mu_trees", **common),
        }[name]
        rows = maker().fit(known).transform(rows)
    known.unpersist()
    return rows.drop("raw_vector", "vector")
