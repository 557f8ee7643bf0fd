"""Clustering and classification on ``pyspark.ml``."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetloom.operators.columns import complete_rows, fill_categories, min_max, training_rows, z_scores


def _vector(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("__features", array_to_vector(F.array(*(F.col(f"`{c}`").cast("double") for c in columns))))


def k_means(df: DataFrame, key: str, columns: list[str], k: int = 8, seed: int = 42, prefix: str = "", name: str = "cluster") -> DataFrame:
    """``df`` with the cluster of its z-scores as text; null where a column is missing."""
    ready = _vector(z_scores(complete_rows(df, columns), columns), columns)
    found = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="__c").fit(ready).transform(ready)
    return df.join(found.select(key, F.concat(F.lit(prefix), F.col("__c").cast("string")).alias(name)), key, "left")


def mixture_sweep(df: DataFrame, columns: list[str], sizes: range = range(6, 19), seed: int = 42, scale: bool = True) -> tuple[list[dict], dict]:
    """Gaussian mixtures of each size with their BIC, and the fitted models.

    A full-covariance mixture of ``k`` components in ``d`` columns has
    ``k - 1 + k d + k d (d + 1) / 2`` free numbers.
    """
    rows = complete_rows(df, columns)
    ready = _vector(min_max(rows, columns) if scale else rows, columns).select("__features").cache()
    n, d, out, models = ready.count(), len(columns), [], {}
    for k in sizes:
        model = GaussianMixture(k=k, seed=seed, featuresCol="__features").fit(ready)
        free = k - 1 + k * d + k * d * (d + 1) // 2
        out.append({"k": k, "bic": free * math.log(n) - 2 * model.summary.logLikelihood, "log_likelihood": model.summary.logLikelihood})
        models[k] = model
    ready.unpersist()
    return out, models


def apply_model(df: DataFrame, key: str, model, columns: list[str], name: str) -> DataFrame:
    """``df`` with the prediction of a saved clustering for its min-max scaled columns; null for incomplete rows."""
    ready = _vector(min_max(complete_rows(df, columns), columns), columns)
    found = model.transform(ready).select(key, F.col(model.getPredictionCol()).cast("string").alias(name))
    return df.join(found, key, "left")


def ward_linkage(means: np.ndarray) -> np.ndarray:
    """Merges of component means, two ids, distance and size a row; new clusters are numbered after the means."""
    sets = {i: (m.astype(float), 1) for i, m in enumerate(np.asarray(means))}
    out = []
    while len(sets) > 1:
        ids = sorted(sets)
        cost, a, b = min(
            (math.sqrt(2 * sets[a][1] * sets[b][1] / (sets[a][1] + sets[b][1])) * float(np.linalg.norm(sets[a][0] - sets[b][0])), a, b)
            for i, a in enumerate(ids) for b in ids[i + 1 :]
        )
        (ma, na), (mb, nb) = sets.pop(a), sets.pop(b)
        sets[len(means) + len(out)] = ((ma * na + mb * nb) / (na + nb), na + nb)
        out.append((a, b, cost, na + nb))
    return np.array(out, float).reshape(-1, 4)


def train_classifier(df: DataFrame, label: str, columns: list[str], categories: list[str] = (), excluded: list[str] = (), seed: int = 42) -> tuple[PipelineModel, float, dict[str, float]]:
    """A random forest on four fifths of the labelled rows: the model, accuracy on the rest, and importance of each column."""
    rows = fill_categories(training_rows(df, label, list(excluded)), list(categories)).fillna(0.0, list(columns))
    train, test = rows.randomSplit([0.8, 0.2], seed)
    indexed = [f"__i_{c}" for c in categories]
    stages = [StringIndexer(inputCol=label, outputCol="__y", handleInvalid="skip", stringOrderType="alphabetAsc")]
    stages += [StringIndexer(inputCol=c, outputCol=i, handleInvalid="keep") for c, i in zip(categories, indexed, strict=True)]
    stages += [VectorAssembler(inputCols=[*columns, *indexed], outputCol="__features"), RandomForestClassifier(featuresCol="__features", labelCol="__y", numTrees=40, maxDepth=6, maxBins=64, seed=seed)]
    model = Pipeline(stages=stages).fit(train)
    accuracy = MulticlassClassificationEvaluator(labelCol="__y", metricName="accuracy").evaluate(model.transform(test))
    weights = model.stages[-1].featureImportances.toArray().tolist()
    return model, accuracy, dict(zip([*columns, *categories], weights, strict=True))


def classify(df: DataFrame, model: PipelineModel, columns: list[str], categories: list[str] = (), name: str = "building_class") -> DataFrame:
    """``df`` with the predicted label as text."""
    names = model.stages[0].labels
    ready = fill_categories(df, list(categories)).fillna(0.0, list(columns))
    stages = PipelineModel(model.stages[1:]).transform(ready)
    label = F.element_at(F.array(*(F.lit(n) for n in names)), F.col("prediction").cast("int") + 1)
    return stages.select(*df.columns, label.alias(name))
