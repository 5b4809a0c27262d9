"""The member models: boosted trees of three kinds, forest, regression and network, with a probability array as output."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.ml import boosting
from cohortry.plans.session import spread

FEATURES = "__features"
SPREAD_FROM = 50_000  # rows; a network learns from fewer as they lie
HIDDEN_LAYERS = [256, 128, 64]
KINDS = ("boosted", "leafwise", "symmetric", "network")  # the default ensemble; forest and logistic are there too


def assemble(df: DataFrame, columns: Sequence[str], name: str = FEATURES) -> DataFrame:
    """Feature vector; missing numbers count as 0, booleans as 0/1."""
    doubles = df.select(
        "*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__f{i}") for i, c in enumerate(columns)]
    )
    inputs = [f"__f{i}" for i in range(len(columns))]
    return VectorAssembler(inputCols=inputs, outputCol=name).transform(doubles).drop(*inputs)


@dataclass(frozen=True)
class Member:
    """A model kind with its parameters; untrained."""

    kind: str
    params: Mapping[str, object] = field(default_factory=dict)

    def fit(self, rows: DataFrame, label: str, n_classes: int, n_features: int, seed: int, n_rows: int,
            val: DataFrame | None = None) -> PipelineModel | boosting.BoostedModel:
        """Fit on rows with a vector column ``FEATURES``; boosted rounds always run to their end."""
        if self.kind in boosting.GROWTHS:
            settings = replace(boosting.GROWTHS[self.kind], **{"seed": seed} | dict(self.params))
            return boosting.fit(rows, FEATURES, n_features, label, n_classes, settings, None if self.kind == "boosted" else val)
        estimator = self.estimator(label, n_classes, n_features, seed, n_rows)
        if self.kind != "network" or n_rows < SPREAD_FROM:
            return estimator.fit(rows)
        dealt = spread(rows).persist(StorageLevel.MEMORY_AND_DISK)  # over a hundred passes, all of them arithmetic
        try:
            return estimator.fit(dealt)
        finally:
            dealt.unpersist()

    def estimator(self, label: str, n_classes: int, n_features: int, seed: int, n_rows: int) -> Pipeline:
        common = {"featuresCol": FEATURES, "labelCol": label}
        params = dict(self.params)
        if self.kind == "forest":
            model = RandomForestClassifier(**common, seed=seed, probabilityCol="__prob", rawPredictionCol="__raw",
                                           predictionCol="__pred", **{"numTrees": 100} | params)
            return Pipeline(stages=[model])
        if self.kind == "logistic":
            model = LogisticRegression(**common, probabilityCol="__prob", rawPredictionCol="__raw",
                                       predictionCol="__pred", family="multinomial", **params)
            return Pipeline(stages=[model])
        if self.kind == "network":
            hidden = params.pop("hidden", HIDDEN_LAYERS)
            scaler = StandardScaler(inputCol=FEATURES, outputCol="__sample_scaled", withMean=True, withStd=True)
            # the scaler divides by the sample deviation; the population deviation is wanted
            whole = math.sqrt(n_rows / (n_rows - 1)) if n_rows > 1 else 1.0
            to_population = ElementwiseProduct(
                scalingVec=Vectors.dense([whole] * n_features), inputCol="__sample_scaled", outputCol="__scaled")
            model = MultilayerPerceptronClassifier(
                featuresCol="__scaled", labelCol=label, layers=[n_features, *hidden, n_classes], seed=seed,
                probabilityCol="__prob", rawPredictionCol="__raw", predictionCol="__pred",
                **{"maxIter": 100} | params)
            return Pipeline(stages=[scaler, to_population, model])
        raise ValueError(f"unknown member kind: {self.kind}")


def default_members(best: Mapping[str, Mapping[str, object]] | None = None) -> list[Member]:
    best = best or {}
    return [Member(kind, best.get(kind, {})) for kind in KINDS]


def with_probabilities(model: PipelineModel | boosting.BoostedModel, kind: str, df: DataFrame, name: str) -> DataFrame:
    """Add the member's class probabilities as an array column."""
    if kind in boosting.GROWTHS:
        return model.with_probabilities(df, FEATURES, name)
    scored = model.transform(df).withColumn(name, vector_to_array("__prob"))
    return scored.drop("__raw", "__prob", "__pred", "__scaled", "__sample_scaled")
