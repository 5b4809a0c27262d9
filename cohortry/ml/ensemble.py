"""Voting ensemble: fit, score, save, load."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry import schemas
from cohortry.functions.scalar import entropy_confidence, label_of, rank_alternatives
from cohortry.ml.boosting import GROWTHS, BoostedModel
from cohortry.ml.members import FEATURES, Member, assemble, with_probabilities
from cohortry.operators.aggregate import evaluate
from cohortry.operators.vote import hard_vote, soft_class, soft_vote
from cohortry.plans.session import cut_lineage

METHODS = ("voting", "weighted_voting")


@dataclass(frozen=True)
class EnsembleModel:
    """Fitted members and how their votes are joined."""

    kinds: Sequence[str]
    models: Sequence[PipelineModel | BoostedModel]
    features: Sequence[str]
    n_classes: int
    method: str = "weighted_voting"
    weights: Sequence[float] | None = None

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Add one probability array per member (``p_0``..) in a single pass over the rows."""
        scored = assemble(df, self.features)
        for i, (kind, model) in enumerate(zip(self.kinds, self.models)):
            scored = with_probabilities(model, kind, scored, f"p_{i}")
        return scored.drop(FEATURES)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probabilities`` (the joined array) and ``prediction`` (a class id)."""
        names = [f"p_{i}" for i in range(len(self.kinds))]
        scored = self.probabilities(df)
        weights = self.weights if self.method == "weighted_voting" else None
        scored = scored.withColumn("probabilities", soft_vote(names, weights, self.n_classes))
        if self.method == "weighted_voting":
            return scored.withColumn("prediction", soft_class("probabilities")).drop(*names)
        return scored.withColumn("prediction", hard_vote([soft_class(n) for n in names])).drop(*names)

    def evaluate(self, df: DataFrame, label: str) -> DataFrame:
        """The five metrics. The scored rows are written once, as two reports read them."""
        scored = cut_lineage(self.transform(df).select(label, "prediction", "probabilities"))
        return evaluate(scored, label, "prediction", "probabilities", list(range(self.n_classes)))

    def predict(self, df: DataFrame, labels: Mapping[int, str] = schemas.TREATMENT_LABELS,
                patient_id: str = "patient_id") -> DataFrame:
        """Best label, its probability, confidence, the next two labels and all probabilities."""
        scored = self.transform(df)
        p = F.col("probabilities")
        ranked = rank_alternatives(p, labels)
        every = F.map_from_entries(
            F.transform(p, lambda x, i: F.struct(F.coalesce(label_of(i, labels), i.cast("string")), x))
        )
        return scored.select(
            patient_id,
            label_of("prediction", labels).alias("predicted_treatment"),
            F.array_max(p).alias("response_probability"),
            entropy_confidence(p).alias("confidence"),
            ranked["alternative_treatments"].alias("alternative_treatments"),
            every.alias("all_probabilities"),
        )

    def importance(self) -> DataFrame:
        return feature_importance(self)

    def save(self, path: str) -> None:
        for i, model in enumerate(self.models):
            if isinstance(model, BoostedModel):
                model.save(f"{path}/member_{i}")
            else:
                model.write().overwrite().save(f"{path}/member_{i}")
        spark = SparkSession.getActiveSession()
        about = {
            "kinds": list(self.kinds), "features": list(self.features), "n_classes": self.n_classes,
            "method": self.method, "weights": list(self.weights) if self.weights is not None else None,
        }
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(
            f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EnsembleModel:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        load = lambda kind, at: BoostedModel.load(spark, at) if kind in GROWTHS else PipelineModel.load(at)
        models = [load(kind, f"{path}/member_{i}") for i, kind in enumerate(about["kinds"])]
        return cls(models=models, **about)


def side_by_side(spark: SparkSession, items: Sequence, work: Callable) -> list:
    """``work`` of each item, in order; the jobs of one fill the cores that those of another leave idle."""
    if len(items) < 2:
        return [work(item) for item in items]
    with ThreadPoolExecutor(len(items)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


@dataclass
class EnsembleClassifier:
    """Untrained ensemble. ``weighted_voting`` without weights is the plain mean."""

    members: Sequence[Member]
    method: str = "weighted_voting"
    weights: Sequence[float] | None = None
    seed: int = 42
    labels: Sequence[int] = field(default_factory=lambda: [0, 1, 2])

    def fit(self, df: DataFrame, features: Sequence[str], label: str, val: DataFrame | None = None) -> EnsembleModel:
        """Fit the members side by side. ``val`` rows end the rounds of the leafwise and symmetric members early."""
        if not self.members:
            raise ValueError("at least one member must be given")
        if self.method not in METHODS:
            raise ValueError(f"unsupported ensemble method: {self.method}")
        if self.method == "weighted_voting" and self.weights is not None and len(self.weights) != len(self.members):
            raise ValueError("the number of weights must match the number of members")
        k = len(self.labels)
        prepared = lambda d: assemble(d, features).select(FEATURES, F.col(label).cast("double").alias(label))
        rows, held = prepared(df).persist(StorageLevel.MEMORY_AND_DISK), None if val is None else prepared(val)
        try:
            n = rows.count()
            models = side_by_side(df.sparkSession, self.members,
                                  lambda m: m.fit(rows, label, k, len(features), self.seed, n, held))
        finally:
            rows.unpersist()
        return EnsembleModel([m.kind for m in self.members], models, list(features), k, self.method, self.weights)


def feature_importance(model: EnsembleModel) -> DataFrame:
    """(member, feature, importance, rank): split gains, or mean absolute coefficients."""
    rows = []
    for kind, fitted in zip(model.kinds, model.models):
        if kind in GROWTHS:
            values = fitted.importance()
        elif kind == "forest":
            values = fitted.stages[-1].featureImportances.toArray()
        elif kind == "logistic":
            values = abs(fitted.stages[-1].coefficientMatrix.toArray()).mean(axis=0)
        else:
            continue
        ordered = sorted(zip(model.features, values), key=lambda pair: (-pair[1], pair[0]))
        rows += [(kind, name, float(value), i) for i, (name, value) in enumerate(ordered, 1)]
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "member string, feature string, importance double, rank int")
