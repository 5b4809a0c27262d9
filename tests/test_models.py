import threading

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from cohortry.ml import members
from cohortry.ml.ensemble import EnsembleClassifier, EnsembleModel
from cohortry.ml.members import Member, default_members
from cohortry.ml.tuning import METRICS, RANGES, cross_validate, draw_params, model_based_search, parzen_search, random_search
from cohortry.operators import vote
from cohortry.pipeline import train, train_sources
from cohortry.sources.warehouse import model_info

FEATURES = ["a", "b", "c", "flag"]
SMALL = [Member("boosted", {"rounds": 4, "depth": 3}), Member("forest", {"numTrees": 5, "maxDepth": 4}),
         Member("logistic", {"maxIter": 20}), Member("network", {"hidden": [6], "maxIter": 40})]


@pytest.fixture(scope="module")
def learning(spark):
    """Three classes that three numbers tell apart, with noise; seeded."""
    rng = np.random.default_rng(42)
    y = rng.integers(0, 3, 600)
    x = rng.normal(size=(600, 3)) + np.array([[0, 0, 3], [3, 0, 0], [0, 3, 0]])[y]
    rows = [(int(i), int(k), *map(float, v), bool(v[0] > 0)) for i, (k, v) in enumerate(zip(y, x))]
    return spark.createDataFrame(rows, "id int, y int, a double, b double, c double, flag boolean").cache()


@pytest.fixture(scope="module")
def fitted(learning):
    return EnsembleClassifier(SMALL, "weighted_voting", [0.3, 0.3, 0.2, 0.2]).fit(learning, FEATURES, "y")


def test_hard_vote_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([(0, 1, 1), (2, 1, 0), (2, 2, 0)], "a int, b int, c int")
    assert [r["v"] for r in df.select(vote.hard_vote(["a", "b", "c"]).alias("v")).collect()] == [1, 0, 2]


def test_soft_vote(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.5, 0.5, 0.0], [0.0, 0.1, 0.9])], "p array<double>, q array<double>, r array<double>")
    mean = df.select(vote.soft_vote(["p", "q", "r"]).alias("s")).first()["s"]
    assert np.allclose(mean, [1 / 3, 1.1 / 3, 0.3])
    weighted = df.select(vote.soft_vote(["p", "q", "r"], [1, 1, 8]).alias("s")).first()["s"]
    assert np.allclose(weighted, [0.1, 0.18, 0.72])
    assert df.select(vote.soft_class("p").alias("c")).first()["c"] == 0
    with pytest.raises(ValueError):
        vote.soft_vote(["p", "q"], [1])
    with pytest.raises(ValueError):
        vote.soft_vote([])


def test_bad_ensembles(learning):
    with pytest.raises(ValueError):
        EnsembleClassifier([]).fit(learning, FEATURES, "y")
    with pytest.raises(ValueError):
        EnsembleClassifier(SMALL, "stacking").fit(learning, FEATURES, "y")
    with pytest.raises(ValueError):
        EnsembleClassifier(SMALL, weights=[1.0]).fit(learning, FEATURES, "y")
    assert [m.kind for m in default_members({"leafwise": {"rounds": 3}})] == ["boosted", "leafwise", "symmetric", "network"]


def test_every_member_gives_probabilities(fitted, learning):
    scored = fitted.probabilities(learning).select(*[f"p_{i}" for i in range(4)]).collect()
    for row in scored:
        for p in row:
            assert len(p) == 3 and abs(sum(p) - 1) < 1e-6 and min(p) >= 0


def test_evaluation(fitted, learning):
    row = fitted.evaluate(learning, "y").first()
    assert set(row.asDict()) == set(METRICS) and row["accuracy"] > 0.9 and row["roc_auc"] > 0.95
    assert row["recall"] == pytest.approx(row["accuracy"])


def test_voting_uses_the_most_frequent_class(fitted, learning):
    hard = EnsembleModel(fitted.kinds, fitted.models, fitted.features, 3, "voting")
    out = hard.transform(learning)
    members = fitted.probabilities(learning).select("id", *[f"p_{i}" for i in range(4)])
    want = {}
    for r in members.collect():
        votes = [int(np.argmax(p)) for p in list(r)[1:]]
        want[r["id"]] = min(set(votes), key=lambda c: (-votes.count(c), c))
    assert {r["id"]: r["prediction"] for r in out.collect()} == want


def test_prediction_rows(fitted, learning):
    row = fitted.predict(learning.withColumnRenamed("id", "patient_id")).first()
    assert row["response_probability"] == max(row["all_probabilities"].values())
    assert row["all_probabilities"][row["predicted_treatment"]] == row["response_probability"]
    assert len(row["alternative_treatments"]) == 2 and 0 <= row["confidence"] <= 1


def test_save_and_load(fitted, learning, spark, tmp_path):
    path = str(tmp_path / "model")
    fitted.save(path)
    loaded = EnsembleModel.load(spark, path)
    assert loaded.weights == [0.3, 0.3, 0.2, 0.2] and loaded.kinds == list(fitted.kinds)
    a = {r["id"]: r["probabilities"] for r in fitted.transform(learning).collect()}
    b = {r["id"]: r["probabilities"] for r in loaded.transform(learning).collect()}
    assert all(np.allclose(a[i], b[i]) for i in a)


def test_importance(fitted):
    table = fitted.importance()
    ranks = {(r["member"], r["rank"]) for r in table.collect()}
    assert ranks == {(m, i) for m in ("boosted", "forest", "logistic") for i in range(1, 5)}
    assert table.filter("rank = 4 and feature = 'flag'").count() >= 1


def test_parameter_ranges():
    import random

    drawn = draw_params("boosted", random.Random(1))
    assert drawn == draw_params("boosted", random.Random(1))
    low, high = RANGES["boosted"]["rounds"]
    assert low <= drawn["rounds"] <= high and 0.6 <= drawn["feature_share"] <= 1.0
    assert draw_params("logistic", random.Random(1)) == {}


def test_model_based_search_beats_uniform_draws():
    import random

    ranges = RANGES["boosted"]
    shares = lambda p: [(p[n] - low) / (high - low) for n, (low, high) in ranges.items()]
    score = lambda p: -sum((x - 0.3) ** 2 for x in shares(p))
    wins = []
    for seed in range(40):
        found = model_based_search(score, ranges, 30, seed=seed)
        assert found == model_based_search(score, ranges, 30, seed=seed) and len(found) == 30
        assert all(0 <= x <= 1 for p, _ in found for x in shares(p)) and all(isinstance(p["depth"], int) for p, _ in found)
        rng = random.Random(seed)
        wins.append(max(s for _, s in found) - max(score(draw_params("boosted", rng)) for _ in range(30)))
    assert sum(w > 0 for w in wins) >= 25 and sum(wins) > 0
    assert model_based_search(score, ranges, 0) == []


@pytest.mark.slow
def test_search_and_cross_validation(learning):
    parts = learning.randomSplit([0.7, 0.3], 1)
    best, trials = random_search("forest", parts[0], parts[1], FEATURES, "y", [0, 1, 2], trials=2,
                                 ranges={"numTrees": (2, 4), "maxDepth": (2, 4)})
    scores = {r["params"]: r["f1_score"] for r in trials.collect()}
    assert str(sorted(best.items())) == max(scores, key=scores.get) and trials.count() == 2
    best, trials = parzen_search("forest", parts[0], parts[1], FEATURES, "y", [0, 1, 2], trials=3, at_once=2,
                                 ranges={"numTrees": (2, 4), "maxDepth": (2, 4)})
    scores = {r["params"]: r["f1_score"] for r in trials.collect()}
    assert str(sorted(best.items())) == max(scores, key=scores.get) and trials.count() == 3
    cv = cross_validate(EnsembleClassifier([Member("logistic", {"maxIter": 10})]), learning, FEATURES, "id", "y", k=2).first()
    assert set(cv.asDict()) == set(METRICS) and cv["f1_score"] > 0.8


@pytest.mark.integration
def test_training_end_to_end(learning, spark, tmp_path):
    wide = learning.withColumn("note", F.lit("text")).withColumn("gap", F.lit(None).cast("double"))
    done = train(wide, "id", "y", members=SMALL[1:3], weights=[0.5, 0.5], model_path=str(tmp_path / "m"),
                 registry=str(tmp_path / "r"), version="v9")
    assert done.metrics["accuracy"] > 0.8 and "note" not in done.model.features and "gap" in done.model.features
    info = model_info(spark, str(tmp_path / "r")).first()
    assert info["version"] == "v9" and info["dataset_size"] == 420
    assert EnsembleModel.load(spark, str(tmp_path / "m")).transform(wide).count() == 600


@pytest.mark.integration
def test_training_from_files(spark, tmp_path):
    rng = np.random.default_rng(7)
    lines = ["patient_id,age,sex,seizure_type,seizure_frequency_per_month,age_at_onset,epilepsy_duration_years,"
             "previous_treatments,treatment_response"]
    for i in range(240):
        response = ["responder", "non_responder", "partial_responder"][i % 3]
        lines.append(f"PAT{i:03d},{20 + 20 * (i % 3) + rng.integers(8)},{'MF'[i % 2]},absence,{rng.uniform(0.5, 20):.3f},"
                     f"{rng.integers(5, 20)},{rng.uniform(1, 30):.3f},levetiracetam;lamotrigine,{response}")
    (tmp_path / "clinical.csv").write_text("\n".join(lines) + "\n")
    genes = ["patient_id,gene,variant,variant_type,allele_frequency,clinvar_significance"]
    genes += [f"PAT{i:03d},SCN1A,p.R{i}H,missense,0.01,Pathogenic" for i in range(0, 240, 2)]
    (tmp_path / "genetic.csv").write_text("\n".join(genes) + "\n")
    done = train_sources(spark, {"clinical": str(tmp_path / "clinical.csv"), "genetic": str(tmp_path / "genetic.csv")},
                         members=SMALL[1:2], weights=[1.0])
    assert done.metrics["accuracy"] > 0.9
    assert {"age", "n_variants", "has_epilepsy_gene"} <= set(done.model.features)
    assert not {"patient_id", "sex", "gene", "treatment_response_encoded"} & set(done.model.features)


def test_folds_are_fitted_side_by_side(spark):
    together = threading.Barrier(2, timeout=60)

    class Fitted:
        def evaluate(self, df, label):
            together.wait()  # breaks if the folds take turns
            n = float(df.count())
            return spark.createDataFrame([(n,) * len(METRICS)], ", ".join(f"{m} double" for m in METRICS))

    class Classifier:
        def fit(self, df, features, label):
            return Fitted()

    rows = spark.createDataFrame([(i, 0) for i in range(40)], "k int, y int")
    assert cross_validate(Classifier(), rows, ["k"], "k", "y", k=4).first()["accuracy"] == 10.0


def test_a_network_learns_from_rows_dealt_over_the_cores(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(members, "SPREAD_FROM", 10)
    monkeypatch.setattr(Pipeline, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()))
    rows = spark.range(100).coalesce(1)
    members.Member("network").fit(rows, "y", 3, 1, 42, 100)
    members.Member("network").fit(rows, "y", 3, 1, 42, 9)
    assert seen[0] >= spark.sparkContext.defaultParallelism > seen[1] == 1
