import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import aggregate as A
from cohortry.plans import ordered as O
from cohortry.plans.skew import fan_out_left_join, flag_repeated, small_side, split_hot


def test_running_total_against_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.choice(100_000, size=5_000, replace=False)
    df = spark.createDataFrame([(int(x % 2), float(x), int(x % 7)) for x in v], "g int, v double, n bigint")
    got = {(r["g"], r["v"]): (r["run_n"], r["total_n"]) for r in O.running_total(df, "v", ["n"], ["g"]).collect()}
    for g in (0, 1):
        mine = sorted(x for x in v if x % 2 == g)
        total = np.cumsum([x % 7 for x in mine])
        assert all(got[(g, float(x))] == (t, total[-1]) for x, t in zip(mine, total))


def test_dense_index_of_text(spark):
    names = [f"k{i * 37 % 3000}" for i in range(3000)]
    df = spark.createDataFrame([(n,) for n in names], "k string")
    got = {r["k"]: r["index"] for r in O.dense_index(df, "k").collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full(4000, 7.0), rng.normal(size=6000)])
    df = spark.createDataFrame([(float(v), None if i % 3 else float(v)) for i, v in enumerate(x)], "a double, b double")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    rows = {r["column"]: r for r in O.exact_quantiles(df, ["a", "b"], qs).collect()}
    assert np.allclose([rows["a"][f"q{i}"] for i in range(5)], np.quantile(x, qs))
    assert np.allclose([rows["b"][f"q{i}"] for i in range(5)], np.quantile(x[::3], qs))


def test_describe_and_box(spark):
    x = np.array([1.0, 2, 3, 4, 100])
    df = spark.createDataFrame([(float(v),) for v in x], "a double")
    row = A.describe_exact(df, ["a"]).first()
    assert (row["count"], row["mean"], row["p25"], row["p50"], row["p75"]) == (5, 22.0, 2.0, 3.0, 4.0)
    assert row["std"] == pytest.approx(x.std(ddof=1))
    box = A.box_stats(df, "a").first()
    assert (box["whisker_low"], box["whisker_high"], box["n_outliers"]) == (1.0, 4.0, 1)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (10.0,), (None,)], "a double")
    assert {r["bin"]: r["n"] for r in A.histogram(df, "a", 5).collect()} == {1: 2, 2: 0, 3: 0, 4: 0, 5: 1}
    one = spark.createDataFrame([(3.0,), (3.0,)], "a double")
    assert sum(r["n"] for r in A.histogram(one, "a", 4).collect()) == 2


def test_value_counts_share_counts_nulls(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    assert [tuple(r) for r in A.value_counts(df, "c").collect()] == [("a", 2, 50.0), ("b", 1, 25.0)]
    assert A.value_counts(df, "c", 1).count() == 1


def test_missing_report(spark):
    df = spark.createDataFrame([(None, 1, "x"), (None, None, "y")], "a int, b int, c string")
    assert [tuple(r) for r in A.missing_report(df).collect()] == [("a", 2, 100.0), ("b", 1, 50.0)]


def test_correlation_is_pairwise_complete(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, 4.1, None), (3.0, 5.9, 2.0), (4.0, 8.2, 0.5)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    m = {r["column"]: r for r in A.corr_matrix(df, ["a", "b", "c"]).collect()}
    x = np.array([[r[0], r[2]] for r in rows if r[2] is not None])
    assert m["a"]["c"] == pytest.approx(np.corrcoef(x.T)[0, 1]) and m["a"]["b"] == m["b"]["a"]


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    assert {r["class"]: r["weight"] for r in A.class_weights(df, "y").collect()} == {0: 8 / 12, 1: 2.0}


def test_metrics_with_a_class_never_predicted(spark):
    y, p = [0, 0, 1, 1, 2], [0, 1, 1, 1, 0]
    df = spark.createDataFrame(list(zip(y, p)), "y int, p int")
    row = A.classification_metrics(df, "y", "p").first()
    assert row["accuracy"] == pytest.approx(3 / 5)
    precision = (2 * 0.5 + 2 * (2 / 3) + 1 * 0) / 5
    assert row["precision"] == pytest.approx(precision) and row["recall"] == pytest.approx(3 / 5)


def _auc(labels, scores):
    pos, neg = scores[labels], scores[~labels]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def test_roc_auc_with_ties_against_pairs(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 300)
    p = np.round(rng.dirichlet([1, 1, 1], 300), 1)
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, p)], "y int, p array<double>")
    got = A.roc_auc_ovr(df, "y", "p", [0, 1, 2]).first()["roc_auc"]
    want = sum(_auc(y == c, p[:, c]) * (y == c).sum() for c in range(3)) / 300
    assert got == pytest.approx(want)
    one = df.filter("y = 0")
    assert A.roc_auc_ovr(one, "y", "p", [0, 1, 2]).first()["roc_auc"] == 0.0


def test_complete_view_does_not_fan_out(spark):
    patients = spark.createDataFrame([("1", "a", 1, "M"), ("2", "b", 2, "F")], "id string, patient_id string, age int, sex string")
    patients = patients.withColumn("created_at", F.lit(None).cast("timestamp")).withColumn("updated_at", F.lit(None).cast("timestamp"))
    cols = "patient_id string, seizure_type string, seizure_frequency_per_month double, age_at_onset int, " \
           "epilepsy_duration_years double, treatment_response string"
    clinical = spark.createDataFrame([("1", "x", 1.0, 1, 1.0, "r"), ("1", "x", 1.0, 1, 1.0, "r"), ("1", "y", 1.0, 1, 1.0, "r")], cols)
    child = spark.createDataFrame([("1", "t1"), ("1", "t2"), ("1", "t2")], "patient_id string, id string")
    rows = A.patient_complete_view(patients, clinical, child, child.limit(0)).collect()
    got = {(r["id"], r["seizure_type"]): (r["total_treatments"], r["total_genetic_variants"]) for r in rows}
    assert got == {("1", "x"): (2, 0), ("1", "y"): (2, 0), ("2", None): (0, 0)}


def test_prediction_stats_window(spark):
    df = spark.sql("""SELECT * FROM VALUES ('a', 0.5, 0.5, TIMESTAMP_NTZ '2024-01-24 00:00:00'),
        ('a', 0.7, 0.5, TIMESTAMP_NTZ '2024-01-30 00:00:00'), ('b', 0.1, 0.5, TIMESTAMP_NTZ '2024-01-23 23:59:59')
        AS t(predicted_treatment, response_probability, confidence, created_at)""")
    rows = A.prediction_stats(df, F.lit("2024-01-31"), 7).collect()
    assert [(r["predicted_treatment"], r["total_predictions"]) for r in rows] == [("a", 2)]


def test_fan_out_join_equals_left_join(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(1, 10)] * 5 + [(3, 1)], "k int, y int")
    got = sorted(map(str, fan_out_left_join(left, right, ["k"]).collect()))
    assert got == sorted(map(str, left.join(right, ["k"], "left").collect()))


def test_hot_keys_take_their_own_way(spark, monkeypatch):
    from cohortry.plans import skew as K

    monkeypatch.setattr(K, "HOT_ROWS", 4)
    left = spark.createDataFrame([(1, "a"), (2, "b"), (5, "x"), (5, "y"), (None, "c")], "k int, x string")
    right = spark.createDataFrame([(1, i) for i in range(9)] + [(5, i) for i in range(6)] + [(2, 1), (3, 1), (None, 1)], "k int, y int")
    assert split_hot(right, ["k"])[0].count() == 15 and split_hot(right, ["k"])[1].count() == 3
    got = sorted(map(str, fan_out_left_join(left, right, ["k"]).collect()))
    assert got == sorted(map(str, left.join(right, ["k"], "left").collect()))
    flags = flag_repeated(right, ["k"], "f").collect()
    assert len(flags) == 18 and all(r["f"] == (r["k"] in (1, 5)) for r in flags)


def test_repeated_keys_and_small_side(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert sorted(r["f"] for r in flag_repeated(df, ["k"], "f").collect()) == [False, False, False, True, True]
    assert small_side(df, 3).count() == 5 and small_side(df, 10).count() == 5


def test_shared_folder(spark, monkeypatch):
    from cohortry.plans import session as P

    assert P.shared_dir(spark) == spark.conf.get(P.CHECKPOINT_KEY)
    monkeypatch.setattr(P, "CHECKPOINT_KEY", "spark.not.set")
    own = P.shared_dir(spark)
    assert own and own == P.shared_dir(spark)

    class Cluster:
        conf = spark.conf

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        P.shared_dir(Cluster())
