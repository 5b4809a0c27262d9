import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import join as J
from cohortry.operators import maintain as U
from cohortry.operators import split as W


def test_merge_renames_collisions_on_the_right(spark):
    base = spark.createDataFrame([("1", 5), ("2", 6)], "patient_id string, n int")
    other = spark.createDataFrame([("1", 7)], "patient_id string, n int")
    many = spark.createDataFrame([("1", 1), ("1", 2)], "patient_id string, z int")
    out = J.merge_modalities(base, {"genetic": other, "neuro": many}, repeated=["neuro"])
    assert out.columns == ["patient_id", "n", "n_genetic", "z"]
    assert sorted(map(tuple, out.collect()), key=str) == [("1", 5, 7, 1), ("1", 5, 7, 2), ("2", 6, None, None)]


def test_null_keys(spark):
    base = spark.createDataFrame([(None, 1), ("a", 2)], "patient_id string, n int")
    other = spark.createDataFrame([(None, 9)], "patient_id string, m int")
    assert J.merge_modalities(base, {"o": other}).filter("m is not null").isEmpty()
    assert J.merge_modalities(base, {"o": other}, null_safe=True).filter("m = 9").count() == 1


def test_resolve_keys_leaves_unknown_out(spark):
    parent = spark.createDataFrame([("a",)], "patient_id string").withColumn("id", J.surrogate("patient_id"))
    child = spark.createDataFrame([("a", 1), ("zz", 2)], "patient_id string, n int")
    row = J.resolve_keys(child, parent, "patient_id", "id").collect()
    assert [tuple(r) for r in row] == [(hashlib.sha256(b"a").hexdigest(), 1)]


def _similar(rows, probe, k):
    mine = [r for r in rows if r[0] == probe]
    scored = {}
    for r in rows:
        if r[0] != probe:
            s = max((p[1] == r[1]) * 1.0 + (abs(p[2] - r[2]) <= 5) * 0.5 + (abs(p[3] - r[3]) <= 2) * 0.5 for p in mine)
            scored[r[0]] = max(s, scored.get(r[0], 0.0))
    return sorted(scored.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_similar_by_profile_thresholds_and_ties(spark):
    rows = [("p", "x", 10, 3.0), ("a", "x", 15, 5.0), ("b", "x", 16, 3.0), ("c", "y", 10, 5.1), ("d", "y", 5, 1.0), ("e", "x", 10, 3.0)]
    df = spark.createDataFrame(rows, "patient_id string, seizure_type string, age_at_onset int, seizure_frequency_per_month double")
    got = [tuple(r) for r in J.similar_by_profile(df, "p", 4).collect()]
    assert got == _similar(rows, "p", 4) == [("a", 2.0), ("e", 2.0), ("b", 1.5), ("d", 1.0)]
    assert J.similar_by_profile(df, "nobody").isEmpty()


@pytest.mark.parametrize("page", [2, 4, 1000])
def test_similar_with_any_page_size(spark, monkeypatch, page):
    monkeypatch.setattr(J, "PROBE_PAGE", page)
    rng = np.random.default_rng(0)
    rows = [(f"s{i % 9}", str(rng.integers(3)), int(rng.integers(60)), float(rng.integers(30))) for i in range(90)]
    df = spark.createDataFrame(rows, "patient_id string, seizure_type string, age_at_onset int, seizure_frequency_per_month double")
    got = [tuple(r) for r in J.similar_by_profile(df, "s0", 5).collect()]
    assert got == _similar(rows, "s0", 5)


def test_a_probe_of_many_profiles_is_not_written_into_the_plan(spark, monkeypatch):
    monkeypatch.setattr(J, "PROBE_PAGE", 2)
    monkeypatch.setattr(J, "profile_score", lambda *a, **k: pytest.fail("profiles as values of the plan"))
    rows = [("p", "x", 10, 3.0), ("p", None, 40, 9.0), ("p", "z", None, 20.0), ("p", "x", 11, float("nan")),
            ("a", "x", 15, 5.0), ("b", None, None, None), ("c", "y", 45, 7.0), ("c", "y", 90, 20.0), ("d", "q", None, float("nan")),
            (None, "x", 10, 3.0)]
    df = spark.createDataFrame(rows, "patient_id string, seizure_type string, age_at_onset int, seizure_frequency_per_month double")
    got = [tuple(r) for r in J.similar_by_profile(df, "p", 9).collect()]
    assert got == [("a", 2.0), ("c", 1.0), ("b", 0.0), ("d", 0.0)]


def test_split_is_disjoint_complete_and_stratified(spark):
    df = spark.range(3000).withColumn("y", F.when(F.col("id") % 10 == 0, "rare").otherwise("common"))
    out = W.stratified_split(df, "id", "y")
    counts = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert counts == {("rare", "train"): 210, ("rare", "val"): 45, ("rare", "test"): 45,
                      ("common", "train"): 1890, ("common", "val"): 405, ("common", "test"): 405}
    assert out.select("id").distinct().count() == 3000
    order = sorted(range(0, 3000, 10), key=lambda k: hashlib.md5(f"{k}|42".encode()).hexdigest())
    train = {r["id"] for r in out.filter("split = 'train' and y = 'rare'").collect()}
    assert train == set(order[:210])
    again = W.stratified_split(df.repartition(7), "id", "y")
    assert out.join(again, ["id", "y", "split"]).count() == 3000


def test_split_of_a_single_member_and_bad_shares(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, y string")
    assert W.stratified_split(df, "id", "y").count() == 3
    assert W.stratified_split(df, "id", "y", (0.1, 0.1, 0.8)).filter("split = 'test'").count() == 3
    with pytest.raises(ValueError):
        W.stratified_split(df, "id", "y", (0.5, 0.1, 0.1))
    with pytest.raises(ValueError):
        W.hash_split(df, "id", (0.5, 0.1, 0.1))


def test_copies_of_a_key_stay_together(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    out = W.stratified_split(df, "k", None, (0.5, 0.25, 0.25))
    assert out.count() == 3000
    assert out.groupBy("k").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()


def test_folds_are_even(spark):
    df = spark.range(503).withColumn("y", F.col("id") % 3)
    folds = W.assign_folds(df, "id", "y", 5)
    counts = [r["count"] for r in folds.groupBy("y", "fold").count().collect()]
    assert len(counts) == 15 and max(counts) - min(counts) <= 1 and sum(counts) == 503


def test_hash_split_keeps_copies_together(spark):
    df = spark.range(4000).withColumn("k", F.col("id") % 500)
    out = W.hash_split(df, "k", (0.5, 0.25, 0.25))
    assert out.groupBy("k").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    shares = {r["split"]: r["count"] / 4000 for r in out.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.5) < 0.1


def test_confidence_of_hits(spark):
    hits = spark.createDataFrame([("q", 1, 0.2), ("q", 2, 0.4), ("one", 1, 0.3)], "query_id string, rank int, distance double")
    queries = spark.createDataFrame([("q",), ("one",), ("none",)], "query_id string")
    got = {r["query_id"]: r["confidence"] for r in W.retrieval_confidence(hits, queries).collect()}
    assert got == {"q": pytest.approx((0.8 + 0.6 / 2) / 1.5), "one": pytest.approx(0.7), "none": 0.0}


def _ks(a, b):
    grid = np.unique(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), grid, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), grid, side="right") / len(b)
    return np.abs(fa - fb).max()


def test_distribution_comparison(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=400), rng.normal(0.3, 1, size=300)
    da = spark.createDataFrame([(float(v), 1.0, float(v)) for v in a] + [(None, 1.0, 0.0)], "x double, same double, only_a double")
    db = spark.createDataFrame([(float(v), 1.0) for v in b], "x double, same double")
    rows = {r["column"]: r for r in W.compare_distributions(da, db, ["x", "same", "only_a", "zzz"]).collect()}
    assert set(rows) == {"x", "same"}
    d = _ks(a, b)
    assert rows["x"]["ks_statistic"] == pytest.approx(d)
    z = np.sqrt(400 * 300 / 700) * d
    j = np.arange(1, 2000)
    assert rows["x"]["p_value"] == pytest.approx(2 * np.sum((-1.0) ** (j - 1) * np.exp(-2 * j**2 * z**2)), abs=1e-9)
    assert rows["x"]["df1_std"] == pytest.approx(a.std(ddof=1)) and rows["x"]["distributions_differ"]
    assert rows["same"]["ks_statistic"] == 0.0 and rows["same"]["p_value"] == 1.0
    far = W.compare_distributions(da, db.withColumn("x", F.col("x") + 100), ["x"]).first()
    assert far["ks_statistic"] == 1.0 and far["p_value"] < 1e-12
    assert W.compare_distributions(da, db, ["zzz"]).isEmpty()


def test_upsert_stamps_touched_rows_only(spark):
    target = spark.createDataFrame([(1, "a", "t0", "t0"), (2, "b", "t0", "t0")], "k int, v string, created_at string, updated_at string")
    updates = spark.createDataFrame([(2, "x", 1), (2, "c", 2), (3, "d", 1)], "k int, v string, seq int")
    got = {r["k"]: tuple(r)[1:] for r in U.upsert(target, updates, "k", F.lit("t1"), order=[F.desc("seq")]).collect()}
    assert got == {1: ("a", "t0", "t0"), 2: ("c", "t0", "t1"), 3: ("d", "t1", "t1")}


def test_cascade_delete_follows_links(spark):
    tables = {
        "a": spark.createDataFrame([(1,), (2,)], "id int"),
        "b": spark.createDataFrame([(10, 1), (20, 2)], "bid int, aid int"),
        "c": spark.createDataFrame([(100, 10), (200, 20), (300, None)], "cid int, bid int"),
    }
    left = U.cascade_delete(tables, "a", spark.createDataFrame([(1,)], "id int"),
                            [("b", "aid", "a", "id"), ("c", "bid", "b", "bid")], "id")
    assert [r["id"] for r in left["a"].collect()] == [2]
    assert [r["bid"] for r in left["b"].collect()] == [20]
    assert sorted(r["cid"] for r in left["c"].collect()) == [200, 300]


def test_union_of_sources_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, "x")], "id int, p string")
    b = spark.createDataFrame([(2, 0.5)], "id int, q double")
    assert sorted(map(tuple, U.union_sources([a, b]).collect())) == [(1, "x", None), (2, None, 0.5)]


def test_drop_collection(spark, tmp_path):
    spark.range(3).write.option("path", str(tmp_path / "t")).saveAsTable("drop_me")
    U.drop_collection(spark, "drop_me")
    assert not spark.catalog.tableExists("drop_me")


def test_many_probes_are_not_broadcast(spark):
    # 12,000 of them are few bytes, but more rows than a broadcast may have
    values = spark.range(20_000).select((F.col("id") % 7).cast("string").alias("kind"), F.col("id").cast("double").alias("onset"))
    asked = values.where("onset < 12000 AND onset % 2 = 0").unionByName(values.where("onset >= 14000"))
    met = J._meeting(values, asked, ["kind", "onset"], {"onset": 0.5})
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and met.count() == 12_000
    few = J._meeting(values, asked.where("onset < 100"), ["kind", "onset"], {"onset": 0.5})
    assert "Broadcast" in few._jdf.queryExecution().executedPlan().toString() and few.count() == 50
