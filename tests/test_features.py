import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions import scalar as S
from cohortry.functions import text as X
from cohortry.operators import aggregate as A
from cohortry.operators import encode as E
from cohortry.operators import features as FE
from cohortry.operators.validate import CLINICAL_RULES, split_valid
from cohortry.schemas import AGE_EDGES, AGE_LABELS


def values(df, column):
    return [r[column] for r in df.collect()]


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 12, 13, 18, 120, 121, None)], "v int")
    assert values(df.select(S.cut("v", AGE_EDGES, AGE_LABELS).alias("b")), "b") == [
        None, "child", "child", "adolescent", "adolescent", "senior", None, None]
    assert values(df.select(S.cut("v", AGE_EDGES, AGE_LABELS, True).alias("b")), "b")[0] == "child"


def test_item_counts_of_both_kinds(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("a;;b",)], "previous_treatments string")
    etl = FE.treatment_counts(df, empty_as_one=True)
    assert values(etl, "n_previous_treatments") == [None, 1, 1, 3]
    assert values(etl, "has_previous_treatment") == [False, True, True, True]
    plain = FE.treatment_counts(df)
    assert values(plain, "n_previous_treatments") == [0, 0, 1, 3]
    assert values(plain, "has_previous_treatment") == [0, 0, 1, 1]


def test_keyword_flags_ignore_case_and_match_inside_words(spark):
    df = spark.createDataFrame([("LEVETIRACETAM",), ("xlevetiracetamx",), (None,)], "t string")
    flags = df.select(*[c.alias(n) for n, c in S.keyword_flags("t", ["levetiracetam"]).items()])
    assert values(flags, "prev_levetiracetam") == [1, 1, 0]


def test_ratio_with_zero_denominators(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, -1e-6)], "a double, b double")
    first, second = values(df.select(S.safe_ratio("a", "b").alias("r")), "r")
    assert first == pytest.approx(1e6) and second is None


def test_atrophy(spark):
    df = spark.createDataFrame([(3500.0,), (4000.0,), (None,), (1750.0,)], "v double")
    assert values(df.select(S.atrophy("v").alias("a")), "a") == [0.0, 0.0, None, 0.5]


@pytest.mark.parametrize("value", [0.0, 0.005, 0.125, 1.005, 2.675, 59.995, 59.999, 60.0, 67.5, 123.456, 3599.99, 3600.0,
                                   5e6, 1e12, 0.1 + 0.2, 1e-9, 333.325])
def test_duration_rounds_like_printf(spark, value):
    got = spark.range(1).select(S.duration_text(F.lit(value)).alias("t")).first()["t"]
    if value < 60:
        want = f"{value:.2f}s"
    elif value < 3600:
        want = f"{value / 60:.2f}m"
    else:
        want = f"{value / 3600:.2f}h"
    assert got == want


def test_duration_of_null(spark):
    assert spark.range(1).select(S.duration_text(F.lit(None).cast("double")).alias("t")).first()["t"] is None


def test_hash_of_map_ignores_order(spark):
    a = F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2"))
    b = F.create_map(F.lit("y"), F.lit("2"), F.lit("x"), F.lit("1"))
    row = spark.range(1).select(S.map_hash(a).alias("a"), S.map_hash(b).alias("b"), S.content_hash(F.lit("abc")).alias("c")).first()
    assert row["a"] == row["b"] and row["c"] == "900150983cd24fb0d6963f7d28e17f72"


def test_confidence_and_ranking(spark):
    df = spark.createDataFrame([([1 / 3] * 3,), ([1.0, 0.0, 0.0],), ([0.4, 0.4, 0.2],)], "p array<double>")
    conf = values(df.select(S.entropy_confidence("p").alias("c")), "c")
    assert conf[0] == pytest.approx(0, abs=1e-6) and conf[1] == pytest.approx(1, abs=1e-6)
    ranked = df.select(*[c.alias(n) for n, c in S.rank_alternatives("p", {0: "a", 1: "b", 2: "c"}).items()]).collect()
    assert ranked[2]["predicted_treatment"] == "a"
    assert [a["treatment"] for a in ranked[2]["alternative_treatments"]] == ["b", "c"]


def test_polynomial_order_and_names(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    out = FE.polynomial(df, ["a", "b", "absent"], 3)
    assert out.columns == ["a", "b", "a^2", "a b", "b^2", "a^3", "a^2 b", "a b^2", "b^3"]
    assert list(out.first()) == [2, 3, 4, 6, 9, 8, 12, 18, 27]


def test_one_hot_keeps_unseen_labels(spark):
    df = spark.createDataFrame([("x",), (None,)], "c string")
    out = FE.one_hot(df, "c", ["x", "y"], "p")
    assert out.columns == ["p_x", "p_y"] and [tuple(r) for r in out.collect()] == [(True, False), (False, False)]


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 126, 127, 40000, 1.5, 70000.0, "x")],
                               "a bigint, b bigint, c bigint, d bigint, e double, f double, g string")
    kinds = {f.name: f.dataType.simpleString() for f in FE.narrow_types(df).schema.fields}
    assert kinds == {"a": "tinyint", "b": "tinyint", "c": "smallint", "d": "int", "e": "float", "f": "double", "g": "string"}


def test_numeric_columns_leave_booleans_out(spark):
    df = spark.createDataFrame([(1, True, "x", 2.0)], "a int, b boolean, c string, d double")
    assert FE.numeric_columns(df) == ["a", "d"]
    frame, names = FE.feature_target(df, "a")
    assert names == ["b", "d"] and frame.columns == ["b", "d", "a"]
    with pytest.raises(ValueError):
        FE.feature_target(df, "zzz")


def test_label_codes(spark):
    df = spark.createDataFrame([("b",), ("b",), ("a",), (None,)], "c string")
    fitted = E.LabelEncoder.fit(df, "c")
    assert values(fitted.transform(df).orderBy("c"), "c_encoded") == [2, 0, 1, 1]  # null is the text 'nan'
    new = spark.createDataFrame([("z",)], "c string")
    assert values(fitted.transform(new, "keep"), "c_encoded") == [None]
    with pytest.raises(Exception, match="unseen value z"):
        fitted.transform(new).collect()


def test_label_codes_of_a_large_domain(spark, monkeypatch):
    monkeypatch.setattr(E, "SMALL_DOMAIN", 10)
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"))
    fitted = E.LabelEncoder.fit(df, "c")
    assert not fitted.small
    want = {v: i for i, v in enumerate(sorted(f"v{i}" for i in range(5000)))}
    assert {r["c"]: r["c_encoded"] for r in fitted.transform(df).collect()} == want


def test_scalers_against_numpy(spark):
    x = np.array([1.0, 2.0, 4.0, 9.0])
    df = spark.createDataFrame([(float(v), 5.0, None if v == 1 else float(v)) for v in x], "a double, k double, n double")
    std = E.standard_scale(df, ["a", "k"])
    assert np.allclose(values(std, "a_scaled"), (x - x.mean()) / x.std())
    assert values(std, "k_scaled") == [0.0] * 4
    assert np.allclose(values(E.zscore(df, ["a"]), "a_norm"), (x - x.mean()) / x.std(ddof=1))
    assert values(E.zscore(df, ["k"]), "k_norm") == [None] * 4
    assert values(E.standard_scale(df.limit(1), ["a"]), "a_scaled") == [0.0]
    low = E.normalize(df, ["a", "k", "absent"], "minmax")
    assert np.allclose(values(low, "a_norm"), (x - 1) / 8) and values(low, "k_norm") == [0.0] * 4
    with pytest.raises(ValueError):
        E.normalize(df, ["a"], "robust")


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) @ np.array([[2, 0.3, 0], [0, 1, 0.2], [0, 0, 0.4]]) + 5
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    fitted = E.fit_pca(df, ["a", "b", "c"], 2)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    want = np.stack([centred @ (v if v[np.argmax(abs(v))] > 0 else -v) for v in vt[:2]], axis=1)
    got = np.array([[r["pca_0"], r["pca_1"]] for r in fitted.transform(df).collect()])
    assert np.allclose(got, want, atol=1e-8)
    assert np.allclose(fitted.explained, (s**2 / (s**2).sum())[:2])


def test_feature_pipeline_state_comes_from_the_rows_given(raw_clinical, genetic_rows):
    clinical = split_valid(raw_clinical, CLINICAL_RULES)[0]
    pipe = FE.FeaturePipeline().fit(clinical, genetic_rows)
    out = {r["patient_id"]: r for r in pipe.transform(clinical, genetic_rows).collect()}
    assert out["P1"]["n_variants"] == 3 and out["P1"]["n_unique_genes"] == 2 and out["P1"]["has_pathogenic_variant"] == 1
    assert out["P3"]["n_variants"] == 0 and out["P3"]["has_epilepsy_gene"] == 0
    assert out["P1"]["age_young_adult"] and out["P2"]["age_child"] and not out["P3"]["age_child"]
    ages = np.array([30.0, 12.0, 0.0])
    assert out["P1"]["age_norm"] == pytest.approx((30 - ages.mean()) / ages.std())
    part = pipe.transform(clinical.filter("patient_id = 'P1'"), genetic_rows).first()
    assert part["age_norm"] == out["P1"]["age_norm"]


def test_variants_per_subject(spark, genetic_rows):
    empty = spark.createDataFrame([("P9", None, None, None, None, None)], genetic_rows.schema)
    rows = {r["patient_id"]: r for r in A.aggregate_variants(genetic_rows.unionByName(empty)).collect()}
    assert rows["P1"]["n_variants"] == 2 and rows["P1"]["n_genes_affected"] == 2
    assert rows["P1"]["epilepsy_genes"] == ["SCN1A"] and rows["P1"]["has_epilepsy_gene"]
    assert rows["P2"]["epilepsy_genes"] == [] and not rows["P2"]["has_epilepsy_gene"]
    assert rows["P9"]["n_variants"] == 0 and rows["P9"]["epilepsy_genes"] == []


def test_variant_members_and_lists(genetic_rows):
    members = {(r["attribute"], r["value"]): r["n"] for r in A.variant_members(genetic_rows).filter("patient_id = 'P1'").collect()}
    assert members[("gene", "SCN1A")] == 2 and members[("variant_type", "missense")] == 2
    lists = {r["patient_id"]: r for r in A.member_lists(genetic_rows).collect()}
    assert lists["P1"]["gene"] == ["BRCA1", "SCN1A"] and lists["P2"]["gene"] == ["TP53"]


def test_search_text(spark):
    df = spark.createDataFrame([("a", ["G1", "G2", "G3", "G4"], []), ("b", None, None)],
                               "t string, g array<string>, p array<string>")
    got = values(df.select(X.search_text("t", "g", "p").alias("s")), "s")
    assert got == ["epilepsy a G1 G2 G3 treatment resistance treatment guidelines recommendations",
                   "epilepsy b treatment guidelines recommendations"]


def test_trimmed_sources(spark):
    df = spark.createDataFrame([([("a", "x" * 700, {"source": "s"})],)],
                               "s array<struct<id:string,content:string,metadata:map<string,string>>>")
    got = df.select(X.trimmed_sources("s").alias("t")).first()["t"][0]
    assert got["id"] == "a" and len(got["content"]) == 500 and got["metadata"] == {"source": "s"}


def test_padded_vector(spark):
    df = spark.createDataFrame([(1, 2.5)], "a int, b double")
    assert df.select(S.padded_features(["a", "b"], 3).alias("v")).first()["v"] == [1.0, 2.5, 0.0, 0.0, 0.0]


def test_iso_text(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-02 03:04:05' AS a, TIMESTAMP_NTZ '2024-01-02 03:04:05.12' AS b")
    row = df.select(S.iso_text("a").alias("a"), S.iso_text("b").alias("b"), S.stamp_text("a").alias("s")).first()
    assert tuple(row) == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.120000", "20240102_030405")
