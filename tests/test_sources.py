import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cohortry import pipeline as P
from cohortry import schemas
from cohortry.operators.validate import CLINICAL_RULES, RuleSet, split_valid
from cohortry.sources import files, warehouse

VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL
1\t100\trs1\tA\tG\t50.5
X\t200\t.\tC\tT\t.

2\tbad\t.\tC\tT\t1
"""


def test_vcf_file(spark, tmp_path):
    (tmp_path / "s1.vcf").write_text(VCF)
    (tmp_path / "s2.vcf").write_text(VCF.splitlines()[0] + "\n")
    got = files.read_genetic(spark, str(tmp_path / "*.vcf"))
    assert sorted(map(tuple, got.collect())) == [
        ("1", 100, "A", "G", 50.5, "s1"), ("2", None, "C", "T", 1.0, "s1"), ("X", 200, "C", "T", None, "s1")]
    assert [f.dataType for f in got.schema.fields] == [f.dataType for f in schemas.VCF.fields]


def test_genetic_by_suffix(spark, tmp_path):
    (tmp_path / "g.csv").write_text("patient_id,gene\nP1,SCN1A\n")
    assert files.read_genetic(spark, str(tmp_path / "g.csv")).first()["gene"] == "SCN1A"
    with pytest.raises(ValueError):
        files.read_genetic(spark, "x.parquet")


def test_clinical_csv_reports_text_that_does_not_parse(spark, tmp_path):
    head = ",".join(schemas.CLINICAL.fieldNames())
    (tmp_path / "c.csv").write_text(
        f"{head}\nP1,30,M,absence,1.5,3,4.0,a;b,responder\nP2,old,M,absence,1.5,3,4.0,a;b,responder\n")
    raw = files.read_clinical(spark, str(tmp_path / "c.csv"))
    valid, invalid = split_valid(raw, CLINICAL_RULES)
    assert valid.first()["age"] == 30 and invalid.first()["failures"][0]["value"] == "old"
    with pytest.raises(ValueError):
        files.read_clinical(spark, "ftp://x/y.csv")


def test_jdbc_options():
    plain = files.jdbc_options("postgresql://h/db", "clinical_data")
    assert plain["url"] == "jdbc:postgresql://h/db" and "numPartitions" not in plain
    ranged = files.jdbc_options("jdbc:postgresql://h/db", "t", "id", (0, 100), 4)
    assert (ranged["lowerBound"], ranged["upperBound"], ranged["numPartitions"]) == ("0", "100", "4")
    with pytest.raises(ValueError):
        files.jdbc_options("x", "t", "id")


def test_image_statistics(spark):
    voxels = spark.createDataFrame([("a", i, 0, 0, float(v)) for i, v in enumerate((1, 3))], "image string, i int, j int, k int, v double")
    headers = spark.createDataFrame([("a", 0.5, 2.0, 3.0)], "image string, dx double, dy double, dz double")
    row = files.image_stats(voxels, "image", "v", headers).first()
    assert (row["mean_intensity"], row["std_intensity"], row["n_voxels"], row["volume_cm3"]) == (2.0, 1.0, 2, 6.0)
    assert files.image_shape(voxels, "image").first()["shape"] == [2, 1, 1]


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None, {"a": 1.5})], "id int, t string, m map<string,double>")
    files.write_json(df, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), df.schema).collect() == df.collect()
    (tmp_path / "pretty.json").write_text(json.dumps({"a": 1, "b": [1, 2]}, indent=2))
    assert files.read_json(spark, str(tmp_path / "pretty.json"), multi_line=True).first()["b"] == [1, 2]


def test_guidelines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    (tmp_path / "b.md").write_text("z")
    got = files.read_guidelines(spark, str(tmp_path)).collect()
    assert [r["text"] for r in got] == ["x\ny"] and got[0]["source"].endswith("a.txt")


def test_explode_treatments(spark):
    df = spark.createDataFrame([("a; b;;c",), (None,), ("",)], "previous_treatments string")
    assert [r["treatment_name"] for r in warehouse.explode_treatments(df).collect()] == ["a", "b", "", "c"]


def test_number_copies(spark, monkeypatch):
    monkeypatch.setattr(warehouse, "COPY_BLOCK", 3)
    df = spark.createDataFrame([("a",)] * 8 + [("b",), (None,), (None,)], "x string")
    got = sorted(map(tuple, warehouse.number_copies(df).collect()), key=str)
    assert got == sorted([("a", i) for i in range(1, 9)] + [("b", 1), (None, 1), (None, 2)], key=str)


def test_copies_are_numbered_where_they_are_counted(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "x string")
    plan = warehouse.number_copies(df)._jdf.queryExecution().optimizedPlan().toString()
    kept = [line for line in plan.splitlines() if "Filter" in line and "<=" in line]
    assert plan.count("RepartitionByExpression") == 1 and kept  # blocks of hot rows only
    assert sorted(map(tuple, warehouse.number_copies(df).collect())) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_variants_are_counted_under_the_natural_key(spark):
    clinical = spark.createDataFrame([("P1",), ("P1",), ("P2",), (None,)], "patient_id string").select(
        "patient_id", F.lit(1).alias("age"), F.lit("M").alias("sex"), F.lit("a").alias("previous_treatments"),
        F.lit("r").alias("treatment_response"))
    genetic = spark.createDataFrame([("P1", "G")] * 2 + [("P2", "G"), (None, "G"), ("P9", "G")], "patient_id string, gene string")
    variants = warehouse.warehouse_tables(clinical, genetic, F.lit("2024-01-01").cast("timestamp"))["genetic_variants"]
    rows = variants.select("id", "patient_id").collect()
    key = lambda p: hashlib.sha256(p.encode()).hexdigest()
    row_id = lambda p, n: key(json.dumps({"patient_id": key(p), "gene": "G", "copy": n}, separators=(",", ":")))
    assert sorted(map(tuple, rows)) == sorted([(row_id("P1", n), key("P1")) for n in (1, 2, 3, 4)] + [(row_id("P2", 1), key("P2"))])
    plan = variants._jdf.queryExecution().optimizedPlan().toString()
    assert all("sha2" not in line for line in plan.splitlines() if "Aggregate" in line)


def test_warehouse_load(spark, tmp_path, raw_clinical, genetic_rows):
    clinical = split_valid(raw_clinical, CLINICAL_RULES)[0]
    genetic = genetic_rows.unionByName(genetic_rows.limit(1)).unionByName(
        genetic_rows.limit(1).withColumn("patient_id", F.lit("unknown")))
    base = str(tmp_path / "wh")
    names = warehouse.load_warehouse(base, clinical, genetic, F.lit("2024-01-01").cast("timestamp"))
    t = warehouse.read_warehouse(spark, base, *names)
    assert {n: t[n].count() for n in names} == {"patients": 3, "clinical_data": 3, "treatments": 3, "genetic_variants": 5}
    assert t["genetic_variants"].select("id").distinct().count() == 5
    assert t["treatments"].join(t["patients"].withColumnRenamed("id", "pid"), F.col("pid") == t["treatments"].patient_id).count() == 3
    other = str(tmp_path / "wh2")
    warehouse.load_warehouse(other, clinical, genetic, F.lit("2024-01-01").cast("timestamp"))
    again = warehouse.read_warehouse(spark, other, "genetic_variants")["genetic_variants"]
    assert again.join(t["genetic_variants"], "id", "left_semi").count() == 5


def test_prediction_sink_reads_one_day(spark, tmp_path):
    scored = spark.createDataFrame([("P1", "a", 0.5, 0.25), ("P2", "b", 0.6, 0.5)],
                                   "patient_id string, predicted_treatment string, response_probability double, confidence double")
    path = str(tmp_path / "pred")
    for day in ("2024-01-01", "2024-01-02"):
        warehouse.write_predictions(warehouse.prediction_rows(scored, "v1", F.lit(day).cast("timestamp")), path)
    back = spark.read.parquet(path)
    assert back.count() == 4 and back.select("id").distinct().count() == 4
    one = back.filter("created_date = '2024-01-02'")
    assert one.count() == 2 and "PartitionFilters: [isnotnull" in one._jdf.queryExecution().executedPlan().toString()


def test_prediction_sink_takes_numbers_above_ten(spark, tmp_path):
    scored = spark.createDataFrame([("P1", "a", 22.758, 1234567.8901)],
                                   "patient_id string, predicted_treatment string, response_probability double, confidence double")
    path = str(tmp_path / "pred")
    warehouse.write_predictions(warehouse.prediction_rows(scored, "v1", F.lit("2024-01-01").cast("timestamp")), path)
    row = spark.read.parquet(path).first()
    assert (str(row["response_probability"]), str(row["confidence"])) == ("22.7580", "1234567.8901")


def test_registry_returns_the_newest_active_model(spark, tmp_path):
    path = str(tmp_path / "models")
    for version, active in (("v1", True), ("v2", True), ("v3", False)):
        warehouse.append_model_metadata(
            warehouse.model_metadata(spark, version, "ensemble", {"f1_score": 0.5}, {"k": 1}, 10, ["a"], active), path)
    row = warehouse.model_info(spark, path).first()
    assert row["version"] == "v2" and json.loads(row["metrics"]) == {"f1_score": 0.5}


def test_create_table(spark, tmp_path):
    warehouse.create_table(spark, "api_logs", str(tmp_path))
    assert spark.table("api_logs").columns == schemas.WAREHOUSE["api_logs"].fieldNames()
    spark.sql("DROP TABLE api_logs")


@pytest.mark.integration
def test_modalities_from_files_to_one_table(spark, tmp_path, raw_clinical, genetic_rows):
    raw_clinical.toPandas().to_csv(tmp_path / "clinical.csv", index=False)
    genetic_rows.toPandas().to_csv(tmp_path / "genetic.csv", index=False)
    (tmp_path / "neuro.csv").write_text("patient_id,mean_intensity,note\nP1,1.0,a\nP1,1.0,a\nP3,3.0,b\n")
    sources = {n: str(tmp_path / f) for n, f in
               {"clinical": "clinical.csv", "genetic": "genetic.csv", "neuroimaging": "neuro.csv", "eeg": "x.csv"}.items()}
    with pytest.warns(UserWarning, match="eeg"):
        done = P.process_all(spark, sources)
    assert set(done) == {"clinical", "genetic", "neuroimaging"}
    merged = {r["patient_id"]: r for r in P.merge_processed(done).collect()}
    # P2 has an empty treatment list, which a CSV cannot tell from a missing one
    assert set(merged) == {"P1", "P3"}
    assert merged["P1"]["n_variants"] == 2 and merged["P1"]["mean_intensity_scaled"] == -1.0
    assert merged["P3"]["n_variants"] is None and merged["P1"]["sex_encoded"] == 0
    assert done["clinical"].errors.count() > 0

    P.register_modality("eeg", P.Modality(files.read_csv, RuleSet(schemas.GENETIC), lambda df: df))
    (tmp_path / "x.csv").write_text("patient_id,power\nP1,2\n")
    assert P.process_all(spark, {"eeg": sources["eeg"]})["eeg"].data.count() == 1
    P._REGISTRY.pop("eeg")


def test_vcf_rows_get_patient_and_gene(spark, tmp_path):
    (tmp_path / "s1.vcf").write_text("##x\n#CHROM\nchr1\t5\t.\tA\tG\t30\tPASS\nchr2\t9\t.\tC\tT\t.\tPASS\n")
    source = {"genetic": str(tmp_path / "s1.vcf")}
    samples = spark.createDataFrame([("s1", "P1")], "sample_id string, patient_id string")
    genes = spark.createDataFrame([("chr1", 5, "SCN1A", "missense")], "chrom string, pos int, gene string, variant_type string")
    done = P.process_all(spark, source, samples, genes)["genetic"]
    assert [(r["patient_id"], r["n_variants"], r["epilepsy_genes"]) for r in done.data.collect()] == [("P1", 1, ["SCN1A"])]
    assert {(r["column"], r["check"]) for r in done.errors.collect()} == {("gene", "not_nullable"), ("variant_type", "not_nullable")}
    plain = P.process_all(spark, source)["genetic"]  # without annotation: reported, nothing transformed
    assert ("patient_id", "column_in_dataframe") in {(r["column"], r["check"]) for r in plain.errors.collect()}
    assert plain.data.count() == 2
    with pytest.raises(ValueError, match="patient_id"):
        P.merge_processed({"clinical": plain})


def test_first_image_row_is_the_first_in_the_file(spark, tmp_path):
    (tmp_path / "n.csv").write_text("patient_id,mean_intensity\n" + "".join(f"P1,{float(i)}\n" for i in range(6)) + "P2,9.0\n")
    out = P.process_all(spark, {"neuroimaging": str(tmp_path / "n.csv")})["neuroimaging"].data
    assert {r["patient_id"]: r["mean_intensity"] for r in out.collect()} == {"P1": 0.0, "P2": 9.0}
    assert not any(c.startswith("__") for c in out.columns)


def test_images_without_header_stay(spark):
    voxels = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "image string, v double")
    headers = spark.createDataFrame([("a", 1.0, 1.0, 2.0)], "image string, dx double, dy double, dz double")
    got = {r["image"]: r["volume_cm3"] for r in files.image_stats(voxels, "image", "v", headers).collect()}
    assert got == {"a": 2.0, "b": None}


def test_clinical_table_can_be_read_in_ranges(monkeypatch):
    seen = {}
    monkeypatch.setattr(files, "read_jdbc", lambda *a: seen.setdefault("args", a[1:]))
    files.read_clinical(None, "postgresql://h/db", "id", (1, 100), 4)
    assert seen["args"] == ("postgresql://h/db", "clinical_data", "id", (1, 100), 4)
