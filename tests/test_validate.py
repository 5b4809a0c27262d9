from pyspark.sql import functions as F

from cohortry.operators import validate as V
from cohortry.schemas import CLINICAL


def by_row(report):
    out = {}
    for r in report.collect():
        out.setdefault(r["row_key"], set()).add((r["column"], r["check"].split("(")[0]))
    return out


def test_every_failure_is_reported(raw_clinical):
    found = by_row(V.failure_report(raw_clinical, V.CLINICAL_RULES, "patient_id"))
    assert "P1" not in found and "P2" not in found and "P3" not in found
    assert found["P4"] == {("age", "less_than_or_equal_to")}
    assert found["P5"] == {("sex", "isin"), ("seizure_frequency_per_month", "greater_than_or_equal_to")}
    assert found["P6"] == {("seizure_frequency_per_month", "coerce_dtype")}
    assert found["P7"] == {("patient_id", "field_uniqueness")}
    assert found[None] == {("patient_id", "not_nullable")}
    assert found["P8"] == {("previous_treatments", "not_nullable")}


def test_both_copies_of_a_repeated_id_fail(raw_clinical):
    report = V.failure_report(raw_clinical, V.CLINICAL_RULES, "patient_id")
    assert report.filter("check = 'field_uniqueness'").count() == 2


def test_valid_rows_are_typed_and_complementary(raw_clinical):
    valid, invalid = V.split_valid(raw_clinical, V.CLINICAL_RULES)
    assert {r["patient_id"] for r in valid.collect()} == {"P1", "P2", "P3"}
    assert valid.schema["age"].dataType == CLINICAL["age"].dataType
    assert valid.count() + invalid.count() == raw_clinical.count()


def test_whole_numbers_written_as_decimals(spark):
    df = spark.createDataFrame([("30.0",), ("30.5",), ("30",), ("x",)], "age string")
    assert [r["age"] for r in V.coerce(df, CLINICAL).collect()] == [30, None, 30, None]


def test_column_set(raw_clinical):
    more = raw_clinical.withColumn("extra", F.lit(1)).drop("sex")
    strict = {(r["column"], r["check"]) for r in V.check_columns(more, V.CLINICAL_RULES).collect()}
    assert strict == {("sex", "column_in_dataframe"), ("extra", "column_in_schema")}
    assert V.check_columns(more.withColumn("gene", F.lit("")), V.GENETIC_RULES).filter("column = 'extra'").isEmpty()
    # a missing column never removes rows
    assert V.split_valid(raw_clinical.drop("sex"), V.CLINICAL_RULES)[0].count() == 3


def test_nullable_genetic_columns(genetic_rows):
    assert V.failure_report(genetic_rows, V.GENETIC_RULES, "patient_id").isEmpty()
    bad = genetic_rows.withColumn("variant_type", F.lit("other")).withColumn("allele_frequency", F.lit(1.5))
    checks = {(r["column"], r["check"].split("(")[0]) for r in V.failure_report(bad, V.GENETIC_RULES, "patient_id").collect()}
    assert checks == {("variant_type", "isin"), ("allele_frequency", "less_than_or_equal_to")}


def test_dedup_first_takes_the_first_by_order(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "id string, ts int")
    assert {(r["id"], r["ts"]) for r in V.dedup_first(df, "id", ["ts"]).collect()} == {("a", 1), ("b", 9)}


def test_record_messages(spark):
    df = spark.createDataFrame(
        [("P1", 130, "Q", "absence", -1.0, 140, 1.0), ("P2", 30, "M", "absence", 1.0, 20, 1.0),
         ("P3", None, "M", "absence", 1.0, 20, 1.0)],
        "patient_id string, age int, sex string, seizure_type string, seizure_frequency_per_month double, "
        "age_at_onset int, epilepsy_duration_years double")
    rows = {r["patient_id"]: r for r in V.validate_records(df).collect()}
    assert rows["P1"]["errors"] == [V.BAD_AGE, V.BAD_SEX, V.BAD_FREQUENCY, V.BAD_ONSET]
    assert rows["P2"]["is_valid"] and rows["P2"]["errors"] == []
    assert rows["P3"]["errors"] == [V.MISSING_FIELD + "age"]


def test_nested_members(spark):
    df = spark.createDataFrame([
        (1, "absence", [("missense",), ("nonsense",)]), (2, "absence", [("other",)]), (3, "x", []), (4, "absence", None),
    ], "id int, seizure_type string, genetic_variants array<struct<variant_type:string>>")
    assert {r["id"]: r["is_valid"] for r in V.validate_nested(df).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_process_counts_without_a_scan(raw_clinical):
    done = V.process(raw_clinical, V.CLINICAL_RULES, lambda df: df.filter("age > 0"), "clinical")
    assert done.data.count() == 2
    assert done.summary() == {"n_records_input": 10, "n_records_output": 2, "n_failed": 7}


def test_warehouse_constraints(spark):
    patients = spark.createDataFrame([("1", "a", 200, "M"), ("2", "a", 20, None)], "id string, patient_id string, age int, sex string")
    child = spark.createDataFrame([("1", 1.5, 0.5), ("9", 0.5, 0.5), (None, 0.5, 0.5)],
                                  "patient_id string, response_probability double, confidence double")
    got = {r["constraint"]: r["violations"] for r in V.warehouse_constraints({"patients": patients, "predictions": child}).collect()}
    assert got["patients.age_range"] == 1 and got["patients.sex_not_null"] == 1
    assert got["patients.patient_id_unique"] == 1 and got["predictions.probability_range"] == 1
    assert got["predictions.patient_id_fk"] == 1


def test_column_failures_are_reported_and_drop_no_row(spark):
    df = spark.createDataFrame([("P1", "30", "x")], "patient_id string, age string, extra string")
    done = V.process(df, V.CLINICAL_RULES, lambda d: d.withColumn("y", d["age_at_onset"]), "clinical")
    got = {(r["column"], r["check"]) for r in done.errors.collect()}
    assert ("extra", "column_in_schema") in got and ("sex", "column_in_dataframe") in got and len(got) == 8
    assert done.data.columns == ["patient_id", "age"] and done.data.count() == 1
    assert done.summary()["n_records_output"] == 1
