"""Validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.catalog.registry import Tables, clinical, query
from cohortry.operators.validate import (
    RuleSet, between, check_columns, coerce, dedup_first, failure_report, flag_duplicates, isin, not_null,
    process, split_valid, validate_nested, validate_records, warehouse_constraints,
)
from cohortry.schemas import BIGINT, DOUBLE, INT, STRING


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, d) for n, d in fields.items()])


@query("v1_coerce_types", """
SELECT event_id, TRY_CAST(CASE WHEN event_type = 'error' THEN props ELSE json_extract_string(props, '$.k') END
                          AS INTEGER) AS k
FROM events""")
def v1(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.get_json_object("props", "$.k"))
    return coerce(t("events").select("event_id", raw.alias("k")), _schema(k=INT))


LINES = _schema(l_orderkey=BIGINT, l_quantity=DOUBLE, l_discount=DOUBLE)


@query("v2_range_checks", """
SELECT l_orderkey AS row_key, 'l_quantity' AS "column", 'greater_than_or_equal_to(5)' AS "check",
       CAST(l_quantity AS VARCHAR) AS value FROM lineitem WHERE l_quantity < 5
UNION ALL
SELECT l_orderkey, 'l_quantity', 'less_than_or_equal_to(45)', CAST(l_quantity AS VARCHAR)
FROM lineitem WHERE l_quantity > 45
UNION ALL
SELECT l_orderkey, 'l_discount', 'less_than_or_equal_to(0.08)', CAST(l_discount AS VARCHAR)
FROM lineitem WHERE l_discount > 0.08""")
def v2(t: Tables) -> DataFrame:
    rules = RuleSet(LINES, [*between("l_quantity", 5, 45), *between("l_discount", high=0.08)])
    return failure_report(t("lineitem").select(*LINES.fieldNames()), rules, "l_orderkey")


ORDERS = _schema(o_orderkey=BIGINT, o_custkey=BIGINT, o_orderstatus=STRING, o_totalprice=DOUBLE,
                 o_orderpriority=STRING)
URGENT = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("v3_membership_checks", """
SELECT o_orderkey AS row_key, 'o_orderpriority' AS "column", 'isin' AS "check", o_orderpriority AS value
FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def v3(t: Tables) -> DataFrame:
    rules = RuleSet(ORDERS, isin("o_orderpriority", URGENT))
    return failure_report(t("orders").select(*ORDERS.fieldNames()), rules, "o_orderkey")


@query("v4_not_null_checks", """
SELECT o_orderkey AS row_key, 'o_orderstatus' AS "column", 'not_nullable' AS "check", CAST(NULL AS VARCHAR) AS value
FROM orders WHERE o_orderstatus = 'P'""")
def v4(t: Tables) -> DataFrame:
    df = t("orders").select(*ORDERS.fieldNames()).withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return failure_report(df, RuleSet(ORDERS, not_null("o_orderstatus", "o_orderkey")), "o_orderkey")


@query("v5_unique_all_copies", """
SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS is_duplicate FROM documents""")
def v5(t: Tables) -> DataFrame:
    return flag_duplicates(t("documents").select("doc_id", "text"), "text").select("doc_id", "is_duplicate")


@query("v6_column_set", """
SELECT * FROM (VALUES ('c_age', 'column_in_dataframe'), ('c_name', 'column_in_schema'),
                      ('c_nationkey', 'column_in_schema'), ('c_acctbal', 'column_in_schema')) AS f("column", "check"),
     (SELECT count(*) AS n_rows FROM customer)""")
def v6(t: Tables) -> DataFrame:
    declared = _schema(c_custkey=BIGINT, c_mktsegment=STRING, c_age=INT)
    df = t("customer")
    n_rows = df.agg(F.count(F.lit(1))).scalar()
    return check_columns(df, RuleSet(declared, strict=True)).withColumn("n_rows", n_rows)


ORDER_RULES = RuleSet(
    ORDERS,
    [*not_null("o_orderstatus"), *isin("o_orderpriority", URGENT), *between("o_totalprice", 20000, 400000)],
    unique=["o_totalprice"],
    strict=True,
)


def _orders(t: Tables) -> DataFrame:
    status = F.nullif("o_orderstatus", F.lit("P"))
    return t("orders").select(*ORDERS.fieldNames()).withColumn("o_orderstatus", status)


ORDER_FAILURES_SQL = """
o AS (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_totalprice, o_orderpriority,
             count(*) OVER (PARTITION BY o_totalprice) AS copies FROM orders),
f AS (
  SELECT o_orderkey AS row_key, 'o_orderstatus' AS "column", 'not_nullable' AS "check", CAST(NULL AS VARCHAR) AS value
  FROM o WHERE o_orderstatus IS NULL
  UNION ALL SELECT o_orderkey, 'o_orderpriority', 'isin', o_orderpriority FROM o
  WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')
  UNION ALL SELECT o_orderkey, 'o_totalprice', 'greater_than_or_equal_to(20000)', NULL FROM o WHERE o_totalprice < 20000
  UNION ALL SELECT o_orderkey, 'o_totalprice', 'less_than_or_equal_to(400000)', NULL FROM o WHERE o_totalprice > 400000
  UNION ALL SELECT o_orderkey, 'o_totalprice', 'field_uniqueness', NULL FROM o WHERE copies > 1)"""


@query("v6_process_missing_column", """
SELECT kind, "column", "check", n FROM (
  SELECT 'error' AS kind, "column", "check", CAST(1 AS BIGINT) AS n
  FROM (VALUES ('c_age', 'column_in_dataframe'), ('c_name', 'column_in_schema')) AS f("column", "check")
  UNION ALL SELECT 'rows', '', '', count(*) FROM customer)""")
def v6_process(t: Tables) -> DataFrame:
    # an absent required column and one too many: both are reported, no row is lost, nothing is transformed
    rules = RuleSet(_schema(c_custkey=BIGINT, c_mktsegment=STRING, c_age=INT), [*not_null("c_custkey", "c_age")], strict=True)
    done = process(t("customer").select("c_custkey", "c_mktsegment", "c_name"), rules,
                   lambda df: df.filter("c_age > 0"), "customer")
    errors = done.errors.groupBy("column", "check").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("error").alias("kind"), "column", "check", "n")
    rows = done.data.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("rows").alias("kind"), F.lit("").alias("column"), F.lit("").alias("check"), "n")
    return errors.unionByName(rows)


@query("v7_failure_report", f"WITH {ORDER_FAILURES_SQL} SELECT * FROM f")
def v7(t: Tables) -> DataFrame:
    report = failure_report(_orders(t), ORDER_RULES, "o_orderkey")
    # the text form of a price differs between engines
    return report.withColumn("value", F.when(F.col("column") != "o_totalprice", F.col("value")))


@query("v8_keep_valid_rows", f"""
WITH {ORDER_FAILURES_SQL}
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM o
WHERE o_orderkey NOT IN (SELECT row_key FROM f)""")
def v8(t: Tables) -> DataFrame:
    return split_valid(_orders(t), ORDER_RULES)[0]


@query("v9_first_per_key", """
SELECT user_id, event_id, event_type, value
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def v9(t: Tables) -> DataFrame:
    events = t("events").select("user_id", "event_id", "event_type", "value", "ts")
    return dedup_first(events, "user_id", ["ts", "event_id"]).drop("ts")


@query("v10_record_rules", """
SELECT p_partkey AS patient_id, is_valid, array_to_string(errors, '|') AS messages FROM (
  SELECT p_partkey, len(errors) = 0 AS is_valid, errors FROM (
    SELECT p_partkey, list_filter([
      CASE WHEN p_partkey % 11 = 0 THEN 'Campo obrigatório ausente: seizure_type' END,
      'Campo obrigatório ausente: epilepsy_duration_years',
      CASE WHEN p_size * 3 - 5 < 0 OR p_size * 3 - 5 > 120 THEN 'Idade inválida (deve estar entre 0 e 120)' END,
      CASE WHEN p_type NOT IN ('ECONOMY', 'SMALL') THEN 'Sexo inválido (deve ser M, F ou Other)' END,
      CASE WHEN p_retailprice - 910 < 0 THEN 'Frequência de crises inválida (deve ser >= 0)' END,
      CASE WHEN p_partkey % 60 > p_size * 3 - 5 THEN 'Idade de início não pode ser maior que idade atual' END
    ], lambda x: x IS NOT NULL) AS errors FROM part))""")
def v10(t: Tables) -> DataFrame:
    records = t("part").select(
        F.col("p_partkey").alias("patient_id"),
        (F.col("p_size") * 3 - 5).alias("age"),
        F.col("p_type").alias("sex"),
        F.when(F.col("p_partkey") % 11 != 0, F.col("p_brand")).alias("seizure_type"),
        (F.col("p_retailprice") - 910).alias("seizure_frequency_per_month"),
        (F.col("p_partkey") % 60).alias("age_at_onset"),
    )
    checked = validate_records(records, sexes=["ECONOMY", "SMALL"])
    return checked.select("patient_id", "is_valid", F.array_join("errors", "|").alias("messages"))


@query("v11_nested_members", """
SELECT l_orderkey, l_linenumber,
       l_returnflag IN ('A', 'O') AND l_linestatus IN ('A', 'O') AND l_returnflag IN ('A', 'N') AS is_valid
FROM lineitem""")
def v11(t: Tables) -> DataFrame:
    kinds = F.array(*[F.struct(F.col(c).alias("variant_type")) for c in ("l_returnflag", "l_linestatus")])
    nested = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", kinds.alias("genetic_variants"))
    checked = validate_nested(nested, allowed=["A", "O"], scalar="l_returnflag", scalar_allowed=["A", "N"])
    return checked.select("l_orderkey", "l_linenumber", "is_valid")


@query("v12_processing_summary", f"""
WITH {ORDER_FAILURES_SQL}
SELECT (SELECT count(*) FROM o) AS n_records_input,
       (SELECT count(*) FROM o WHERE o_orderkey NOT IN (SELECT row_key FROM f)) AS n_records_output,
       (SELECT count(DISTINCT row_key) FROM f) AS n_failed""")
def v12(t: Tables) -> DataFrame:
    done = process(_orders(t), ORDER_RULES, name="orders", row_key="o_orderkey")
    done.data.write.format("noop").mode("overwrite").save()
    counts = done.summary()
    schema = ", ".join(f"{name} bigint" for name in counts)
    return t.spark.createDataFrame([tuple(counts.values())], schema)


@query("v13_table_constraints", """
SELECT 'patients.age_range' AS "constraint", count(*) FILTER (c_custkey % 125 NOT BETWEEN 0 AND 120) AS violations
FROM customer
UNION ALL SELECT 'patients.patient_id_not_null', 0 UNION ALL SELECT 'patients.age_not_null', 0
UNION ALL SELECT 'patients.sex_not_null', 0 UNION ALL SELECT 'patients.patient_id_unique', 0
UNION ALL SELECT 'clinical_data.frequency_range', count(*) FILTER (c_acctbal < 0) FROM customer
UNION ALL SELECT 'clinical_data.onset_range', 0 UNION ALL SELECT 'clinical_data.duration_range', 0
UNION ALL SELECT 'clinical_data.seizure_type_not_null', 0 UNION ALL SELECT 'clinical_data.frequency_not_null', 0
UNION ALL SELECT 'clinical_data.onset_not_null', 0 UNION ALL SELECT 'clinical_data.duration_not_null', 0
UNION ALL SELECT 'predictions.probability_range', count(*) FILTER (value / 100 NOT BETWEEN 0 AND 1) FROM events
UNION ALL SELECT 'predictions.confidence_range', count(*) FILTER (value / 200 NOT BETWEEN 0 AND 1) FROM events
UNION ALL SELECT 'clinical_data.patient_id_fk', 0
UNION ALL SELECT 'predictions.patient_id_fk', count(*) FROM events
          WHERE user_id * 10 NOT IN (SELECT c_custkey FROM customer)""")
def v13(t: Tables) -> DataFrame:
    patients = clinical(t).withColumn("id", F.col("patient_id"))
    predictions = t("events").select(
        (F.col("user_id") * 10).cast("string").alias("patient_id"),
        (F.col("value") / 100).alias("response_probability"),
        (F.col("value") / 200).alias("confidence"),
    )
    return warehouse_constraints({"patients": patients, "clinical_data": patients, "predictions": predictions})
