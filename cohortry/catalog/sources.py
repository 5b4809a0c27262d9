"""Source and sink queries: tables are written to the shared scratch folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.catalog.registry import CLINICAL_SQL, GENETIC_SQL, Tables, clinical, genetic, query
from cohortry.operators.aggregate import aggregate_variants
from cohortry.operators.maintain import union_sources
from cohortry.operators.validate import GENETIC_RULES, coerce, process
from cohortry.pipeline import merge_processed, process_all
from cohortry.plans.session import scratch_path
from cohortry.schemas import CLINICAL, GENETIC, SEIZURE_TYPES
from cohortry.sources import files, warehouse


@query("s1_clinical_csv", f"""
WITH {CLINICAL_SQL} SELECT * REPLACE (nullif(previous_treatments, '') AS previous_treatments) FROM clinical""")
def s1(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "clinical")
    clinical(t).write.option("header", True).csv(path)
    return coerce(files.read_clinical(t.spark, path), CLINICAL)


@query("s3_genetic_csv", f"WITH {GENETIC_SQL} SELECT * FROM genetic")
def s3(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "genetic") + ".csv"
    genetic(t).write.option("header", True).csv(path)
    return coerce(files.read_genetic(t.spark, path), GENETIC)


@query("s4_vcf_lines", """
SELECT 'chr' || l_suppkey AS chrom, CAST(l_partkey AS INTEGER) AS pos, l_returnflag AS ref, l_linestatus AS alt,
       CASE WHEN l_discount > 0 THEN l_quantity END AS qual, 'sample' || (l_orderkey % 3) AS sample_id FROM lineitem""")
def s4(t: Tables) -> DataFrame:
    text = F.concat_ws(
        "\t", F.concat(F.lit("chr"), F.col("l_suppkey").cast("string")), F.col("l_partkey").cast("string"), F.lit("."),
        "l_returnflag", "l_linestatus",
        F.when(F.col("l_discount") > 0, F.col("l_quantity").cast("string")).otherwise(F.lit(".")), F.lit("PASS"))
    sample = F.concat(F.lit("sample"), (F.col("l_orderkey") % 3).cast("string"))
    lines = t("lineitem").select(text.alias("value"), sample.alias("sample"))
    comments = t("orders").select(F.concat(F.lit("##"), "o_orderpriority").alias("value"), F.lit("x").alias("sample"))
    return files.parse_vcf(lines.unionByName(comments), F.col("sample"))


@query("s5_image_stats", """
SELECT l_suppkey, round(avg(l_extendedprice), 4) AS mean_intensity, round(stddev_pop(l_extendedprice), 4) AS std_intensity,
       min(l_extendedprice) AS min_intensity, max(l_extendedprice) AS max_intensity, count(*) AS n_voxels,
       round((0.5::DOUBLE * s_nationkey) * 2.0::DOUBLE * 1.5::DOUBLE * count(*), 6) AS volume_cm3
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey, s_nationkey""")
def s5(t: Tables) -> DataFrame:
    headers = t("supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), (F.col("s_nationkey") * 0.5).alias("dx"), F.lit(2.0).alias("dy"),
        F.lit(1.5).alias("dz"))
    out = files.image_stats(t("lineitem"), "l_suppkey", "l_extendedprice", headers)
    return out.withColumns({"mean_intensity": F.round("mean_intensity", 4), "std_intensity": F.round("std_intensity", 4),
                            "volume_cm3": F.round("volume_cm3", 6)})


@query("s6_modalities", """
SELECT 'eeg' AS modality, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS key_sum FROM events
UNION ALL SELECT 'neuro', count(*), CAST(sum(p_partkey) AS BIGINT) FROM part""")
def s6(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "modalities")
    keys = {"eeg": "event_id", "neuro": "p_partkey"}
    for name, table in (("eeg", "events"), ("neuro", "part")):
        t(table).write.option("header", True).csv(f"{folder}/{name}.csv")
    read = files.read_modalities(t.spark, folder, list(keys))
    return union_sources([
        read[n].agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(k).cast("bigint")).alias("key_sum"))
        .select(F.lit(n).alias("modality"), "n", "key_sum") for n, k in keys.items()])


@query("s7_guideline_files", "SELECT item_id, md5(text || chr(10)) AS text_md5 FROM benchmark")
def s7(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "guidelines")
    t("benchmark").repartition("item_id").write.partitionBy("item_id").text(folder)
    read = files.read_guidelines(t.spark, folder)
    item = F.regexp_extract("source", r"item_id=(\d+)", 1).cast("bigint")
    return read.select(item.alias("item_id"), F.md5("text").alias("text_md5"))


@query("s9_json_round_trip", """
SELECT event_id, nullif(user_id, 3) AS user_id, event_type, value, props, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events""")
def s9(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "events-json")
    df = t("events").withColumn("user_id", F.nullif("user_id", F.lit(3).cast("bigint")))
    files.write_json(df, path)
    back = files.read_json(t.spark, path, df.schema)
    return back.withColumn("stamp", F.date_format("ts", "yyyyMMdd_HHmmss")).drop("ts")


@query("s10_load_warehouse", f"""
WITH {CLINICAL_SQL}, {GENETIC_SQL},
items AS (SELECT unnest(string_split(previous_treatments, ';')) AS x FROM clinical WHERE coalesce(previous_treatments, '') <> '')
SELECT 'patients' AS "table", count(*) AS n, count(*) AS n_ids, md5(min(sha256(patient_id))) AS first_patient FROM clinical
UNION ALL SELECT 'clinical_data', count(*), count(*), md5(min(sha256(patient_id))) FROM clinical
UNION ALL SELECT 'treatments', count(*), count(*), (SELECT md5(min(sha256(patient_id))) FROM clinical
          WHERE coalesce(previous_treatments, '') <> '') FROM items
UNION ALL SELECT 'genetic_variants', count(*), count(*), md5(min(sha256(patient_id))) FROM genetic""")
def s10(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "warehouse")
    created = F.lit("2024-01-31").cast("timestamp")
    names = warehouse.load_warehouse(base, clinical(t), genetic(t), created)
    loaded = warehouse.read_warehouse(t.spark, base, *names)
    # ids apart from the rest and as bytes: together every id would be sorted and shuffled with a least patient of its own
    return union_sources([
        loaded[n].agg(F.count(F.lit(1)).alias("n"), F.md5(F.min("id" if n == "patients" else "patient_id")).alias("first_patient"))
        .crossJoin(loaded[n].agg(F.count_distinct(F.unhex("id")).alias("n_ids")))
        .select(F.lit(n).alias("table"), "n", "n_ids", "first_patient") for n in names])


@query("s11_prediction_sink", """
SELECT strftime(ts, '%Y-%m-%d') AS created_date, event_type AS predicted_treatment, count(*) AS n,
       round(avg(user_id / 1000.0::DOUBLE), 6) AS confidence
FROM events GROUP BY 1, 2""")
def s11(t: Tables) -> DataFrame:
    scored = t("events").select(
        F.col("event_id").cast("string").alias("patient_id"), F.col("event_type").alias("predicted_treatment"),
        (F.col("user_id") / 1000).alias("response_probability"), (F.col("user_id") / 1000).alias("confidence"),
        F.col("props").alias("explanation"), F.col("ts").cast("timestamp").alias("at"))
    path = scratch_path(t.spark, "predictions")
    warehouse.write_predictions(warehouse.prediction_rows(scored, "v1", F.col("at")), path)
    return t.spark.read.parquet(path).groupBy(
        F.col("created_date").cast("string").alias("created_date"), "predicted_treatment").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("confidence").cast("double")), 6).alias("confidence"))


@query("s13_model_registry", """
SELECT 'v2' AS version, 'ensemble' AS model_type, count(*) AS dataset_size, true AS is_active FROM lineitem""")
def s13(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "models")
    n = t("lineitem").count()
    for version in ("v1", "v2"):
        row = warehouse.model_metadata(t.spark, version, "ensemble", {"f1_score": 0.5}, {}, n, ["l_quantity"])
        warehouse.append_model_metadata(row, path)
    return warehouse.model_info(t.spark, path).select("version", "model_type", "dataset_size", "is_active")


@query("x1_process_all", f"""
WITH {CLINICAL_SQL}, {GENETIC_SQL},
valid AS (SELECT *, CAST(patient_id AS BIGINT) AS k FROM clinical
          WHERE age <= 120 AND seizure_frequency_per_month >= 0 AND coalesce(previous_treatments, '') <> ''),
agg AS (SELECT patient_id, count(DISTINCT gene) AS n_genes_affected, count(DISTINCT variant) AS n_variants,
               bool_or(gene IN ('SCN1A', 'KCNQ2', 'CDKL5')) AS has_epilepsy_gene FROM genetic GROUP BY patient_id)
SELECT patient_id, age - age_at_onset AS years_since_onset, CAST(3 AS INTEGER) AS n_previous_treatments,
       dense_rank() OVER (ORDER BY sex) - 1 AS sex_encoded,
       dense_rank() OVER (ORDER BY treatment_response) - 1 AS treatment_response_encoded,
       round((age - avg(age) OVER ()) / stddev_pop(age) OVER (), 7) AS age_scaled,
       n_genes_affected, n_variants, has_epilepsy_gene
FROM valid LEFT JOIN agg USING (patient_id)""")
def x1(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "cohort")
    kinds = F.array(*[F.lit(k) for k in SEIZURE_TYPES])
    which = (F.col("patient_id").cast("bigint") % len(SEIZURE_TYPES) + 1).cast("int")
    clinical(t).withColumn("seizure_type", F.element_at(kinds, which)).write.option("header", True).csv(f"{folder}/c.csv")
    genetic(t).write.option("header", True).csv(f"{folder}/g.csv")
    done = process_all(t.spark, {"clinical": f"{folder}/c.csv", "genetic": f"{folder}/g.csv"})
    merged = merge_processed(done)
    return merged.select(
        "patient_id", "years_since_onset", "n_previous_treatments", "sex_encoded", "treatment_response_encoded",
        F.round("age_scaled", 7).alias("age_scaled"), "n_genes_affected", "n_variants", "has_epilepsy_gene")


@query("x1_process_vcf", """
WITH v AS (SELECT l_orderkey % 200 AS s, l_partkey % 50 AS pos, l_returnflag AS ref, l_linestatus AS alt FROM lineitem),
r AS (SELECT 'P' || s AS patient_id, CASE WHEN pos % 2 = 0 THEN 'SCN1A' ELSE 'GENE' || pos END AS gene,
             'chr1:' || pos || ref || '>' || alt AS variant FROM v)
SELECT patient_id, count(DISTINCT gene) AS n_genes_affected, count(DISTINCT variant) AS n_variants,
       bool_or(gene = 'SCN1A') AS has_epilepsy_gene FROM r GROUP BY patient_id""")
def x1_vcf(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "vcf")
    sample = F.col("l_orderkey") % 200
    line = F.concat_ws("\t", F.lit("chr1"), (F.col("l_partkey") % 50).cast("string"), F.lit("."), "l_returnflag",
                       "l_linestatus", F.lit("."), F.lit("PASS"))
    # one folder per sample; the sample's name is in the file's path
    t("lineitem").select(sample.alias("sample"), line.alias("value")).write.partitionBy("sample").option(
        "compression", "gzip").text(folder)
    lines = t.spark.read.text(folder)
    variants = files.parse_vcf(lines, F.col("sample").cast("string"))
    samples = t("lineitem").select(sample.cast("string").alias("sample_id")).distinct().withColumn(
        "patient_id", F.concat(F.lit("P"), "sample_id"))
    position = (F.col("l_partkey") % 50).cast("int")
    genes = t("lineitem").select(
        F.lit("chr1").alias("chrom"), position.alias("pos"), F.lit("missense").alias("variant_type"),
        F.when(position % 2 == 0, "SCN1A").otherwise(F.concat(F.lit("GENE"), position.cast("string"))).alias("gene")).distinct()
    done = process(files.annotate_variants(variants, samples, genes), GENETIC_RULES, aggregate_variants, "genetic")
    return done.data.select("patient_id", "n_genes_affected", "n_variants", "has_epilepsy_gene")
