"""Join and table-maintenance queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.catalog.registry import CLINICAL_SQL, GENETIC_SQL, Tables, clinical, genetic, query
from cohortry.operators import aggregate as A
from cohortry.operators import join as J
from cohortry.operators import maintain as U
from cohortry.operators.features import imaging_features
from cohortry.plans.partitions import read_partitioned, store_partitioned
from cohortry.plans.session import scratch_path
from cohortry.plans.skew import fan_out_left_join


@query("j1_merge_modalities", """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, a.n_lines, round(a.o_totalprice, 4) AS o_totalprice_lines,
       w.n_events, w.o_totalprice AS o_totalprice_events
FROM orders o
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice) AS o_totalprice FROM lineitem GROUP BY 1) a
  ON o.o_orderkey = a.l_orderkey
LEFT JOIN (SELECT event_id % 5000 AS k, count(*) AS n_events, max(value) AS o_totalprice FROM events GROUP BY 1) w
  ON o.o_orderkey = w.k""")
def j1(t: Tables) -> DataFrame:
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_extendedprice").alias("o_totalprice"))
    events = t("events").groupBy((F.col("event_id") % 5000).alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n_events"), F.max("value").alias("o_totalprice"))
    base = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    merged = J.merge_modalities(base, {"lines": lines, "events": events}, "o_orderkey")
    return merged.withColumn("o_totalprice_lines", F.round("o_totalprice_lines", 4))


@query("j2_genetic_features", f"""
WITH {CLINICAL_SQL}, {GENETIC_SQL},
agg AS (SELECT patient_id, count(*) AS n_variants, count(*) FILTER (variant_type = 'frameshift') AS n_frameshift,
               max(CASE WHEN gene IN ('SCN1A', 'KCNQ2', 'CDKL5') THEN 1 ELSE 0 END) AS has_epilepsy_gene
        FROM genetic GROUP BY 1)
SELECT patient_id, age, coalesce(n_variants, 0) AS n_variants, coalesce(n_frameshift, 0) AS n_frameshift,
       CAST(coalesce(has_epilepsy_gene, 0) AS INTEGER) AS has_epilepsy_gene
FROM clinical LEFT JOIN agg USING (patient_id)""")
def j2(t: Tables) -> DataFrame:
    out = A.genetic_features(clinical(t), genetic(t))
    return out.select("patient_id", "age", "n_variants", "n_frameshift", "has_epilepsy_gene")


@query("j3_imaging_join", """
WITH m AS (SELECT avg(o_totalprice / 100) AS mean, stddev_samp(o_totalprice / 100) AS sd FROM orders)
SELECT c_custkey AS patient_id, c_mktsegment, round((o_totalprice / 100 - mean) / sd, 7) AS mean_intensity_norm,
       CASE WHEN o_orderkey IS NOT NULL THEN round(greatest(0.0, (3500.0 - o_totalprice / 100) / 3500.0), 9) END
           AS hippocampal_atrophy,
       round((o_totalprice / 100) / (o_totalprice / 50 + 1e-6), 7) AS hippocampal_to_wm_ratio
FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN m ON true""")
def j3(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    imaging = t("orders").select(
        F.col("o_custkey").alias("patient_id"), (price / 100).alias("mean_intensity"),
        (price / 100).alias("hippocampal_volume"), (price / 50).alias("white_matter_volume"))
    patients = t("customer").select(F.col("c_custkey").alias("patient_id"), "c_mktsegment")
    out = fan_out_left_join(patients, imaging_features(imaging), ["patient_id"])
    return out.select(
        "patient_id", "c_mktsegment", F.round("mean_intensity_norm", 7).alias("mean_intensity_norm"),
        F.round("hippocampal_atrophy", 9).alias("hippocampal_atrophy"),
        F.round("hippocampal_to_wm_ratio", 7).alias("hippocampal_to_wm_ratio"))


@query("j4_resolve_keys", """
SELECT o_orderkey, sha256(CAST(c_name AS VARCHAR)) AS o_custkey
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3""")
def j4(t: Tables) -> DataFrame:
    parents = t("customer").filter("c_nationkey <> 3").select("c_custkey", J.surrogate("c_name").alias("id"))
    return J.resolve_keys(t("orders").select("o_orderkey", "o_custkey"), parents, "c_custkey", "id", "o_custkey")


@query("j5_similar_by_profile", """
SELECT p2.p_partkey AS similar_patient_id,
       CAST((CASE WHEN p1.p_type = p2.p_type THEN 1.0 ELSE 0.0 END
        + CASE WHEN abs(p1.p_size - p2.p_size) <= 5 THEN 0.5 ELSE 0.0 END
        + CASE WHEN abs(p1.p_retailprice - p2.p_retailprice) <= 2 THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS similarity_score
FROM part p1 JOIN part p2 ON p1.p_partkey <> p2.p_partkey WHERE p1.p_partkey = 42
ORDER BY similarity_score DESC, similar_patient_id LIMIT 20""")
def j5(t: Tables) -> DataFrame:
    return J.similar_by_profile(t("part"), 42, 20, "p_partkey", "p_type", "p_size", "p_retailprice")


@query("j5_similar_many_records", """
SELECT o2.o_custkey AS similar_patient_id,
       max(CAST((CASE WHEN o1.o_orderpriority = o2.o_orderpriority THEN 1.0 ELSE 0.0 END
        + CASE WHEN abs(day(o1.o_orderdate) - day(o2.o_orderdate)) <= 5 THEN 0.5 ELSE 0.0 END
        + CASE WHEN abs(o1.o_totalprice - o2.o_totalprice) <= 2000 THEN 0.5 ELSE 0.0 END) AS DOUBLE))
           AS similarity_score
FROM orders o1 JOIN orders o2 ON o1.o_custkey <> o2.o_custkey WHERE o1.o_custkey = 42
GROUP BY 1 ORDER BY similarity_score DESC, similar_patient_id LIMIT 20""")
def j5_many(t: Tables) -> DataFrame:
    orders = t("orders").select("o_custkey", "o_orderpriority", "o_totalprice", F.day("o_orderdate").alias("day"))
    return J.similar_by_profile(orders, 42, 20, "o_custkey", "o_orderpriority", "day", "o_totalprice",
                                frequency_within=2000)


@query("j5_similar_many_profiles", """
SELECT o2.o_custkey % 10 AS similar_patient_id,
       max(CAST((CASE WHEN o1.o_orderpriority = o2.o_orderpriority THEN 1.0 ELSE 0.0 END
        + CASE WHEN abs(day(o1.o_orderdate) - day(o2.o_orderdate)) <= 1 THEN 0.5 ELSE 0.0 END
        + CASE WHEN abs(o1.o_totalprice - o2.o_totalprice) <= 0.02 THEN 0.5 ELSE 0.0 END) AS DOUBLE))
           AS similarity_score
FROM orders o1 JOIN orders o2 ON o1.o_custkey % 10 <> o2.o_custkey % 10 WHERE o1.o_custkey % 10 = 3
GROUP BY 1 ORDER BY similarity_score DESC, similar_patient_id LIMIT 5""")
def j5_many_profiles(t: Tables) -> DataFrame:
    # ten subjects with very many records: the probe has more profiles than a page from sf0.01 on
    orders = t("orders").select((F.col("o_custkey") % 10).alias("subject"), "o_orderpriority", "o_totalprice",
                                F.day("o_orderdate").alias("day"))
    return J.similar_by_profile(orders, 3, 5, "subject", "o_orderpriority", "day", "o_totalprice", 1, 0.02)


@query("j5_all_patients", """
WITH scored AS (
  SELECT a.c_custkey AS patient_id, b.c_custkey AS similar_patient_id,
         CAST((CASE WHEN a.c_mktsegment = b.c_mktsegment THEN 1.0 ELSE 0.0 END
          + CASE WHEN abs(a.c_nationkey - b.c_nationkey) <= 2 THEN 0.5 ELSE 0.0 END
          + CASE WHEN abs(a.c_acctbal - b.c_acctbal) <= 20 THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS similarity_score
  FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey),
ranked AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY similarity_score DESC, similar_patient_id) AS rank
           FROM scored)
SELECT patient_id, CAST(rank AS INTEGER) AS rank, similar_patient_id, similarity_score FROM ranked WHERE rank <= 10""")
def j5_all(t: Tables) -> DataFrame:
    return J.similar_to_each(t("customer"), 10, "c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal", 2, 20)


@query("j6_distinct_counts_over_fan_out", """
SELECT n.n_nationkey AS id, n.n_name AS patient_id, count(DISTINCT c.c_custkey) AS total_treatments,
       count(DISTINCT s.s_suppkey) AS total_genetic_variants
FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey
GROUP BY ALL""")
def j6(t: Tables) -> DataFrame:
    nothing = F.lit(None)
    patients = t("nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("patient_id"), nothing.alias("age"),
        nothing.alias("sex"), nothing.alias("created_at"), nothing.alias("updated_at"))
    regions = t("nation").select(F.col("n_nationkey").alias("patient_id"), *[nothing.alias(c) for c in (
        "seizure_type", "seizure_frequency_per_month", "age_at_onset", "epilepsy_duration_years",
        "treatment_response")])
    customers = t("customer").select(F.col("c_nationkey").alias("patient_id"), F.col("c_custkey").alias("id"))
    suppliers = t("supplier").select(F.col("s_nationkey").alias("patient_id"), F.col("s_suppkey").alias("id"))
    out = A.patient_complete_view(patients, regions, customers, suppliers)
    return out.select("id", "patient_id", "total_treatments", "total_genetic_variants")


@query("j7_endpoints_exist", """
SELECT CAST(o_custkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
  AND l_partkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def j7(t: Tables) -> DataFrame:
    nodes = t("customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("id"))
    edges = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"))
    return J.endpoints_exist(edges, nodes)


@query("j8_unseen_ids", """
SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT item_id * 3 FROM benchmark)""")
def j8(t: Tables) -> DataFrame:
    existing = t("benchmark").select((F.col("item_id") * 3).alias("id"))
    return J.unseen(t("documents").select(F.col("doc_id").alias("id"), "lang"), existing)


@query("u1_union_sources", """
SELECT doc_id AS id, md5(text) AS digest, lang, CAST(NULL AS VARCHAR) AS kind FROM documents
UNION ALL SELECT item_id, md5(text), NULL, 'benchmark' FROM benchmark""")
def u1(t: Tables) -> DataFrame:
    documents = t("documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("digest"), "lang")
    items = t("benchmark").select(F.col("item_id").alias("id"), F.md5("text").alias("digest"),
                                  F.lit("benchmark").alias("kind"))
    return U.union_sources([documents, items])


@query("u2_distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def u2(t: Tables) -> DataFrame:
    return U.distinct_rows(t("lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus"])


@query("u3_upsert", """
WITH up AS (SELECT * FROM (
    SELECT o_custkey + 7 AS k, o_orderstatus AS seg,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, c_nationkey,
       CASE WHEN c_custkey IS NOT NULL THEN 'old' ELSE 'now' END AS created_at,
       CASE WHEN k IS NOT NULL THEN 'now' ELSE 'old' END AS updated_at
FROM customer FULL OUTER JOIN up ON c_custkey = k""")
def u3(t: Tables) -> DataFrame:
    target = t("customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.lit("old").alias("created_at"),
                                  F.lit("old").alias("updated_at"))
    updates = t("orders").select((F.col("o_custkey") + 7).alias("c_custkey"),
                                 F.col("o_orderstatus").alias("c_mktsegment"), "o_orderkey")
    return U.upsert(target, updates, "c_custkey", F.lit("now"), order=[F.desc("o_orderkey")])


@query("u3_partitioned_upsert", """
WITH up AS (SELECT * FROM (
    SELECT o_custkey + 7 AS k, o_orderstatus AS seg,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders
    WHERE o_orderpriority = '1-URGENT') WHERE rn = 1)
SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, c_nationkey,
       CASE WHEN c_custkey IS NOT NULL THEN 'old' ELSE 'now' END AS created_at,
       CASE WHEN k IS NOT NULL THEN 'now' ELSE 'old' END AS updated_at
FROM customer FULL OUTER JOIN up ON c_custkey = k""")
def u3_partitioned(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "customers")
    target = t("customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.lit("old").alias("created_at"),
                                  F.lit("old").alias("updated_at"))
    store_partitioned(target, path, ["c_custkey"], 16)
    updates = t("orders").filter("o_orderpriority = '1-URGENT'").select(
        (F.col("o_custkey") + 7).alias("c_custkey"), F.col("o_orderstatus").alias("c_mktsegment"), "o_orderkey")
    U.upsert_stored(t.spark, path, updates, "c_custkey", F.lit("now"), [F.desc("o_orderkey")])
    return read_partitioned(t.spark, path)


@query("u4_cascade_delete", """
WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
     dead AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
SELECT 'customer' AS "table", count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum FROM customer
WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM dead)""")
def u4(t: Tables) -> DataFrame:
    tables = {n: t(n) for n in ("customer", "orders", "lineitem")}
    gone = t("customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    left = U.cascade_delete(
        tables, "customer", gone,
        [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey")],
        "c_custkey")
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    return U.union_sources([
        left[n].agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("key_sum")).select(F.lit(n).alias("table"), "n", "key_sum")
        for n, k in keys.items()])


@query("u5_drop_collection", "SELECT count(*) AS n_before, false AS exists_after FROM documents")
def u5(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "collection")
    name = "collection_" + path.rsplit("-", 1)[1]
    t("documents").write.option("path", path).saveAsTable(name)
    n_before = t.spark.table(name).count()
    U.drop_collection(t.spark, name)
    return t.spark.createDataFrame(
        [(n_before, t.spark.catalog.tableExists(name))], "n_before bigint, exists_after boolean")
