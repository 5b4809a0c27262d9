"""Aggregation and metric queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.catalog.registry import Tables, query
from cohortry.operators import aggregate as A

REFERENCE = ["3", "14", "159", "265", "358"]
REFERENCE_SQL = "(3, 14, 159, 265, 358)"


@query("a1_variants_per_subject", f"""
SELECT l_orderkey, count(DISTINCT l_partkey) AS n_genes_affected, count(DISTINCT l_suppkey) AS n_variants,
       bool_or(l_partkey IN {REFERENCE_SQL}) AS has_epilepsy_gene,
       coalesce(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR))
                FILTER (l_partkey IN {REFERENCE_SQL}), '') AS epilepsy_genes,
       string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS genes,
       string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS variants,
       string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS variant_types
FROM lineitem GROUP BY l_orderkey""")
def a1(t: Tables) -> DataFrame:
    names = ["l_partkey", "l_suppkey", "l_returnflag"]
    out = A.aggregate_variants(t("lineitem"), "l_orderkey", *names, REFERENCE, lists=True)
    return out.select(
        "l_orderkey", "n_genes_affected", "n_variants", "has_epilepsy_gene",
        F.array_join("epilepsy_genes", ",").alias("epilepsy_genes"),
        F.array_join("l_partkey", ",").alias("genes"),
        F.array_join("l_suppkey", ",").alias("variants"),
        F.array_join("l_returnflag", ",").alias("variant_types"),
    )


@query("a1_variants_per_customer", f"""
SELECT o_custkey % 3 AS subject, count(DISTINCT l_partkey) AS n_genes_affected, count(DISTINCT l_suppkey) AS n_variants,
       bool_or(l_partkey IN {REFERENCE_SQL}) AS has_epilepsy_gene,
       coalesce(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR))
                FILTER (l_partkey IN {REFERENCE_SQL}), '') AS epilepsy_genes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def a1_large(t: Tables) -> DataFrame:
    # three subjects with a third of all rows each
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") % 3).alias("subject"), "l_partkey", "l_suppkey", "l_returnflag")
    out = A.aggregate_variants(rows, "subject", "l_partkey", "l_suppkey", "l_returnflag", REFERENCE)
    return out.withColumn("epilepsy_genes", F.array_join("epilepsy_genes", ","))


@query("a2_reference_members", """
SELECT doc_id, has_lang, array_to_string(lang_members, ' ') AS members FROM (
  SELECT doc_id, list_filter(w, lambda x: x IN ('the', 'and', 'des', 'und')) AS lang_members,
         list_has_any(w, ['the', 'and', 'des', 'und']) AS has_lang
  FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents))""")
def a2(t: Tables) -> DataFrame:
    words = t("documents").select("doc_id", F.split(F.lower("text"), " ", -1).alias("w"))
    out = A.reference_members(words, "w", ["the", "and", "des", "und"], "lang")
    return out.select("doc_id", "has_lang", F.array_join("lang_members", " ").alias("members"))


@query("a3_value_lists", """
SELECT l_suppkey, 'l_returnflag' AS attribute, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1, 3
UNION ALL
SELECT l_suppkey, 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 1, 3""")
def a3(t: Tables) -> DataFrame:
    return A.value_lists(t("lineitem"), "l_suppkey", ["l_returnflag", "l_linestatus"])


@query("a3_counts_per_subject", """
SELECT l_suppkey, count(l_partkey) AS n_variants, count(DISTINCT l_partkey) AS n_unique_genes
FROM lineitem GROUP BY l_suppkey""")
def a3_counts(t: Tables) -> DataFrame:
    return _subjects(t).select("l_suppkey", "n_variants", "n_unique_genes")


def _subjects(t: Tables) -> DataFrame:
    return A.genetic_aggregate(
        t("lineitem").withColumn("significance", F.concat("l_returnflag", F.lit(" Pathogenic "), "l_linestatus")),
        "l_suppkey", "l_partkey", "l_returnflag", "significance", [3, 14, 159], ["A", "N", "R"], "a pathogenic o")


@query("a4_any_substring", """
SELECT l_suppkey, CAST(max(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 1 ELSE 0 END) AS INTEGER)
    AS has_pathogenic_variant FROM lineitem GROUP BY l_suppkey""")
def a4(t: Tables) -> DataFrame:
    return _subjects(t).select("l_suppkey", "has_pathogenic_variant")


@query("a5_any_member", """
SELECT l_suppkey, CAST(max(CASE WHEN l_partkey IN (3, 14, 159) THEN 1 ELSE 0 END) AS INTEGER) AS has_epilepsy_gene
FROM lineitem GROUP BY l_suppkey""")
def a5(t: Tables) -> DataFrame:
    return _subjects(t).select("l_suppkey", "has_epilepsy_gene")


@query("a6_pivot_counts", """
SELECT l_partkey, count(*) FILTER (l_returnflag = 'A') AS "n_A", count(*) FILTER (l_returnflag = 'N') AS "n_N",
       count(*) FILTER (l_returnflag = 'R') AS "n_R", CAST(0 AS BIGINT) AS "n_X" FROM lineitem GROUP BY l_partkey""")
def a6(t: Tables) -> DataFrame:
    return A.pivot_counts(t("lineitem"), "l_partkey", "l_returnflag", ["A", "N", "R", "X"])


def complete_view(t: Tables) -> DataFrame:
    """Customers as patients, their orders as clinical rows, orders and order lines as children."""
    patients = t("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("patient_id"), F.col("c_nationkey").alias("age"),
        F.col("c_mktsegment").alias("sex"), F.lit(None).cast("string").alias("created_at"),
        F.lit(None).cast("string").alias("updated_at"))
    profiles = t("orders").select(
        F.col("o_custkey").alias("patient_id"), F.col("o_orderstatus").alias("seizure_type"),
        F.lit(None).cast("double").alias("seizure_frequency_per_month"), F.lit(None).cast("int").alias("age_at_onset"),
        F.lit(None).cast("double").alias("epilepsy_duration_years"), F.col("o_orderpriority").alias("treatment_response"))
    orders = t("orders").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("id"))
    lines = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("part")).join(
        t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("patient_id")),
        "l_orderkey").select("patient_id", F.col("part").alias("id"))
    return A.patient_complete_view(patients, profiles, orders, lines)


@query("a7_patient_complete_view", """
SELECT c.c_custkey AS id, c.c_name AS patient_id, c.c_nationkey AS age, c.c_mktsegment AS sex,
       p.o_orderstatus AS seizure_type, p.o_orderpriority AS treatment_response,
       count(DISTINCT t.o_orderkey) AS total_treatments, count(DISTINCT l.l_partkey) AS total_genetic_variants
FROM customer c
LEFT JOIN (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders) p ON c.c_custkey = p.o_custkey
LEFT JOIN orders t ON c.c_custkey = t.o_custkey
LEFT JOIN lineitem l ON t.o_orderkey = l.l_orderkey
GROUP BY ALL""")
def a7(t: Tables) -> DataFrame:
    return complete_view(t).select(
        "id", "patient_id", "age", "sex", "seizure_type", "treatment_response", "total_treatments",
        "total_genetic_variants")


@query("a8_prediction_stats", """
SELECT event_type AS predicted_treatment, count(*) AS total_predictions, round(avg(value), 6) AS avg_probability,
       round(avg(user_id), 6) AS avg_confidence
FROM events WHERE ts >= DATE '2024-01-31' - INTERVAL 7 DAY GROUP BY event_type""")
def a8(t: Tables) -> DataFrame:
    events = t("events").select(
        F.col("event_type").alias("predicted_treatment"), F.col("value").alias("response_probability"),
        F.col("user_id").alias("confidence"), F.col("ts").alias("created_at"))
    stats = A.prediction_stats(events, F.lit("2024-01-31"), 7)
    return stats.withColumns({c: F.round(c, 6) for c in ("avg_probability", "avg_confidence")})


@query("a9_value_counts", """
SELECT value, n, round(100.0::DOUBLE * n / sum(n) OVER (), 9) AS percentage
FROM (SELECT nullif(o_orderpriority, '5-LOW') AS value, count(*) AS n FROM orders GROUP BY 1)
QUALIFY value IS NOT NULL""")
def a9(t: Tables) -> DataFrame:
    df = t("orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"))
    return A.value_counts(df, "priority").withColumn("percentage", F.round("percentage", 9))


@query("a10_missing_report", """
SELECT 'event_type' AS "column", count(*) FILTER (event_type = 'error') AS missing,
       round(100.0::DOUBLE * count(*) FILTER (event_type = 'error') / count(*), 9) AS percentage FROM events
UNION ALL
SELECT 'value', count(*) FILTER (value > 100), round(100.0::DOUBLE * count(*) FILTER (value > 100) / count(*), 9)
FROM events""")
def a10(t: Tables) -> DataFrame:
    df = t("events").withColumns({
        "event_type": F.nullif("event_type", F.lit("error")),
        "value": F.when(F.col("value") <= 100, F.col("value")),
    })
    return A.missing_report(df).withColumn("percentage", F.round("percentage", 9))


DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


def _describe_sql(template: str, columns: list[str], table: str = "lineitem") -> str:
    return " UNION ALL ".join(template.format(c=c, t=table) for c in columns)


@query("a11_describe", _describe_sql("""
SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       CAST(min({c}) AS DOUBLE) AS "min", round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25,
       round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75,
       CAST(max({c}) AS DOUBLE) AS "max" FROM {t}""", DESCRIBED))
def a11(t: Tables) -> DataFrame:
    out = A.describe_exact(t("lineitem"), DESCRIBED)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})


@query("a12_mean_median_std", """
SELECT 'value' AS "column", round(avg(value), 6) AS mean, round(median(value), 6) AS median,
       round(stddev_samp(value), 6) AS std FROM events""")
def a12(t: Tables) -> DataFrame:
    out = A.column_summary(t("events"), ["value"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "std")})


@query("a12_box_stats", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
           FROM events)
SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
       max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
       count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM events, q GROUP BY q1, median, q3""")
def a12_box(t: Tables) -> DataFrame:
    return A.box_stats(t("events"), "value").withColumns({c: F.round(c, 6) for c in ("q1", "median", "q3")})


CORRELATED = ["l_quantity", "l_extendedprice", "l_discount"]


@query("a13_correlation_matrix", " UNION ALL ".join(
    "SELECT '{a}' AS \"column\", {cells} FROM lineitem".format(a=a, cells=", ".join(
        f"round(corr({a}, {'nullif(l_discount, 0)' if b == 'l_discount' else b}), 9) AS {b}"
        if a != "l_discount" else
        f"round(corr(nullif(l_discount, 0), {'nullif(l_discount, 0)' if b == 'l_discount' else b}), 9) AS {b}"
        for b in CORRELATED)) for a in CORRELATED))
def a13(t: Tables) -> DataFrame:
    df = t("lineitem").withColumn("l_discount", F.nullif("l_discount", F.lit(0.0)))
    return A.corr_matrix(df, CORRELATED).withColumns({c: F.round(c, 9) for c in CORRELATED})


@query("a14_histogram", """
WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
c AS (SELECT least(CAST(floor((value - lo) / ((hi - lo) / 30)) AS BIGINT) + 1, 30) AS bin, count(*) AS n
      FROM events, b GROUP BY 1)
SELECT g.bin, round(lo + (hi - lo) / 30 * (g.bin - 1), 6) AS low, round(lo + (hi - lo) / 30 * g.bin, 6) AS high,
       coalesce(n, 0) AS n
FROM (SELECT unnest(range(1, 31)) AS bin) g CROSS JOIN b LEFT JOIN c ON g.bin = c.bin""")
def a14(t: Tables) -> DataFrame:
    return A.histogram(t("events"), "value", 30).withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("a15_class_weights", """
SELECT l_returnflag AS "class", sum(count(*)) OVER () / (CAST(count(*) OVER () AS DOUBLE) * count(*)) AS weight
FROM lineitem GROUP BY l_returnflag""")
def a15(t: Tables) -> DataFrame:
    return A.class_weights(t("lineitem"), "l_returnflag")


COUNTED = ["customer", "orders", "lineitem", "events"]


@query("a16_table_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS \"table\", count(*) AS \"rows\" FROM {n}" for n in COUNTED))
def a16(t: Tables) -> DataFrame:
    return A.table_counts({n: t(n) for n in COUNTED})


@query("a17_profile", """
SELECT CAST(position AS INTEGER) AS position, "column", non_null, n AS "rows" FROM (
  SELECT 0 AS position, 'event_id' AS "column", count(event_id) AS non_null, count(*) AS n FROM events
  UNION ALL SELECT 1, 'event_type', count(nullif(event_type, 'view')), count(*) FROM events
  UNION ALL SELECT 2, 'value', count(value), count(*) FROM events)""")
def a17(t: Tables) -> DataFrame:
    df = t("events").select("event_id", F.nullif("event_type", F.lit("view")).alias("event_type"), "value")
    return A.profile(df).drop("type")


def _scores(t: Tables) -> DataFrame:
    """Rule-based class scores of the return flag, with many ties; class 2 is claimed rarely."""
    a, n, r = F.col("l_quantity"), F.col("l_discount") * 300, F.col("l_tax") * 200 + 1
    total = a + n + r
    p: Column = F.array(a / total, n / total, r / total)
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return t("lineitem").select(y.alias("y"), p.alias("p")).withColumn(
        "yhat", (F.array_position("p", F.array_max("p")) - 1).cast("int"))


SCORES_SQL = """scores AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
         l_quantity / (l_quantity + l_discount * 300 + (l_tax * 200 + 1)) AS p0,
         l_discount * 300 / (l_quantity + l_discount * 300 + (l_tax * 200 + 1)) AS p1,
         (l_tax * 200 + 1) / (l_quantity + l_discount * 300 + (l_tax * 200 + 1)) AS p2 FROM lineitem),
voted AS (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS yhat FROM scores)"""

METRICS_SQL = """
classes AS (SELECT c, count(*) FILTER (y = c AND yhat = c) AS hit, count(*) FILTER (y = c) AS support,
                   count(*) FILTER (yhat = c) AS claimed FROM voted, (SELECT unnest([0, 1, 2]) AS c) GROUP BY c),
rates AS (SELECT *, CASE WHEN claimed = 0 THEN 0.0 ELSE hit / claimed::DOUBLE END AS p,
                 CASE WHEN support = 0 THEN 0.0 ELSE hit / support::DOUBLE END AS r FROM classes),
metrics AS (SELECT round(sum(hit) / sum(support)::DOUBLE, 9) AS accuracy,
       round(sum(p * support) / sum(support), 9) AS "precision", round(sum(r * support) / sum(support), 9) AS recall,
       round(sum(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END * support) / sum(support), 9) AS f1_score
       FROM rates)"""

AUC_SQL = """
long AS (SELECT 0 AS c, p0 AS s, CAST(y = 0 AS INTEGER) AS pos FROM scores UNION ALL
         SELECT 1, p1, CAST(y = 1 AS INTEGER) FROM scores UNION ALL
         SELECT 2, p2, CAST(y = 2 AS INTEGER) FROM scores),
ranks AS (SELECT c, pos, rank() OVER (PARTITION BY c ORDER BY s) +
                 (count(*) OVER (PARTITION BY c, s) - 1) / 2.0 AS r FROM long),
areas AS (SELECT c, sum(pos)::DOUBLE AS np, sum(1 - pos)::DOUBLE AS nn,
                 (sum(r) FILTER (pos = 1) - sum(pos) * (sum(pos) + 1) / 2.0)
                     / (sum(pos)::DOUBLE * sum(1 - pos)::DOUBLE) AS area
          FROM ranks GROUP BY c),
auc AS (SELECT round(sum(area * np) / sum(np), 9) AS roc_auc FROM areas)"""


@query("a18_classification_metrics", f"WITH {SCORES_SQL}, {METRICS_SQL} SELECT * FROM metrics")
def a18(t: Tables) -> DataFrame:
    out = A.classification_metrics(_scores(t), "y", "yhat")
    return out.withColumns({c: F.round(c, 9) for c in out.columns})


@query("a18_confusion_counts", f"WITH {SCORES_SQL} SELECT y AS label, yhat AS predicted, count(*) AS n FROM voted GROUP BY 1, 2")
def a18_confusion(t: Tables) -> DataFrame:
    return A.confusion_counts(_scores(t), "y", "yhat")


@query("a19_roc_auc", f"WITH {SCORES_SQL}, {AUC_SQL} SELECT * FROM auc")
def a19(t: Tables) -> DataFrame:
    return A.roc_auc_ovr(_scores(t), "y", "p", [0, 1, 2]).withColumn("roc_auc", F.round("roc_auc", 9))


@query("m8_evaluate", f"WITH {SCORES_SQL}, {METRICS_SQL}, {AUC_SQL} SELECT * FROM metrics, auc")
def m8(t: Tables) -> DataFrame:
    out = A.evaluate(_scores(t), "y", "yhat", "p", [0, 1, 2])
    return out.withColumns({c: F.round(c, 9) for c in out.columns})


@query("w1_top_k", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def w1(t: Tables) -> DataFrame:
    return A.top_k(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, ["o_orderkey"])


@query("w1_top_k_per_group", """
SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (
  SELECT o_orderpriority, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
WHERE rank <= 10""")
def w1_group(t: Tables) -> DataFrame:
    df = t("orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return A.top_k_per_group(df, ["o_orderpriority"], "o_totalprice", 10, ["o_orderkey"])
