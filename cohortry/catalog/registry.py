"""Query registry and the stand-in tables that play the clinical roles."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    """Register ``fn(tables)`` under ``name``, with the SQL that must give the same rows."""

    def register(fn: Callable[[Tables], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(spark, folder))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# ---------------------------------------------------------------------------
# Stand-ins: customers are patients, order lines their variants.
# ---------------------------------------------------------------------------
def clinical(t: Tables) -> DataFrame:
    """Clinical rows from customer, one per patient."""
    key = F.col("c_custkey")
    return t("customer").select(
        key.cast("string").alias("patient_id"),
        (key % 125).cast("int").alias("age"),
        F.element_at(F.array(F.lit("M"), F.lit("F"), F.lit("Other")), (F.col("c_nationkey") % 3 + 1)).alias("sex"),
        F.col("c_mktsegment").alias("seizure_type"),
        F.col("c_acctbal").alias("seizure_frequency_per_month"),
        (key % 40).cast("int").alias("age_at_onset"),
        F.col("c_nationkey").cast("double").alias("epilepsy_duration_years"),
        F.when(key % 7 == 0, F.lit(None)).when(key % 7 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("Levetiracetam;"), F.lower("c_mktsegment"), F.lit(";topiramate"))
                   ).alias("previous_treatments"),
        F.element_at(F.array(F.lit("responder"), F.lit("non_responder"), F.lit("partial_responder")),
                     (key % 3 + 1).cast("int")).alias("treatment_response"),
    )


CLINICAL_SQL = """clinical AS (
  SELECT CAST(c_custkey AS VARCHAR) AS patient_id, CAST(c_custkey % 125 AS INTEGER) AS age,
         CASE c_nationkey % 3 WHEN 0 THEN 'M' WHEN 1 THEN 'F' ELSE 'Other' END AS sex,
         c_mktsegment AS seizure_type, c_acctbal AS seizure_frequency_per_month,
         CAST(c_custkey % 40 AS INTEGER) AS age_at_onset, CAST(c_nationkey AS DOUBLE) AS epilepsy_duration_years,
         CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 = 1 THEN ''
              ELSE 'Levetiracetam;' || lower(c_mktsegment) || ';topiramate' END AS previous_treatments,
         CASE c_custkey % 3 WHEN 0 THEN 'responder' WHEN 1 THEN 'non_responder'
              ELSE 'partial_responder' END AS treatment_response
  FROM customer)"""


def genetic(t: Tables) -> DataFrame:
    """Variant rows from order lines, keyed by the customer."""
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_discount")
    orders = t("orders").select("o_orderkey", "o_custkey")
    genes = F.array(*[F.lit(g) for g in GENES])
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("string").alias("patient_id"),
        F.element_at(genes, (F.col("l_partkey") % len(GENES) + 1).cast("int")).alias("gene"),
        F.concat(F.lit("p.R"), F.col("l_suppkey").cast("string"), F.lit("H")).alias("variant"),
        F.element_at(F.array(F.lit("missense"), F.lit("nonsense"), F.lit("frameshift"), F.lit("splice_site"),
                             F.lit("synonymous")), (F.col("l_partkey") % 5 + 1).cast("int")).alias("variant_type"),
        F.col("l_discount").alias("allele_frequency"),
        F.when(F.col("l_returnflag") == "A", F.lit("Likely pathogenic"))
        .when(F.col("l_returnflag") == "N", F.lit("Uncertain significance")).alias("clinvar_significance"),
    )


GENES = ["SCN1A", "KCNQ2", "CDKL5", "BRCA1", "TP53", "APOE", "MTHFR"]

GENETIC_SQL = """genetic AS (
  SELECT CAST(o_custkey AS VARCHAR) AS patient_id,
         (['SCN1A','KCNQ2','CDKL5','BRCA1','TP53','APOE','MTHFR'])[CAST(l_partkey % 7 + 1 AS INTEGER)] AS gene,
         'p.R' || l_suppkey || 'H' AS variant,
         (['missense','nonsense','frameshift','splice_site','synonymous'])[CAST(l_partkey % 5 + 1 AS INTEGER)]
             AS variant_type,
         l_discount AS allele_frequency,
         CASE l_returnflag WHEN 'A' THEN 'Likely pathogenic' WHEN 'N' THEN 'Uncertain significance' END
             AS clinvar_significance
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
