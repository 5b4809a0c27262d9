"""Split, fold, confidence and distribution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.catalog.documents import CENTROIDS_SQL, centroids
from cohortry.catalog.registry import Tables, query
from cohortry.operators import split as W
from cohortry.operators.documents import vector_search

RANKED_SQL = """ranked AS (
  SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority
             ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42')) AS rn,
         count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)"""


@query("w2_retrieval_confidence", f"""
WITH {CENTROIDS_SQL}
SELECT query_id, round(sum((1 - distance) / rank) / sum(1.0 / rank), 6) AS confidence FROM ranked WHERE rank <= 5
GROUP BY query_id UNION ALL SELECT -1, 0""")
def w2(t: Tables) -> DataFrame:
    # the cosine distances of a search; a query without hits has confidence 0
    wanted = centroids(t)
    asked = wanted.select("query_id").unionByName(t.spark.range(-1, 0).select(F.col("id").cast("int").alias("query_id")))
    out = W.retrieval_confidence(vector_search(t("embeddings"), wanted, 5, doc_id="vec_id"), asked)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("w3_stratified_split", f"""
WITH {RANKED_SQL}
SELECT o_orderkey, o_orderpriority, CASE WHEN rn <= round(n * 0.7::DOUBLE) THEN 'train'
    WHEN rn <= round(n * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM ranked""")
def w3(t: Tables) -> DataFrame:
    return W.stratified_split(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority")


@query("w3_plain_split", """
WITH ranked AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|7')) AS rn,
                       count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN rn <= round(n * 0.5::DOUBLE) THEN 'train' WHEN rn <= round(n * 0.75::DOUBLE) THEN 'val'
    ELSE 'test' END AS split FROM ranked""")
def w3_plain(t: Tables) -> DataFrame:
    return W.stratified_split(t("orders").select("o_orderkey"), "o_orderkey", None, (0.5, 0.25, 0.25), 7)


@query("w3_hash_split", """
SELECT l_orderkey, l_linenumber, CASE WHEN p < 0.7::DOUBLE THEN 'train' WHEN p < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val'
    ELSE 'test' END AS split
FROM (SELECT l_orderkey, l_linenumber,
             ('0x' || substr(md5(l_orderkey || '|42'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS p FROM lineitem)""")
def w3_hash(t: Tables) -> DataFrame:
    return W.hash_split(t("lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")


@query("w4_stratified_folds", f"""
WITH {RANKED_SQL}
SELECT o_orderkey, o_orderpriority, CAST((rn > round(n * 0.2::DOUBLE))::INT + (rn > round(n * 0.4::DOUBLE))::INT
    + (rn > round(n * 0.6::DOUBLE))::INT + (rn > round(n * 0.8::DOUBLE))::INT AS INTEGER) AS fold FROM ranked""")
def w4(t: Tables) -> DataFrame:
    return W.assign_folds(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority")


COMPARED = ["l_quantity", "l_extendedprice", "l_discount"]


def _ks_sql() -> str:
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS c, {c} AS v, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS a FROM lineitem"
        for c in COMPARED)
    return f"""
WITH long AS ({long}),
cdf AS (SELECT c, v, sum(sum(a)) OVER w / (sum(sum(a)) OVER (PARTITION BY c))::DOUBLE AS f1,
               sum(sum(1 - a)) OVER w / (sum(sum(1 - a)) OVER (PARTITION BY c))::DOUBLE AS f2
        FROM long GROUP BY c, v WINDOW w AS (PARTITION BY c ORDER BY v)),
ks AS (SELECT c, max(abs(f1 - f2)) AS d FROM cdf GROUP BY c),
st AS (SELECT c, avg(v) FILTER (a = 1) AS m1, avg(v) FILTER (a = 0) AS m2, stddev_samp(v) FILTER (a = 1) AS s1,
              stddev_samp(v) FILTER (a = 0) AS s2, (count(*) FILTER (a = 1))::DOUBLE AS n1,
              (count(*) FILTER (a = 0))::DOUBLE AS n2 FROM long GROUP BY c),
x AS (SELECT *, sqrt(n1 * n2 / (n1 + n2)) * d AS z FROM ks JOIN st USING (c)),
p AS (SELECT c, 2 * sum((CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * z * z)) AS p
      FROM x, (SELECT unnest(range(1, 20001)) AS j) GROUP BY c)
SELECT c AS "column", round(m1, 6) AS df1_mean, round(m2, 6) AS df2_mean, round(s1, 6) AS df1_std,
       round(s2, 6) AS df2_std, round(d, 9) AS ks_statistic, round(p, 6) AS p_value, p < 0.05 AS distributions_differ
FROM x JOIN p USING (c)"""


@query("w5_compare_distributions", _ks_sql())
def w5(t: Tables) -> DataFrame:
    lines = t("lineitem")
    out = W.compare_distributions(
        lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag <> 'A'"), [*COMPARED, "absent"])
    digits = {"df1_mean": 6, "df2_mean": 6, "df1_std": 6, "df2_std": 6, "ks_statistic": 9, "p_value": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})
