"""Feature, scalar-function and scaler queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.catalog.registry import CLINICAL_SQL, GENETIC_SQL, Tables, clinical, genetic, query
from cohortry.functions import scalar as S
from cohortry.functions import text as X
from cohortry.operators import aggregate, encode, features
from cohortry.operators.documents import build_prompts
from cohortry.schemas import AGE_EDGES, AGE_LABELS, ONSET_EDGES, ONSET_LABELS
from cohortry.sources.warehouse import explode_treatments


@query("p1_years_since_onset", """
SELECT p_partkey, p_size * 2 - CAST(p_partkey % 40 AS INTEGER) AS years_since_onset,
       (p_size * 2 - CAST(p_partkey % 40 AS INTEGER)) * (p_size * 2 - CAST(p_partkey % 40 AS INTEGER))
           AS years_since_onset_squared
FROM part""")
def p1(t: Tables) -> DataFrame:
    df = t("part").select("p_partkey", (F.col("p_size") * 2).alias("age"),
                          (F.col("p_partkey") % 40).cast("int").alias("age_at_onset"))
    return features.temporal_features(df).select("p_partkey", "years_since_onset", "years_since_onset_squared")


@query("p2_burden", """
SELECT l_orderkey, l_linenumber, l_quantity * l_discount * 12 AS seizure_burden, l_quantity * 12 AS avg_yearly_seizures
FROM lineitem""")
def p2(t: Tables) -> DataFrame:
    df = features.temporal_features(t("lineitem"), frequency="l_quantity", duration="l_discount")
    return df.select("l_orderkey", "l_linenumber", "seizure_burden", "avg_yearly_seizures")


@query("p3_age_bands", """
SELECT p_partkey, CASE WHEN v > 0 AND v <= 12 THEN 'child' WHEN v > 12 AND v <= 18 THEN 'adolescent'
    WHEN v > 18 AND v <= 30 THEN 'young_adult' WHEN v > 30 AND v <= 50 THEN 'adult'
    WHEN v > 50 AND v <= 120 THEN 'senior' END AS band
FROM (SELECT p_partkey, p_size * 3 - 3 AS v FROM part)""")
def p3(t: Tables) -> DataFrame:
    df = t("part").select("p_partkey", (F.col("p_size") * 3 - 3).alias("v"))
    return features.bin_column(df, "v", AGE_EDGES, AGE_LABELS, "band").drop("v")


@query("p4_onset_bands", """
SELECT p_partkey, CASE WHEN v > 0 AND v <= 1 THEN 'neonatal' WHEN v > 1 AND v <= 5 THEN 'infant'
    WHEN v > 5 AND v <= 12 THEN 'childhood' WHEN v > 12 AND v <= 18 THEN 'adolescent'
    WHEN v > 18 AND v <= 120 THEN 'adult_onset' END AS band
FROM (SELECT p_partkey, p_size - 1 AS v FROM part)""")
def p4(t: Tables) -> DataFrame:
    df = t("part").select("p_partkey", (F.col("p_size") - 1).alias("v"))
    return features.bin_column(df, "v", ONSET_EDGES, ONSET_LABELS, "band").drop("v")


@query("p5_one_hot", """
SELECT c_custkey, c_mktsegment = 'BUILDING' AS "seg_BUILDING", c_mktsegment = 'MACHINERY' AS "seg_MACHINERY",
       false AS "seg_UNSEEN" FROM customer""")
def p5(t: Tables) -> DataFrame:
    df = t("customer").select("c_custkey", "c_mktsegment")
    return features.one_hot(df, "c_mktsegment", ["BUILDING", "MACHINERY", "UNSEEN"], "seg")


def _names(t: Tables) -> DataFrame:
    name = F.when(F.col("p_size") == 1, F.lit(None)).when(F.col("p_size") == 2, F.lit("")).otherwise(F.col("p_name"))
    return t("part").select("p_partkey", name.alias("previous_treatments"))


NAMES_SQL = """(SELECT p_partkey, CASE WHEN p_size = 1 THEN NULL WHEN p_size = 2 THEN '' ELSE p_name END AS s FROM part)"""


@query("p6_item_count_etl", f"""
SELECT p_partkey, CAST(CASE WHEN s IS NOT NULL THEN len(string_split(s, ' ')) END AS INTEGER) AS n_previous_treatments,
       s IS NOT NULL AS has_previous_treatment FROM {NAMES_SQL}""")
def p6(t: Tables) -> DataFrame:
    return features.treatment_counts(_names(t), sep=" ", empty_as_one=True).drop("previous_treatments")


@query("p7_item_count", f"""
SELECT p_partkey, CAST(CASE WHEN coalesce(s, '') = '' THEN 0 ELSE len(string_split(s, ' ')) END AS INTEGER)
           AS n_previous_treatments,
       CASE WHEN coalesce(s, '') = '' THEN 0 ELSE 1 END AS has_previous_treatment FROM {NAMES_SQL}""")
def p7(t: Tables) -> DataFrame:
    return features.treatment_counts(_names(t), sep=" ").drop("previous_treatments")


@query("p8_keyword_flags", """
SELECT doc_id, CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END AS prev_the,
       CASE WHEN contains(lower(text), 'eau') THEN 1 ELSE 0 END AS prev_eau,
       CASE WHEN contains(lower(text), 'ung') THEN 1 ELSE 0 END AS prev_ung FROM documents""")
def p8(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", *[
        c.alias(n) for n, c in S.keyword_flags("text", ["the", "eau", "ung"]).items()])


@query("p9_saturating_score", """
SELECT l_orderkey, l_linenumber, least(l_linenumber / 5.0, 1.0) AS score FROM lineitem""")
def p9(t: Tables) -> DataFrame:
    return t("lineitem").select("l_orderkey", "l_linenumber", S.saturating_score("l_linenumber").alias("score"))


@query("p10_interactions", """
SELECT l_orderkey, l_linenumber, l_quantity * l_discount AS l_quantity_x_l_discount,
       round(l_quantity / (l_discount + 1e-6), 4) AS l_quantity_div_l_discount,
       l_extendedprice * l_tax AS l_extendedprice_x_l_tax,
       round(l_extendedprice / (l_tax + 1e-6), 2) AS l_extendedprice_div_l_tax FROM lineitem""")
def p10(t: Tables) -> DataFrame:
    pairs = [("l_quantity", "l_discount"), ("l_extendedprice", "l_tax"), ("l_quantity", "absent")]
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_tax"]
    out = features.interactions(t("lineitem").select(*columns), pairs).drop(*columns[2:])
    return out.withColumns({
        "l_quantity_div_l_discount": F.round("l_quantity_div_l_discount", 4),
        "l_extendedprice_div_l_tax": F.round("l_extendedprice_div_l_tax", 2),
    })


@query("p11_polynomial", """
SELECT l_orderkey, l_linenumber, l_quantity * l_quantity AS "l_quantity^2", l_quantity * l_discount AS "l_quantity l_discount",
       l_quantity * l_tax AS "l_quantity l_tax", l_discount * l_discount AS "l_discount^2",
       l_discount * l_tax AS "l_discount l_tax", l_tax * l_tax AS "l_tax^2" FROM lineitem""")
def p11(t: Tables) -> DataFrame:
    columns = ["l_quantity", "l_discount", "l_tax"]
    return features.polynomial(t("lineitem").select("l_orderkey", "l_linenumber", *columns), columns, 2).drop(*columns)


@query("p12_ratio", """
SELECT o_orderkey, round(o_totalprice / (CAST(o_custkey AS DOUBLE) + 1e-6), 3) AS ratio FROM orders""")
def p12(t: Tables) -> DataFrame:
    return t("orders").select("o_orderkey", F.round(S.safe_ratio("o_totalprice", "o_custkey"), 3).alias("ratio"))


@query("p13_atrophy", """
SELECT o_orderkey, round(CASE WHEN o_orderstatus <> 'P' THEN greatest(0.0, (3500.0 - o_totalprice / 100) / 3500.0) END, 9)
           AS hippocampal_atrophy FROM orders""")
def p13(t: Tables) -> DataFrame:
    volume = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 100)
    return t("orders").select("o_orderkey", F.round(S.atrophy(volume), 9).alias("hippocampal_atrophy"))


@query("p14_content_hash", "SELECT doc_id, md5(text) AS content_hash FROM documents")
def p14(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", S.content_hash("text").alias("content_hash"))


@query("p15_duration_text", """
SELECT event_id, CASE WHEN s < 60 THEN printf('%.2f', s) || 's' WHEN s < 3600 THEN printf('%.2f', s / 60) || 'm'
                      ELSE printf('%.2f', s / 3600) || 'h' END AS duration
FROM (SELECT event_id, value * 15 AS s FROM events)""")
def p15(t: Tables) -> DataFrame:
    return t("events").select("event_id", S.duration_text(F.col("value") * 15).alias("duration"))


@query("p16_timestamp_text", """
SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso
FROM events WHERE microsecond(ts) % 1000000 <> 0
UNION ALL
SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S'), strftime(ts, '%Y-%m-%dT%H:%M:%S')
FROM events WHERE microsecond(ts) % 1000000 = 0""")
def p16(t: Tables) -> DataFrame:
    return t("events").select("event_id", S.stamp_text("ts").alias("stamp"), S.iso_text("ts").alias("iso"))


@query("p17_json_value", """
SELECT event_id, CAST(to_json({'event_id': event_id, 'event_type': event_type, 'value': value,
                               'user_id': nullif(user_id, 3)}) AS VARCHAR) AS json FROM events""")
def p17(t: Tables) -> DataFrame:
    user = F.nullif("user_id", F.lit(3).cast("bigint")).alias("user_id")
    return t("events").select("event_id", S.json_value("event_id", "event_type", "value", user).alias("json"))


def _narrow_sql(table: str, ints: list[str], doubles: list[str]) -> str:
    parts = [
        f"""SELECT '{c}' AS "column", CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint'
            WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint'
            WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END AS type,
            count({c}) AS non_null FROM {table}""" for c in ints
    ] + [
        f"""SELECT '{c}', CASE WHEN min({c}) > -65504.0 AND max({c}) < 65504.0 THEN 'float' ELSE 'double' END,
            count({c}) FROM {table}""" for c in doubles
    ]
    return " UNION ALL ".join(parts)


@query("p18_narrow_types", _narrow_sql(
    "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def p18(t: Tables) -> DataFrame:
    numeric = features.select_numeric(t("lineitem"))
    return aggregate.profile(features.narrow_types(numeric)).select("column", "type", "non_null")


@query("p19_numeric_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def p19(t: Tables) -> DataFrame:
    return features.select_numeric(t("orders").withColumn("flag", F.lit(True)))


@query("p20_feature_target", """
SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber FROM lineitem""")
def p20(t: Tables) -> DataFrame:
    return features.feature_target(t("lineitem"), "l_linenumber", ["l_orderkey", "l_partkey", "l_suppkey"])[0]


@query("p21_padded_vector", """
SELECT l_orderkey, l_linenumber, CAST(26 AS INTEGER) AS width, l_quantity + l_extendedprice + l_discount + l_tax AS total,
       l_tax AS fourth, 0.0::DOUBLE AS last FROM lineitem""")
def p21(t: Tables) -> DataFrame:
    vector = S.padded_features(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 22)
    df = t("lineitem").select("l_orderkey", "l_linenumber", vector.alias("v"))
    return df.select(
        "l_orderkey", "l_linenumber", F.size("v").alias("width"),
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.element_at("v", 4).alias("fourth"), F.element_at("v", -1).alias("last"))


def _shares(t: Tables) -> DataFrame:
    """Per part, the shares of the return flags A, N, R."""
    counts = aggregate.pivot_counts(t("lineitem"), "l_partkey", "l_returnflag", ["A", "N", "R"])
    total = F.col("n_A") + F.col("n_N") + F.col("n_R")
    return counts.select("l_partkey", F.array(*[F.col(c) / total for c in ("n_A", "n_N", "n_R")]).alias("p"))


SHARES_SQL = """shares AS (
  SELECT l_partkey, (count(*) FILTER (l_returnflag = 'A')) / CAST(count(*) AS DOUBLE) AS a,
         (count(*) FILTER (l_returnflag = 'N')) / CAST(count(*) AS DOUBLE) AS n,
         (count(*) FILTER (l_returnflag = 'R')) / CAST(count(*) AS DOUBLE) AS r
  FROM lineitem GROUP BY l_partkey)"""


@query("p22_entropy_confidence", f"""
WITH {SHARES_SQL}
SELECT l_partkey, round(1 + (a * ln(a + 1e-10) + n * ln(n + 1e-10) + r * ln(r + 1e-10)) / ln(3.0), 9) AS confidence
FROM shares""")
def p22(t: Tables) -> DataFrame:
    return _shares(t).select("l_partkey", F.round(S.entropy_confidence("p"), 9).alias("confidence"))


@query("p23_rank_alternatives", f"""
WITH {SHARES_SQL},
long AS (SELECT l_partkey, 'levetiracetam' AS name, 0 AS c, a AS p FROM shares
         UNION ALL SELECT l_partkey, 'lamotrigine', 1, n FROM shares
         UNION ALL SELECT l_partkey, 'oxcarbazepine', 2, r FROM shares),
ranked AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY p DESC, c) AS k FROM long)
SELECT l_partkey, max(name) FILTER (k = 1) AS predicted_treatment, max(p) FILTER (k = 1) AS response_probability,
       max(name) FILTER (k = 2) AS second, max(p) FILTER (k = 2) AS second_p,
       max(name) FILTER (k = 3) AS third, max(p) FILTER (k = 3) AS third_p
FROM ranked GROUP BY l_partkey""")
def p23(t: Tables) -> DataFrame:
    from cohortry.schemas import TREATMENT_LABELS

    ranked = _shares(t).select("l_partkey", *[
        c.alias(n) for n, c in S.rank_alternatives("p", TREATMENT_LABELS).items()])
    second, third = (F.element_at("alternative_treatments", i) for i in (1, 2))
    return ranked.select(
        "l_partkey", "predicted_treatment", "response_probability",
        second["treatment"].alias("second"), second["probability"].alias("second_p"),
        third["treatment"].alias("third"), third["probability"].alias("third_p"))


@query("p24_label_lookup", """
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'levetiracetam' WHEN 1 THEN 'lamotrigine'
           WHEN 2 THEN 'oxcarbazepine' END AS label FROM lineitem""")
def p24(t: Tables) -> DataFrame:
    from cohortry.schemas import TREATMENT_LABELS

    label = S.label_of(F.col("l_linenumber") % 4, TREATMENT_LABELS)
    return t("lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))


@query("p25_search_text", """
SELECT o_orderkey, 'epilepsy ' || o_orderpriority
       || CASE WHEN o_custkey % 2 = 0 THEN ' ' || o_orderstatus || ' B C' ELSE '' END
       || CASE WHEN o_custkey % 3 = 0 THEN ' treatment resistance' ELSE '' END
       || ' treatment guidelines recommendations' AS search_text FROM orders""")
def p25(t: Tables) -> DataFrame:
    genes = F.when(F.col("o_custkey") % 2 == 0, F.array(F.col("o_orderstatus"), F.lit("B"), F.lit("C"), F.lit("D")))
    treatments = F.when(F.col("o_custkey") % 3 == 0, F.array().cast("array<string>"))
    return t("orders").select("o_orderkey", X.search_text("o_orderpriority", genes, treatments).alias("search_text"))


def _prompt_sql() -> str:
    text = X.PROMPT_TEMPLATE.replace("'", "''")
    fills = {
        "context": "'Fonte 1: ' || text || chr(10) || chr(10) || 'Fonte 2: ' || source",
        "seizure_type": "lang",
        "seizure_frequency": "coalesce(CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) END, 'não especificada')",
        "genotype": "CASE WHEN doc_id % 3 = 0 THEN source || ', ' || lang ELSE 'não disponível' END",
        "previous_treatments": "CASE WHEN doc_id % 5 = 0 THEN 'nenhum' ELSE lang END",
        "treatment_response": "'não disponível'",
        "question": "'Qual o melhor tratamento para este paciente?'",
    }
    sql = f"'{text}'"
    for name, expression in fills.items():
        sql = sql.replace("{" + name + "}", f"' || {expression} || '")
    return f"SELECT doc_id, md5({sql}) AS prompt_md5, CAST(length({sql}) AS INTEGER) AS prompt_chars FROM documents"


@query("p26_prompt", _prompt_sql())
def p26(t: Tables) -> DataFrame:
    d = t("documents").select(
        "doc_id",
        X.context_text(F.array("text", "source")).alias("context"),
        F.col("lang").alias("seizure_type"),
        F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("seizure_frequency"),
        F.when(F.col("doc_id") % 3 == 0, F.array("source", "lang")).alias("genes"),
        F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("lang"))
        .alias("previous_treatments"),
    )
    prompt = build_prompts(d)
    return prompt.select("doc_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_chars"))


@query("p27_report", """
SELECT doc_id, md5(chr(10) || 'Recomendação de Tratamento' || chr(10) || '==========================' || chr(10)
    || chr(10) || lang || chr(10) || chr(10) || 'Confiança: ' || printf('%.2f', 100 * (doc_id % 1000 / 1000.0::DOUBLE)) || '%'
    || chr(10) || chr(10) || 'Fontes Consultadas:' || chr(10) || '-------------------' || chr(10)
    || chr(10) || '1. ' || coalesce(nullif(source, 'src1'), 'Desconhecida') || chr(10) || '   PMID: N/A'
    || chr(10) || '   Excerto: ' || left(text, 200) || '...' || chr(10)) AS report_md5 FROM documents""")
def p27(t: Tables) -> DataFrame:
    sources = F.array(F.struct(
        F.nullif("source", F.lit("src1")).alias("source"), F.lit(None).cast("string").alias("pmid"),
        F.col("text").alias("content")))
    confidence = (F.col("doc_id") % 1000) / F.lit(1000.0)
    return t("documents").select("doc_id", F.md5(X.report_text("lang", confidence, sources)).alias("report_md5"))


@query("p28_explode_list", f"""
SELECT p_partkey, trim(unnest(string_split(s, ' '))) AS treatment_name FROM {NAMES_SQL} WHERE coalesce(s, '') <> ''""")
def p28(t: Tables) -> DataFrame:
    return explode_treatments(_names(t), sep=" ").drop("previous_treatments")


@query("e1_label_codes", """
SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment_encoded FROM customer""")
def e1(t: Tables) -> DataFrame:
    return encode.label_encode(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").drop("c_mktsegment")


@query("e2_fitted_codes", """
WITH codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code
               FROM (SELECT DISTINCT coalesce(CAST(nullif(s_nationkey, 7) AS VARCHAR), 'nan') AS v FROM supplier))
SELECT c_custkey, code AS nation_encoded FROM customer LEFT JOIN codes
  ON v = coalesce(CAST(nullif(c_nationkey, 7) AS VARCHAR), 'nan')""")
def e2(t: Tables) -> DataFrame:
    seven = F.lit(7)
    fitted = encode.LabelEncoder.fit(t("supplier").select(F.nullif("s_nationkey", seven).alias("nation")), "nation")
    customers = t("customer").select("c_custkey", F.nullif("c_nationkey", seven).alias("nation"))
    return fitted.transform(customers, "keep").drop("nation")


def _scaled_sql(expression: str) -> str:
    columns = ["l_quantity", "l_extendedprice", "l_discount"]
    parts = ", ".join(f"round({expression.format(c=c)}, 7) AS {c}_scaled" for c in columns)
    return f"SELECT l_orderkey, l_linenumber, {parts} FROM lineitem"


def _rounded(df: DataFrame) -> DataFrame:
    scaled = [c for c in df.columns if c.endswith("_scaled")]
    return df.select("l_orderkey", "l_linenumber", *[F.round(c, 7).alias(c) for c in scaled])


SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


@query("e3_standard_scale", _scaled_sql("({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()"))
def e3(t: Tables) -> DataFrame:
    return _rounded(encode.standard_scale(t("lineitem"), SCALED))


@query("e4_zscore", _scaled_sql("({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()"))
def e4(t: Tables) -> DataFrame:
    return _rounded(encode.zscore(t("lineitem"), SCALED, "_scaled"))


@query("e5_minmax_scale", _scaled_sql("({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())"))
def e5(t: Tables) -> DataFrame:
    return _rounded(encode.minmax_scale(t("lineitem"), SCALED, "_scaled"))


@query("e6_pca")
def e6(t: Tables) -> DataFrame:
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return encode.pca(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2)


@query("e6_pca_two_columns", """
WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_tax) AS my, var_samp(l_quantity) AS vx, var_samp(l_tax * 100) AS vy,
                  covar_samp(l_quantity, l_tax * 100) AS c FROM lineitem),
a AS (SELECT *, 0.5 * atan2(2 * c, vx - vy) AS t FROM m),
w AS (SELECT mx, my, CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN sign(cos(t)) ELSE sign(sin(t)) END AS s1,
             CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN sign(cos(t)) ELSE sign(-sin(t)) END AS s2,
             cos(t) AS u, sin(t) AS v FROM a)
SELECT l_orderkey, l_linenumber, round(s1 * (u * (l_quantity - mx) + v * (l_tax * 100 - my * 100)), 6) AS pca_0,
       round(s2 * (-v * (l_quantity - mx) + u * (l_tax * 100 - my * 100)), 6) AS pca_1 FROM lineitem, w""")
def e6_two(t: Tables) -> DataFrame:
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_tax") * 100).alias("tax"))
    out = encode.pca(df, ["l_quantity", "tax"], 2)
    return out.select("l_orderkey", "l_linenumber", F.round("pca_0", 6).alias("pca_0"), F.round("pca_1", 6).alias("pca_1"))


def _dummy_sql(prefix: str, value: str, edges: list[int], labels: list[str]) -> str:
    return ", ".join(
        f"{value} > {lo} AND {value} <= {hi} AS {prefix}_{label}"
        for lo, hi, label in zip(edges, edges[1:], labels)
    )


@query("e7_feature_table", f"""
WITH {CLINICAL_SQL}, {GENETIC_SQL},
agg AS (SELECT patient_id, count(gene) AS n_variants, count(DISTINCT gene) AS n_unique_genes,
    max(CASE WHEN contains(lower(clinvar_significance), 'pathogenic') THEN 1 ELSE 0 END) AS has_pathogenic_variant,
    max(CASE WHEN gene IN ('SCN1A', 'KCNQ2', 'CDKL5') THEN 1 ELSE 0 END) AS has_epilepsy_gene,
    count(*) FILTER (variant_type = 'missense') AS n_missense, count(*) FILTER (variant_type = 'nonsense') AS n_nonsense,
    count(*) FILTER (variant_type = 'frameshift') AS n_frameshift,
    count(*) FILTER (variant_type = 'splice_site') AS n_splice_site FROM genetic GROUP BY patient_id),
d AS (SELECT *, age - age_at_onset AS years_since_onset,
    CASE WHEN coalesce(previous_treatments, '') = '' THEN 0 ELSE len(string_split(previous_treatments, ';')) END AS n
    FROM clinical)
SELECT patient_id, years_since_onset, round(seizure_frequency_per_month * epilepsy_duration_years * 12, 4) AS seizure_burden,
  {_dummy_sql("age", "age", AGE_EDGES, AGE_LABELS)}, {_dummy_sql("onset", "age_at_onset", ONSET_EDGES, ONSET_LABELS)},
  CAST(n AS INTEGER) AS n_previous_treatments, CASE WHEN n > 0 THEN 1 ELSE 0 END AS has_previous_treatment,
  CASE WHEN contains(lower(previous_treatments), 'levetiracetam') THEN 1 ELSE 0 END AS prev_levetiracetam,
  CASE WHEN contains(lower(previous_treatments), 'lamotrigine') THEN 1 ELSE 0 END AS prev_lamotrigine,
  least(n / 5.0, 1.0) AS treatment_resistance_score,
  coalesce(n_variants, 0) AS n_variants, coalesce(n_unique_genes, 0) AS n_unique_genes,
  coalesce(has_pathogenic_variant, 0) AS has_pathogenic_variant, coalesce(has_epilepsy_gene, 0) AS has_epilepsy_gene,
  coalesce(n_missense, 0) AS n_missense, coalesce(n_splice_site, 0) AS n_splice_site,
  round(age * seizure_frequency_per_month, 4) AS age_x_seizure_frequency_per_month,
  round(age / (n + 1e-6), 2) AS age_div_n_previous_treatments,
  dense_rank() OVER (ORDER BY sex) - 1 AS sex_encoded, dense_rank() OVER (ORDER BY seizure_type) - 1 AS seizure_type_encoded,
  round((age - avg(age) OVER ()) / stddev_pop(age) OVER (), 7) AS age_norm,
  round((years_since_onset - avg(years_since_onset) OVER ()) / stddev_pop(years_since_onset) OVER (), 7)
      AS years_since_onset_norm
FROM d LEFT JOIN agg USING (patient_id)""")
def e7(t: Tables) -> DataFrame:
    out = features.FeaturePipeline().fit_transform(clinical(t), genetic(t))
    bands = [f"age_{x}" for x in AGE_LABELS] + [f"onset_{x}" for x in ONSET_LABELS]
    rounded = {
        "seizure_burden": 4, "age_x_seizure_frequency_per_month": 4, "age_div_n_previous_treatments": 2,
        "age_norm": 7, "years_since_onset_norm": 7,
    }
    return out.select(
        "patient_id", "years_since_onset", *bands, "n_previous_treatments", "has_previous_treatment",
        "prev_levetiracetam", "prev_lamotrigine", "treatment_resistance_score", "n_variants", "n_unique_genes",
        "has_pathogenic_variant", "has_epilepsy_gene", "n_missense", "n_splice_site", "sex_encoded",
        "seizure_type_encoded", *[F.round(c, d).alias(c) for c, d in rounded.items()])
