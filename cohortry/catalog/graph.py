"""Graph queries: customers, parts and suppliers as nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.catalog.registry import Tables, query
from cohortry.operators import attention as A
from cohortry.operators import graph as G
from cohortry.plans.session import cut_lineage


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _lines(t: Tables) -> DataFrame:
    orders = t("orders").select("o_orderkey", "o_custkey")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


def _typed(df: DataFrame, src, dst, kind: str) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))


def _traits(t: Tables) -> DataFrame:
    """customer -HAS_VARIANT-> part and customer -HAS_PHENOTYPE-> supplier."""
    lines = _lines(t)  # repeats are found among numbers, before they are spelt out
    pairs = lambda key: lines.select("o_custkey", key).distinct()
    variants = _typed(pairs("l_partkey"), _id("c", "o_custkey"), _id("p", "l_partkey"), "HAS_VARIANT")
    phenotypes = _typed(pairs("l_suppkey"), _id("c", "o_custkey"), _id("s", "l_suppkey"), "HAS_PHENOTYPE")
    return variants.unionByName(phenotypes)


TRAITS_SQL = """lines AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, 'HAS_VARIANT' AS type FROM lines
          UNION SELECT DISTINCT 'c' || o_custkey, 's' || l_suppkey, 'HAS_PHENOTYPE' FROM lines)"""


def _nodes(t: Tables) -> DataFrame:
    parts = [("customer", "c", "c_custkey", "Patient"), ("part", "p", "p_partkey", "Variant"),
             ("supplier", "s", "s_suppkey", "Phenotype")]
    out = None
    for table, prefix, key, kind in parts:
        one = t(table).select(_id(prefix, key).alias("id"), F.lit(kind).alias("type"))
        out = one if out is None else out.unionByName(one)
    return out


NODES_SQL = """nodes AS (SELECT 'c' || c_custkey AS id, 'Patient' AS type FROM customer
           UNION ALL SELECT 'p' || p_partkey, 'Variant' FROM part
           UNION ALL SELECT 's' || s_suppkey, 'Phenotype' FROM supplier)"""


def _orders_graph(t: Tables) -> DataFrame:
    """customer -TREATED_WITH-> order -TARGETS-> part."""
    placed = _typed(t("orders"), _id("c", "o_custkey"), _id("o", "o_orderkey"), "TREATED_WITH")
    holds = _typed(t("lineitem"), _id("o", "l_orderkey"), _id("p", "l_partkey"), "TARGETS")
    return placed.unionByName(holds.distinct())


ORDERS_GRAPH_SQL = """edges AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'TREATED_WITH' AS type FROM orders
          UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'TARGETS' FROM lineitem)"""


@query("g1_merge_nodes", """
WITH every AS (
  SELECT 'c' || c_custkey AS id, 'segment' AS key, c_mktsegment AS value, -1 AS seq FROM customer
  UNION ALL SELECT 'c' || c_custkey, 'status', 'new', -1 FROM customer
  UNION ALL SELECT 'c' || o_custkey, 'status', nullif(o_orderstatus, 'P'), o_orderkey FROM orders
  UNION ALL SELECT 'c' || o_custkey, 'priority', o_orderpriority, o_orderkey FROM orders)
SELECT id, 'Patient' AS type, key, value FROM (
  SELECT *, row_number() OVER (PARTITION BY id, key ORDER BY seq DESC) AS rn FROM every) WHERE rn = 1 AND value IS NOT NULL""")
def g1(t: Tables) -> DataFrame:
    nodes = t("customer").select(
        _id("c", "c_custkey").alias("id"), F.lit("Patient").alias("type"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("status"), F.lit("new")).alias("props"))
    updates = t("orders").select(
        _id("c", "o_custkey").alias("id"), F.lit("Patient").alias("type"),
        F.create_map(F.lit("status"), F.nullif("o_orderstatus", F.lit("P")), F.lit("priority"),
                     F.col("o_orderpriority")).alias("props"),
        F.col("o_orderkey").alias("seq"))
    return G.merge_nodes(nodes, updates).select("id", "type", F.explode("props").alias("key", "value"))


@query("g2_merge_edges", """
WITH every AS (
  SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, key, value, l_orderkey * 100 + l_linenumber AS seq
  FROM (SELECT *, 'flag' AS key, l_returnflag AS value FROM lineitem UNION ALL
        SELECT *, 'status', l_linestatus FROM lineitem)
  WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25))
SELECT src, 'INTERACTS_WITH' AS type, dst, key, value FROM (
  SELECT *, row_number() OVER (PARTITION BY src, dst, key ORDER BY seq DESC, value DESC) AS rn FROM every) WHERE rn = 1""")
def g2(t: Tables) -> DataFrame:
    parts = t("part").filter("p_size > 25").select(_id("p", "p_partkey").alias("id"))
    nodes = parts.unionByName(t("supplier").select(_id("s", "s_suppkey").alias("id")))
    updates = t("lineitem").select(
        _id("p", "l_partkey").alias("src"), _id("s", "l_suppkey").alias("dst"), F.lit("INTERACTS_WITH").alias("type"),
        F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus")).alias("props"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    none = updates.drop("seq").limit(0)
    merged = G.merge_edges(none, updates, nodes)
    return merged.select("src", "type", "dst", F.explode("props").alias("key", "value"))


@query("g2_merge_into_existing", """
WITH every AS (
  SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, key, value, l_linenumber > 2 AS later, l_orderkey * 100 + l_linenumber AS seq
  FROM (SELECT *, 'flag' AS key, l_returnflag AS value FROM lineitem UNION ALL
        SELECT *, CASE WHEN l_linenumber > 2 THEN 'status' ELSE 'first' END, l_linestatus FROM lineitem)
  WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25))
SELECT src, 'INTERACTS_WITH' AS type, dst, key, value FROM (
  SELECT *, row_number() OVER (PARTITION BY src, dst, key ORDER BY later DESC, seq DESC, value DESC) AS rn FROM every) WHERE rn = 1""")
def g2_existing(t: Tables) -> DataFrame:
    parts = t("part").filter("p_size > 25").select(_id("p", "p_partkey").alias("id"))
    nodes = parts.unionByName(t("supplier").select(_id("s", "s_suppkey").alias("id")))
    later = F.col("l_linenumber") > 2

    def updates(which) -> DataFrame:
        status = F.when(later, F.lit("status")).otherwise(F.lit("first"))
        return t("lineitem").filter(which).select(
            _id("p", "l_partkey").alias("src"), _id("s", "l_suppkey").alias("dst"), F.lit("INTERACTS_WITH").alias("type"),
            F.create_map(F.lit("flag"), F.col("l_returnflag"), status, F.col("l_linestatus")).alias("props"),
            (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))

    old = G.merge_edges(updates(later).drop("seq").limit(0), updates(~later), nodes)
    merged = G.merge_edges(old, updates(later), nodes)
    return merged.select("src", "type", "dst", F.explode("props").alias("key", "value"))


@query("g3_graph_constraints", """
SELECT 'Gene' AS type, 'symbol' AS property, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand HAVING count(*) > 1
UNION ALL
SELECT 'Drug', 'name', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment HAVING count(*) > 1""")
def g3(t: Tables) -> DataFrame:
    genes = t("part").select(_id("p", "p_partkey").alias("id"), F.lit("Gene").alias("type"),
                             F.create_map(F.lit("symbol"), F.col("p_brand")).alias("props"))
    drugs = t("customer").select(_id("c", "c_custkey").alias("id"), F.lit("Drug").alias("type"),
                                 F.create_map(F.lit("name"), F.col("c_mktsegment")).alias("props"))
    patients = t("supplier").select(_id("s", "s_suppkey").alias("id"), F.lit("Patient").alias("type"),
                                    F.create_map(F.lit("name"), F.lit("x")).alias("props"))
    return G.check_graph_constraints(genes.unionByName(drugs).unionByName(patients))


HOPS_SQL = f"""WITH RECURSIVE {ORDERS_GRAPH_SQL},
both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
walk AS (SELECT 'c1' AS id, 0 AS d UNION SELECT b, d + 1 FROM walk JOIN both_ways ON a = id WHERE d < 3),
reached AS (SELECT id, min(d) AS d FROM walk GROUP BY id)"""


@query("g4_k_hop_edges", f"""{HOPS_SQL}
SELECT DISTINCT src, dst, type FROM edges
WHERE src IN (SELECT id FROM reached WHERE d <= 2) OR dst IN (SELECT id FROM reached WHERE d <= 2)""")
def g4_edges(t: Tables) -> DataFrame:
    edges = cut_lineage(_orders_graph(t))  # every hop reads the edges
    nodes = t("customer").select(_id("c", "c_custkey").alias("id"))
    return G.k_hop_subgraph(nodes, edges, "c1", 3)[1]


@query("g4_k_hop_nodes", f"{HOPS_SQL} SELECT id, d AS distance FROM reached")
def g4_nodes(t: Tables) -> DataFrame:
    return G.hop_distances(cut_lineage(_orders_graph(t)), "c1", 3)


@query("g5_similar_by_graph", f"""
WITH {TRAITS_SQL},
v AS (SELECT src, count(*) AS n FROM edges WHERE type = 'HAS_VARIANT' AND src <> 'c1'
      AND dst IN (SELECT dst FROM edges WHERE src = 'c1' AND type = 'HAS_VARIANT') GROUP BY src),
p AS (SELECT src, count(*) AS n FROM edges WHERE type = 'HAS_PHENOTYPE' AND src <> 'c1'
      AND dst IN (SELECT dst FROM edges WHERE src = 'c1' AND type = 'HAS_PHENOTYPE') GROUP BY src)
SELECT v.src AS similar_patient, v.n * 2.0::DOUBLE + p.n AS similarity_score FROM v JOIN p ON v.src = p.src
ORDER BY similarity_score DESC, similar_patient LIMIT 10""")
def g5(t: Tables) -> DataFrame:
    return G.similar_by_graph(_traits(t), "c1", 10)


@query("g6_drug_targets", """
WITH enc AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem),
hits AS (SELECT c_mktsegment, c_nationkey, p_brand FROM enc
         JOIN part ON l_partkey = p_partkey AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')
         JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT c_mktsegment AS drug, 'm' || c_nationkey AS mechanism, CASE WHEN c_nationkey % 2 = 0 THEN 'approved' END AS status,
       count(*) AS n_paths, md5(string_agg(p_brand, ',' ORDER BY p_brand)) AS genes_md5
FROM hits GROUP BY ALL""")
def g6(t: Tables) -> DataFrame:
    encodes = _typed(t("lineitem"), _id("p", "l_partkey"), _id("o", "l_orderkey"), "ENCODES")
    targets = _typed(t("orders"), _id("c", "o_custkey"), _id("o", "o_orderkey"), "TARGETS")
    genes = t("part").select(_id("p", "p_partkey").alias("id"), F.col("p_brand").alias("symbol"))
    drugs = t("customer").select(
        _id("c", "c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), _id("m", "c_nationkey").alias("mechanism"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("approved")).alias("approval_status"))
    out = G.drug_targets(encodes.unionByName(targets), genes, drugs, ["Brand#1", "Brand#2", "Brand#3"])
    return out.select("drug", "mechanism", "status", F.size("targeted_genes").cast("bigint").alias("n_paths"),
                      F.md5(F.array_join("targeted_genes", ",")).alias("genes_md5"))


@query("g6_drug_target_runs", """
WITH enc AS (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)
SELECT c_mktsegment AS drug, 'm' || c_nationkey AS mechanism, CASE WHEN c_nationkey % 2 = 0 THEN 'approved' END AS status,
       p_brand AS gene, count(*) AS n
FROM enc JOIN part ON l_partkey = p_partkey AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')
JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def g6_runs(t: Tables) -> DataFrame:
    encodes = _typed(t("lineitem"), _id("p", "l_partkey"), _id("o", "l_orderkey"), "ENCODES")
    targets = _typed(t("orders"), _id("c", "o_custkey"), _id("o", "o_orderkey"), "TARGETS")
    genes = t("part").select(_id("p", "p_partkey").alias("id"), F.col("p_brand").alias("symbol"))
    drugs = t("customer").select(
        _id("c", "c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), _id("m", "c_nationkey").alias("mechanism"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("approved")).alias("approval_status"))
    return G.drug_target_runs(encodes.unionByName(targets), genes, drugs, ["Brand#1", "Brand#2", "Brand#3"])


@query("g7_degree_centrality", f"""
WITH {TRAITS_SQL}, {NODES_SQL},
ends AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst)
SELECT n.id AS node_id, CAST(count(e.id) AS DOUBLE) AS degree FROM nodes n LEFT JOIN ends e ON n.id = e.id
WHERE n.type = 'Variant' GROUP BY n.id""")
def g7(t: Tables) -> DataFrame:
    return G.degree_centrality(_nodes(t), _traits(t), "Variant")


@query("g8_node_index", f"WITH {NODES_SQL} SELECT id, row_number() OVER (ORDER BY id) - 1 AS node_index FROM nodes")
def g8(t: Tables) -> DataFrame:
    return G.index_graph(_nodes(t), _traits(t))[0]


@query("g8_edge_index", f"""
WITH {TRAITS_SQL}, {NODES_SQL}, ix AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM nodes)
SELECT a.i AS src_index, b.i AS dst_index FROM edges JOIN ix a ON src = a.id JOIN ix b ON dst = b.id""")
def g8_edges(t: Tables) -> DataFrame:
    return G.index_graph(_nodes(t), _traits(t))[1]


@query("g8_index_of_patients", f"""
WITH {TRAITS_SQL}, {NODES_SQL}, kept AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 5000),
sub AS (SELECT id FROM nodes WHERE type = 'Patient' AND id IN (SELECT id FROM kept)
        UNION SELECT id FROM nodes WHERE type <> 'Patient'
              AND id IN (SELECT dst FROM edges WHERE src IN (SELECT id FROM kept)))
SELECT id, row_number() OVER (ORDER BY id) - 1 AS node_index FROM sub""")
def g8_patients(t: Tables) -> DataFrame:
    kept = t("customer").filter("c_acctbal > 5000").select(_id("c", "c_custkey").alias("id"))
    return G.index_graph(_nodes(t), _traits(t), kept)[0]


@query("g9_node_features", f"""
WITH {NODES_SQL}
SELECT id, CAST(128 AS INTEGER) AS width, 1.0::DOUBLE AS total,
       CAST(CASE type WHEN 'Patient' THEN 1 WHEN 'Variant' THEN 4 ELSE 5 END AS BIGINT) AS hot FROM nodes""")
def g9(t: Tables) -> DataFrame:
    f = G.node_features(_nodes(t))
    return f.select("id", F.size("features").alias("width"),
                    F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total"),
                    F.array_position("features", F.lit(1.0)).alias("hot"))


@query("g10_propagate_features", f"""
WITH {TRAITS_SQL}, {NODES_SQL},
f AS (SELECT id, CAST(type = 'Patient' AS INTEGER) AS f0, CAST(type = 'Variant' AS INTEGER) AS f1, length(id) AS f2 FROM nodes),
links AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
pool AS (SELECT id, f0, f1, f2 FROM f UNION ALL SELECT b, f0, f1, f2 FROM links JOIN f ON a = f.id)
SELECT id, round(avg(f0), 9) AS f0, round(avg(f1), 9) AS f1, round(avg(f2), 9) AS f2 FROM pool GROUP BY id""")
def g10(t: Tables) -> DataFrame:
    start = _nodes(t).select("id", F.array(
        (F.col("type") == "Patient").cast("double"), (F.col("type") == "Variant").cast("double"),
        F.length("id").cast("double")).alias("features"))
    out = G.propagate_features(start, _traits(t), 1)
    return out.select("id", *[F.round(F.element_at("features", i + 1), 9).alias(f"f{i}") for i in range(3)])


@query("g10_two_hops_wide", f"""
WITH {TRAITS_SQL}, {NODES_SQL},
f AS (SELECT id, CAST(type = 'Patient' AS INTEGER) AS f0, CAST(type = 'Variant' AS INTEGER) AS f3, CAST(type = 'Phenotype' AS INTEGER) AS f4
      FROM nodes),
links AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
one AS (SELECT id, avg(f0) AS f0, avg(f3) AS f3, avg(f4) AS f4 FROM (
          SELECT id, f0, f3, f4 FROM f UNION ALL SELECT b, f0, f3, f4 FROM links JOIN f ON a = f.id) GROUP BY id)
SELECT id, round(avg(f0), 9) AS f0, round(avg(f3), 9) AS f3, round(avg(f4), 9) AS f4, CAST(128 AS INTEGER) AS width FROM (
  SELECT id, f0, f3, f4 FROM one UNION ALL SELECT b, f0, f3, f4 FROM links JOIN one ON a = one.id) GROUP BY id""")
def g10_wide(t: Tables) -> DataFrame:
    out = G.propagate_features(G.node_features(_nodes(t)), _traits(t), 2)
    return out.select("id", *[F.round(F.element_at("features", i + 1), 9).alias(f"f{i}") for i in (0, 3, 4)],
                      F.size("features").alias("width"))


# Two heads over three inputs with two outputs each: any fixed weights do, the SQL is made from the same ones.
HEADS = A.Layer([[[0.3, -0.2], [0.5, 0.1], [0.05, 0.02]], [[-0.4, 0.6], [0.2, 0.3], [-0.03, 0.04]]],
                [[0.7, -0.5], [0.4, 0.9]], [[0.2, 0.3], [-0.6, 0.1]], True, [0.1, 0.0, -0.1, 0.2])


def _dot(values, names) -> str:
    return " + ".join(f"({v!r}::DOUBLE) * {n}" for v, n in zip(values, names))


def _head_sql(h: int) -> str:
    w, a, b = HEADS.weight[h].tolist(), HEADS.source[h].tolist(), HEADS.target[h].tolist()
    z = ", ".join(f"{_dot([row[k] for row in w], ('f0', 'f1', 'f2'))} AS z{k}" for k in range(2))
    bias = HEADS.bias[2 * h:2 * h + 2]
    out = ", ".join(f"round(sum(exp(e - high) * z{k}) / sum(exp(e - high)) + ({bias[k]!r}), 9) AS f{2 * h + k}" for k in range(2))
    return f"""
z{h} AS (SELECT *, {_dot(a, ('z0', 'z1'))} AS s, {_dot(b, ('z0', 'z1'))} AS t FROM (SELECT id, {z} FROM f)),
e{h} AS (SELECT l.dst, x.z0, x.z1, CASE WHEN x.s + y.t < 0 THEN 0.2 * (x.s + y.t) ELSE x.s + y.t END AS e
         FROM links l JOIN z{h} x ON l.src = x.id JOIN z{h} y ON l.dst = y.id),
h{h} AS (SELECT dst AS id, {out} FROM (SELECT *, max(e) OVER (PARTITION BY dst) AS high FROM e{h}) GROUP BY dst)"""


@query("g10_attention_two_heads", f"""
WITH {TRAITS_SQL}, {NODES_SQL},
f AS (SELECT id, CAST(type = 'Patient' AS DOUBLE) AS f0, CAST(type = 'Variant' AS DOUBLE) AS f1, CAST(length(id) AS DOUBLE) AS f2 FROM nodes),
links AS (SELECT src, dst FROM edges WHERE src <> dst UNION ALL SELECT id, id FROM nodes),{_head_sql(0)},{_head_sql(1)}
SELECT h0.id, f0, f1, f2, f3 FROM h0 JOIN h1 ON h0.id = h1.id""")
def g10_attention(t: Tables) -> DataFrame:
    start = _nodes(t).select("id", F.array(
        (F.col("type") == "Patient").cast("double"), (F.col("type") == "Variant").cast("double"),
        F.length("id").cast("double")).alias("features"))
    out = A.attend(start, _traits(t), HEADS)
    return out.select("id", *[F.round(F.element_at("features", i + 1), 9).alias(f"f{i}") for i in range(4)])
