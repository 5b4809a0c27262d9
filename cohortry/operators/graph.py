"""Property-graph operators over nodes(id, type, props) and edges(src, dst, type, props)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry import schemas
from cohortry.operators.join import endpoints_exist
from cohortry.plans.ordered import dense_index
from cohortry.plans.partitions import rewrite_touched
from cohortry.plans.session import cut_lineage

# ---------------------------------------------------------------------------
# The property that must be unique per node type.
# ---------------------------------------------------------------------------
UNIQUE_PROPERTIES = {"Patient": "id", "Gene": "symbol", "Drug": "name"}
FEATURE_WIDTH = 128
# ---------------------------------------------------------------------------


def _fold(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key with its merged property map; a null value removes the property.

    One row per property, the last one kept with a partial aggregate per (key,
    property), and only then the map: its size is the number of distinct
    property names, however many updates a key has. A key without properties
    stays as one row with a null name.
    """
    keys = list(keys)
    before = old.select(*keys, "props", F.lit(-1).cast("bigint").alias("__seq"))
    after = new.select(*keys, "props", F.col(order).cast("bigint").alias("__seq"))
    rows = before.unionByName(after).select(*keys, "__seq", F.explode_outer("props").alias("key", "value"))
    newest = F.struct("__seq", F.col("value").isNull(), "value")
    last = rows.groupBy(*keys, "key").agg(F.max_by(F.struct("value"), newest).alias("last"))
    listed = last.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("key", F.col("last.value").alias("value")))).alias("entries")
    )
    present = F.filter("entries", lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    return listed.select(*keys, F.map_from_entries(present).alias("props"))


def merge_nodes(nodes: DataFrame, updates: DataFrame, order: str = "seq") -> DataFrame:
    """Upsert by (type, id): property maps are merged, the later update wins."""
    return _fold(nodes, updates, ["type", "id"], order).select("id", "type", "props")


def merge_edges(edges: DataFrame, updates: DataFrame, nodes: DataFrame, order: str = "seq") -> DataFrame:
    """Upsert by (src, type, dst); updates to missing nodes are left out."""
    known = endpoints_exist(updates, nodes)
    return _fold(edges, known, ["src", "type", "dst"], order).select("src", "dst", "type", "props")


def merge_nodes_stored(spark: SparkSession, path: str, updates: DataFrame, order: str = "seq") -> list[int]:
    """``merge_nodes`` on a table stored by (type, id) with ``store_partitioned``; rewrites the touched partitions."""
    return rewrite_touched(spark, path, updates, lambda old, new: merge_nodes(old, new, order))


def merge_edges_stored(spark: SparkSession, path: str, updates: DataFrame, nodes: DataFrame,
                       order: str = "seq") -> list[int]:
    """``merge_edges`` on a table stored by (src, type, dst); updates to missing nodes touch nothing."""
    known = endpoints_exist(updates, nodes)
    return rewrite_touched(
        spark, path, known,
        lambda old, new: _fold(old, new, ["src", "type", "dst"], order).select("src", "dst", "type", "props"))


def check_graph_constraints(nodes: DataFrame) -> DataFrame:
    """(type, property, value, n) of values that occur on more than one node of the type."""
    value = F.lit(None).cast("string")
    name = F.lit(None).cast("string")
    for kind, prop in UNIQUE_PROPERTIES.items():
        source = F.col("id") if prop == "id" else F.try_element_at("props", F.lit(prop))
        value = F.when(F.col("type") == kind, source).otherwise(value)
        name = F.when(F.col("type") == kind, F.lit(prop)).otherwise(name)
    return (
        nodes.filter(F.col("type").isin(list(UNIQUE_PROPERTIES)))
        .select("type", name.alias("property"), value.alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy("type", "property", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )


def _both_ways(edges: DataFrame) -> DataFrame:
    """(a, b): every edge in both directions, from one pass over the edges."""
    ends = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("src", "dst"), ("dst", "src"))]
    return edges.select(F.inline(F.array(*ends)))


def hop_distances(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(id, distance) of nodes at undirected distance 0..depth; empty if the start has no edge.

    One semi join, one distinct and one anti join per hop. The visited set is
    written after every hop, so the plan does not grow, a lost executor costs
    one hop at most, and a small frontier is broadcast to the edges.
    """
    steps = _both_ways(edges)
    known = not edges.filter((F.col("src") == F.lit(start)) | (F.col("dst") == F.lit(start))).isEmpty()
    seen = edges.sparkSession.createDataFrame([(start, 0)] if known else [], "id string, distance int")
    for hop in range(1, depth + 1):
        frontier = seen.filter(F.col("distance") == hop - 1).select(F.col("id").alias("a"))
        found = (
            steps.join(frontier, "a", "left_semi").select(F.col("b").alias("id")).distinct()
            .join(seen, "id", "left_anti")
            .withColumn("distance", F.lit(hop))
        )
        seen = cut_lineage(seen.unionByName(found))
    return seen


def k_hop_subgraph(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges on undirected paths of 1..depth edges from ``start``.

    An edge lies on such a path if and only if one end is within depth-1.
    Parallel edges collapse to one per (src, dst).
    """
    reached = hop_distances(edges, start, depth)
    inner = reached.filter(F.col("distance") <= depth - 1).select("id")
    plain = edges.select("src", "dst", "type")
    by_src = plain.join(inner.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst", "type")
    by_dst = plain.join(inner.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "type")
    kept = by_src.unionByName(by_dst).groupBy("src", "dst").agg(F.max("type").alias("type"))
    return nodes.join(reached.select("id"), "id", "left_semi"), kept


def similar_by_graph(edges: DataFrame, patient: str, k: int = 10, variant: str = "HAS_VARIANT",
                     phenotype: str = "HAS_PHENOTYPE") -> DataFrame:
    """k nodes sharing most with ``patient``: 2 per shared variant, 1 per shared phenotype, both needed.

    The patient's own targets are distinct, so each step is a semi join: a
    target shared by very many nodes gives one row per edge, never pairs.
    """

    def shared(kind: str, name: str) -> DataFrame:
        typed = edges.filter(F.col("type") == kind).select("src", "dst")
        mine = typed.filter(F.col("src") == F.lit(patient)).select("dst").distinct()
        others = typed.filter(F.col("src") != F.lit(patient)).join(mine, "dst", "left_semi")
        return others.groupBy("src").agg(F.count_distinct("dst").alias(name))

    both = shared(variant, "variants").join(shared(phenotype, "phenotypes"), "src")
    score = F.col("variants") * 2.0 + F.col("phenotypes")
    return (
        both.select(F.col("src").alias("similar_patient"), score.alias("similarity_score"))
        .orderBy(F.desc("similarity_score"), "similar_patient").limit(k)
    )


def drug_gene_paths(edges: DataFrame, gene_nodes: DataFrame, genes: Sequence[str], encodes: str = "ENCODES",
                    targets: str = "TARGETS") -> DataFrame:
    """(drug, gene, n): paths gene -> protein <- drug for the genes asked for.

    Genes are gathered per protein first (at most the genes asked for), so the
    join is by a unique protein and a protein with many drugs does not multiply.
    """
    wanted = gene_nodes.filter(F.col("symbol").isin(list(genes))).select(F.col("id").alias("src"), "symbol")
    per_protein = (
        edges.filter(F.col("type") == encodes).select("src", F.col("dst").alias("protein")).join(wanted, "src")
        .groupBy("protein", "symbol").agg(F.count_distinct("src").alias("n"))
        .groupBy("protein").agg(F.collect_list(F.struct("symbol", "n")).alias("found"))
    )
    hits = edges.filter(F.col("type") == targets).select(F.col("src").alias("drug"), F.col("dst").alias("protein"))
    return (
        hits.join(per_protein, "protein").dropDuplicates(["drug", "protein"]).select("drug", F.inline("found"))
        .groupBy("drug", F.col("symbol").alias("gene")).agg(F.sum("n").alias("n"))
    )


def drug_target_runs(edges: DataFrame, gene_nodes: DataFrame, drugs: DataFrame, genes: Sequence[str],
                     encodes: str = "ENCODES", targets: str = "TARGETS") -> DataFrame:
    """(drug, mechanism, status, gene, n): how many paths lead from a drug to each gene; one row for any number of them."""
    named = drug_gene_paths(edges, gene_nodes, genes, encodes, targets).join(drugs.withColumnRenamed("id", "drug"), "drug")
    return named.groupBy(
        F.col("name").alias("drug"), "mechanism", F.col("approval_status").alias("status"), "gene").agg(F.sum("n").alias("n"))


def drug_targets(edges: DataFrame, gene_nodes: DataFrame, drugs: DataFrame, genes: Sequence[str],
                 encodes: str = "ENCODES", targets: str = "TARGETS") -> DataFrame:
    """(drug, mechanism, status, targeted_genes): the genes sorted, with repeats.

    A gene is listed once per path, for drugs whose paths fit in a row; the
    rows of :func:`drug_target_runs` hold any number.

    ``gene_nodes``: (id, symbol). ``drugs``: (id, name, mechanism, approval_status).
    """
    runs = drug_target_runs(edges, gene_nodes, drugs, genes, encodes, targets)
    listed = runs.groupBy("drug", "mechanism", "status").agg(
        F.sort_array(F.collect_list(F.struct("gene", "n"))).alias("runs")
    )
    repeated = F.flatten(F.transform("runs", lambda r: F.array_repeat(r["gene"], r["n"].cast("int"))))
    return listed.select("drug", "mechanism", "status", repeated.alias("targeted_genes"))


def degree_centrality(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(node_id, degree) of the nodes of a type, both directions, a self-loop once, zero kept."""
    both = F.array(F.col("src"), F.when(F.col("src") != F.col("dst"), F.col("dst")))
    ends = edges.select(F.explode(F.array_compact(both)).alias("node_id"))
    degrees = ends.groupBy("node_id").agg(F.count(F.lit(1)).cast("double").alias("degree"))
    wanted = nodes.filter(F.col("type") == kind).select(F.col("id").alias("node_id"))
    return (
        wanted.join(degrees, "node_id", "left").fillna(0.0, subset=["degree"])
        .orderBy(F.desc("degree"), "node_id")
    )


def index_graph(nodes: DataFrame, edges: DataFrame, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Dense node index by sorted id, and the edges as index pairs.

    ``only``: ids of patients to keep; nodes other than patients stay if an
    edge ties them to a kept patient.
    """
    if only is not None:
        kept = only.select("id").distinct()
        near = edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
        back = edges.join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
        ties = near.unionByName(back).distinct()
        others = nodes.filter(F.col("type") != "Patient").join(ties, "id", "left_semi")
        nodes = nodes.filter(F.col("type") == "Patient").join(kept, "id", "left_semi").unionByName(others)
    index = cut_lineage(dense_index(nodes.select("id").distinct(), "id", "node_index"), "node-index")  # read three times
    pairs = (
        edges.select("src", "dst")
        .join(index.select(F.col("id").alias("src"), F.col("node_index").alias("src_index")), "src")
        .join(index.select(F.col("id").alias("dst"), F.col("node_index").alias("dst_index")), "dst")
    )
    return index, pairs.select("src_index", "dst_index")


def node_features(nodes: DataFrame, dim: int = FEATURE_WIDTH,
                  types: Sequence[str] = tuple(schemas.FEATURE_NODE_TYPES)) -> DataFrame:
    """(id, features): one-hot of the node type in a vector of ``dim``; other types are zero."""
    position: Column = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("type"))
    slots = F.transform(
        F.sequence(F.lit(1), F.lit(dim)), lambda i: F.when(i == position, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return nodes.select("id", slots.alias("features"))


def propagate_features(features: DataFrame, edges: DataFrame, hops: int = 2, dim: int | None = None) -> DataFrame:
    """``hops`` rounds of: the mean of a node's own and its neighbours' vectors.

    Neighbours are distinct and counted once in either direction. Only non-zero
    (position, value) pairs travel over the edges, and they are summed by node
    and position, so a hub is summed in many tasks and a wide vector that is
    mostly zero costs little. In the first round each row of a repeated id counts;
    from then on it is one node, with one row in the result.
    """
    if dim is None:
        first = features.select(F.size("features").alias("n")).first()
        dim = first["n"] if first else 0
    ids = features.select("id")
    # nodes go by numbers until the end: links are shuffled again and again, and names are most of their bytes
    numbers = cut_lineage(ids.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("rows"))
                          .select("id", "rows", F.monotonically_increasing_id().alias("n")), "numbers")
    number_of = lambda end: numbers.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"))
    # a pair of neighbours is one row until both ends are known to be there
    links = (
        edges.filter(F.col("src") != F.col("dst")).select("src", "dst")
        .join(number_of("dst"), "dst").select("src", "n_dst").join(number_of("src"), "src")
        .select(F.least("n_src", "n_dst").alias("src"), F.greatest("n_src", "n_dst").alias("dst")).distinct()
    )
    links = _both_ways(cut_lineage(links, "links"))
    sizes = cut_lineage(numbers.select("n").join(links.groupBy(F.col("b").alias("n")).agg(F.count(F.lit(1)).alias("near")), "n", "left")
                        .select("n", (F.coalesce("near", F.lit(0)) + 1).alias("size")), "sizes")
    pairs = (features.select("id", F.posexplode(F.col("features").cast("array<double>")).alias("at", "value")).filter("value <> 0")
             .join(numbers, "id").select("n", "at", "value"))
    first_sizes = sizes
    if not numbers.filter("rows > 1").isEmpty():
        near = links.join(numbers.select(F.col("n").alias("a"), "rows"), "a").groupBy(F.col("b").alias("n")).agg(F.sum("rows").alias("near"))
        first_sizes = cut_lineage(numbers.select("n", "rows").join(near, "n", "left")
                                  .select("n", (F.col("rows") + F.coalesce("near", F.lit(0))).alias("size")), "sizes")
    for hop in range(hops):
        sent = links.join(pairs.withColumnRenamed("n", "a"), "a").select(F.col("b").alias("n"), "at", "value")
        summed = pairs.unionByName(sent).groupBy("n", "at").agg(F.sum("value").alias("value"))
        pairs = summed.join(sizes if hop else first_sizes, "n").select("n", "at", (F.col("value") / F.col("size")).alias("value"))
        if hop % 2 and hop < hops - 1:  # two hops in one plan read the links by one shuffle
            pairs = cut_lineage(pairs)
    found = (pairs.groupBy("n").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("found"))
             .join(numbers, "n").select("id", "found"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("found", i), F.lit(0.0)))
    every = dense if dim else F.array().cast("array<double>")
    known = numbers.select("id").unionByName(ids.filter("id IS NULL"))
    return known.join(found, "id", "left").select("id", F.coalesce(every, F.array_repeat(F.lit(0.0), dim)).alias("features"))
