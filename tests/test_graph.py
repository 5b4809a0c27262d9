import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import attention as A
from cohortry.operators import graph as G
from cohortry.schemas import FEATURE_NODE_TYPES


def edges(spark, rows, kind="HAS_VARIANT"):
    full = [(r[0], r[1], r[2] if len(r) > 2 else kind) for r in rows]
    return spark.createDataFrame(full, "src string, dst string, type string")


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, type string")


def props(spark, rows):
    return spark.createDataFrame(rows, "id string, type string, props map<string,string>, seq bigint")


def test_merge_nodes(spark):
    old = props(spark, [("a", "Gene", {"x": "1", "y": "1"}, 0), ("b", "Gene", {}, 0)]).drop("seq")
    new = props(spark, [("a", "Gene", {"y": "2"}, 1), ("a", "Gene", {"y": "3", "z": "3"}, 2), ("a", "Gene", {"x": None}, 3),
                        ("a", "Drug", {"x": "9"}, 1), ("c", "Gene", {}, 1)])
    got = {(r["id"], r["type"]): r["props"] for r in G.merge_nodes(old, new).collect()}
    assert got == {("a", "Gene"): {"y": "3", "z": "3"}, ("b", "Gene"): {}, ("a", "Drug"): {"x": "9"}, ("c", "Gene"): {}}


def test_merge_edges_needs_both_ends(spark):
    n = nodes(spark, [("a", "Gene"), ("b", "Gene")])
    schema = "src string, dst string, type string, props map<string,string>, seq bigint"
    new = spark.createDataFrame([("a", "b", "CAUSES", {"w": "1"}, 1), ("a", "b", "CAUSES", {"w": "2"}, 2),
                                 ("a", "b", "TARGETS", {}, 1), ("a", "zz", "CAUSES", {}, 1)], schema)
    got = {(r["src"], r["type"], r["dst"]): r["props"] for r in G.merge_edges(new.drop("seq").limit(0), new, n).collect()}
    assert got == {("a", "CAUSES", "b"): {"w": "2"}, ("a", "TARGETS", "b"): {}}


def test_constraints(spark):
    n = spark.createDataFrame([("g1", "Gene", {"symbol": "S"}), ("g2", "Gene", {"symbol": "S"}), ("g3", "Gene", {}),
                               ("p", "Patient", {}), ("p", "Patient", {}), ("d", "Drug", {"name": "S"})],
                              "id string, type string, props map<string,string>")
    got = sorted(map(tuple, G.check_graph_constraints(n).collect()))
    assert got == [("Gene", "symbol", "S", 2), ("Patient", "id", "p", 2)]


def test_k_hop_with_cycle_loop_and_parallel_edges(spark):
    e = edges(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "a"), ("b", "b"), ("a", "b", "CAUSES"), ("x", "y")])
    n = nodes(spark, [(c, "Gene") for c in "abcdexyz"])
    got_n, got_e = G.k_hop_subgraph(n, e, "a", 2)
    assert {r["id"] for r in got_n.collect()} == {"a", "b", "c", "e", "d"}
    assert {(r["src"], r["dst"]) for r in got_e.collect()} == {("a", "b"), ("c", "b"), ("d", "e"), ("e", "a"), ("b", "b")}
    assert got_e.filter("src = 'a' and dst = 'b'").count() == 1
    one = G.k_hop_subgraph(n, e, "a", 1)
    assert {r["id"] for r in one[0].collect()} == {"a", "b", "e"}
    flipped = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
    assert {r["id"] for r in G.k_hop_subgraph(n, flipped, "a", 2)[0].collect()} == {"a", "b", "c", "e", "d"}
    for start in ("z", "nobody"):
        empty = G.k_hop_subgraph(n, e, start, 2)
        assert empty[0].isEmpty() and empty[1].isEmpty()


def test_similar_needs_both_kinds(spark):
    v = [("p", "v1"), ("p", "v2"), ("q", "v1"), ("q", "v2"), ("r", "v1"), ("s", "v1"), ("q", "v1")]
    h = [("p", "h1"), ("q", "h1"), ("r", "h2"), ("s", "h1")]
    e = edges(spark, v).unionByName(edges(spark, h, "HAS_PHENOTYPE"))
    got = [tuple(r) for r in G.similar_by_graph(e, "p", 5).collect()]
    assert got == [("q", 5.0), ("s", 3.0)]


def test_drug_targets_keep_repeats(spark):
    e = edges(spark, [("g1", "p1"), ("g1", "p2"), ("g2", "p1")], "ENCODES").unionByName(
        edges(spark, [("d1", "p1"), ("d1", "p2"), ("d2", "p2"), ("d3", "p9")], "TARGETS"))
    genes = spark.createDataFrame([("g1", "A"), ("g2", "B"), ("g3", "C")], "id string, symbol string")
    drugs = spark.createDataFrame([("d1", "x", "m", "ok"), ("d2", "y", "m", None), ("d3", "z", "m", "ok")],
                                  "id string, name string, mechanism string, approval_status string")
    got = {r["drug"]: (r["status"], r["targeted_genes"]) for r in G.drug_targets(e, genes, drugs, ["A", "B"]).collect()}
    assert got == {"x": ("ok", ["A", "A", "B"]), "y": (None, ["A"])}


def test_degree_counts_self_loops_once_and_keeps_zero(spark):
    n = nodes(spark, [("a", "Gene"), ("b", "Gene"), ("c", "Gene"), ("d", "Drug")])
    e = edges(spark, [("a", "b"), ("a", "b"), ("a", "a"), ("d", "a")])
    got = [tuple(r) for r in G.degree_centrality(n, e, "Gene").collect()]
    assert got == [("a", 4.0), ("b", 2.0), ("c", 0.0)]


def test_index_and_patient_filter(spark):
    n = nodes(spark, [("p1", "Patient"), ("p2", "Patient"), ("v", "Variant"), ("w", "Variant")])
    e = edges(spark, [("p1", "v"), ("p2", "w")])
    index, pairs = G.index_graph(n, e)
    assert {r["id"]: r["node_index"] for r in index.collect()} == {"p1": 0, "p2": 1, "v": 2, "w": 3}
    assert sorted(map(tuple, pairs.collect())) == [(0, 2), (1, 3)]
    index, pairs = G.index_graph(n, e, spark.createDataFrame([("p2",)], "id string"))
    assert {r["id"]: r["node_index"] for r in index.collect()} == {"p2": 0, "w": 1}
    assert [tuple(r) for r in pairs.collect()] == [(0, 1)]


def test_features_and_propagation_against_numpy(spark):
    kinds = [("a", "Patient"), ("b", "Gene"), ("c", "Disease"), ("d", "Variant")]
    f = G.node_features(nodes(spark, kinds), 6)
    start = {r["id"]: np.array(r["features"]) for r in f.collect()}
    assert start["b"][FEATURE_NODE_TYPES.index("Gene")] == 1 and start["c"].sum() == 0 and len(start["a"]) == 6
    links = {("a", "b"), ("b", "c"), ("a", "a")}
    e = edges(spark, [*links, ("b", "a"), ("a", "gone")])
    state = start
    for _ in range(2):
        near = {i: [state[i]] for i in state}
        for x, y in {("a", "b"), ("b", "c")}:
            near[x].append(state[y])
            near[y].append(state[x])
        state = {i: np.mean(v, axis=0) for i, v in near.items()}
    got = {r["id"]: np.array(r["features"]) for r in G.propagate_features(f, e, 2).collect()}
    assert set(got) == set(state) and all(np.allclose(got[i], state[i]) for i in state)
    assert pytest.approx(1.0) == start["a"].sum()


def attention_by_numpy(state, links, layer):
    loops = [(a, b) for a, b in links if a != b and a in state and b in state] + [(i, i) for i in state]
    out = {}
    for i in state:
        heads = []
        for h in range(layer.heads):
            z = {j: state[j] @ layer.weight[h] for j in state}
            near = [a for a, b in loops if b == i]
            raw = np.array([z[j] @ layer.source[h] + z[i] @ layer.target[h] for j in near])
            e = np.exp(np.where(raw < 0, A.SLOPE * raw, raw))
            heads.append(sum(w * z[j] for w, j in zip(e / e.sum(), near)))
        row = np.concatenate(heads) if layer.concat else np.mean(heads, axis=0)
        out[i] = layer.finish(row[None])[0]
    return out


def test_attention_layers_against_numpy(spark):
    draw = np.random.default_rng(3)
    state = {f"n{i}": draw.normal(size=5) for i in range(12)}
    links = [(f"n{a}", f"n{b}") for a, b in draw.integers(0, 12, (40, 2))] + [("n1", "n2")] * 3 + [("n1", "gone"), ("gone", "n2"), (None, "n1")]
    links += [(f"n{i}", "n0") for i in range(1, 12)]
    features = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in state.items()], "id string, features array<double>, dst int")
    e = edges(spark, links).repartition(3)
    layers = A.draw_layers(5, 9, 4, layers=3, heads=2, seed=1)
    layers[0].scale, layers[0].shift = draw.normal(size=18), draw.normal(size=18)
    assert [x.width for x in layers] == [18, 18, 4] and not layers[-1].concat
    want = state
    for layer in layers:
        want = attention_by_numpy(want, [x for x in links if None not in x], layer)
    got = {r["id"]: np.array(r["features"]) for r in A.embed(features, e, layers).collect()}
    assert set(got) == set(want) and all(np.allclose(got[i], want[i]) for i in want)
    mean = A.Layer(draw.normal(size=(2, 5, 3)), draw.normal(size=(2, 3)), draw.normal(size=(2, 3)), concat=False)
    got = {r["id"]: np.array(r["features"]) for r in A.attend(features, e, mean).collect()}
    want = attention_by_numpy(state, [x for x in links if None not in x], mean)
    assert all(np.allclose(got[i], want[i]) for i in want)


def test_attention_without_edges_nulls_and_great_scores(spark):
    layer = A.Layer(np.eye(2)[None], [[900.0, 0.0]], [[0.0, 0.0]])
    rows = [("a", [1.0, 2.0]), ("b", [3.0, None]), ("c", None), ("d", [1.0])]
    features = spark.createDataFrame(rows, "id string, features array<double>")
    alone = {r["id"]: r["features"] for r in A.attend(features, edges(spark, [("x", "y")]), layer).collect()}
    assert alone == {"a": [1.0, 2.0], "b": [3.0, 0.0], "c": [0.0, 0.0], "d": [1.0, 0.0]}
    got = {r["id"]: r["features"] for r in A.attend(features, edges(spark, [("b", "a")]), layer).collect()}
    assert np.allclose(got["a"], [3.0, 0.0]) and got["d"] == [1.0, 0.0]  # 2,700 against 900: no overflow
    assert A.attend(features.limit(0), edges(spark, [("b", "a")]), layer).count() == 0


def test_repeated_traits_are_found_among_numbers(spark, tmp_path):
    from cohortry.catalog.graph import _orders_graph, _traits
    from cohortry.catalog.registry import Tables

    orders = [(1, 7), (2, 7), (3, None), (None, 8)]
    lines = [(1, 5, 5), (1, 5, 5), (2, 5, 6), (2, None, 6), (3, 9, 9), (None, 1, 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    found = _traits(t)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [
        ("c7", "p5", "HAS_VARIANT"), ("c7", None, "HAS_VARIANT"), ("c7", "s5", "HAS_PHENOTYPE"), ("c7", "s6", "HAS_PHENOTYPE"),
        (None, "p9", "HAS_VARIANT"), (None, "s9", "HAS_PHENOTYPE")]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [o_custkey#") == 2  # grouped as numbers
    held = _orders_graph(t).where("type = 'TARGETS'")
    assert held.count() == 5


def test_links_are_numbers_and_two_hops_read_them_by_one_shuffle(spark, monkeypatch):
    stored, cut = {}, G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df, label="step": stored.setdefault(label, cut(df, label)))
    nodes = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 0.0]), ("alone", [3.0, 0.0]), (None, [9.0, 9.0])],
                                  "id string, features array<double>")
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("c", "c"), ("a", "gone"), (None, "a")], "src string, dst string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = G.propagate_features(nodes, links, 2)
        got = {r["id"]: r["features"] for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {"a": pytest.approx([5 / 12, 5 / 12]), "b": pytest.approx([5 / 18, 4 / 9]), "c": pytest.approx([1 / 6, 5 / 12]),
                   "alone": [3.0, 0.0], None: [0.0, 0.0]}
    assert dict(stored["links"].dtypes) == {"src": "bigint", "dst": "bigint"} and stored["links"].count() == 2
    assert "ReusedExchange" in plan


def test_each_row_of_a_repeated_id_counts_in_the_first_round(spark):
    nodes = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, features array<double>")
    links = spark.createDataFrame([("a", "b")], "src string, dst string")
    got = sorted((r["id"], [round(v, 9) for v in r["features"]]) for r in G.propagate_features(nodes, links, 1).collect())
    assert got == [("a", [0.666666667, 0.333333333]), ("b", [0.666666667, 0.333333333])]
    got = G.propagate_features(nodes, spark.createDataFrame([("a", "c")], "src string, dst string"), 2).collect()
    assert sorted((r["id"], r["features"]) for r in got) == [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
