"""Updates of stored tables touch no other partition; similarity for every subject equals brute force."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cohortry.operators import graph as G
from cohortry.operators import join as J
from cohortry.operators import maintain as U
from cohortry.plans.partitions import partition_of, read_partitioned, store_partitioned


def files_of(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def part(name):
    return int(name.split("/")[0].split("=")[1])


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    target = spark.range(500).select(
        "id", (F.col("id") * 2).alias("v"), F.lit("old").alias("created_at"), F.lit("old").alias("updated_at"))
    store_partitioned(target, path, ["id"], 16)
    before = files_of(path)
    updates = spark.createDataFrame([(3, 1, 0), (3, 9, 1), (1000, 5, 0)], "id bigint, v bigint, seq int")
    touched = U.upsert_stored(spark, path, updates, "id", F.lit("now"), [F.desc("seq")])
    wanted = {r[0] for r in updates.select(partition_of(["id"], 16)).collect()}
    assert set(touched) == wanted and len(wanted) < 16
    after, kept = files_of(path), lambda names: {n for n in names if n.startswith("__part") and part(n) not in wanted}
    assert kept(before) == kept(after) and kept(before)
    assert not {n for n in before & after if n.startswith("__part") and part(n) in wanted}
    want = U.upsert(target, updates, "id", F.lit("now"), [F.desc("seq")])
    got = read_partitioned(spark, path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.filter("id = 3").first().v == 9


def test_no_updates_and_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    kind = "id bigint, v bigint, created_at string, updated_at string"
    store_partitioned(spark.createDataFrame([], kind), path, ["id"], 4)
    none = spark.createDataFrame([], "id bigint, v bigint")
    assert U.upsert_stored(spark, path, none, "id", F.lit("now"), ["v"]) == []
    assert read_partitioned(spark, path).count() == 0
    U.upsert_stored(spark, path, spark.createDataFrame([(1, 2), (None, 3)], "id bigint, v bigint"), "id", F.lit("now"), ["v"])
    assert sorted(map(tuple, read_partitioned(spark, path).collect()), key=str) == sorted(
        map(tuple, U.upsert(spark.createDataFrame([], kind), spark.createDataFrame(
            [(1, 2), (None, 3)], "id bigint, v bigint"), "id", F.lit("now"), ["v"]).collect()), key=str)
    with pytest.raises(Exception):
        store_partitioned(spark.createDataFrame([], kind), path, ["id"], 4)


def test_stored_graph_merge_equals_the_plain_one(spark, tmp_path):
    nodes = spark.createDataFrame(
        [(str(i), "Gene" if i % 3 else "Drug", {"n": str(i)}) for i in range(60)], "id string, type string, props map<string,string>")
    changes = spark.createDataFrame(
        [("7", "Gene", {"n": "x", "m": "1"}, 1), ("7", "Gene", {"m": None}, 2), ("new", "Gene", {"a": "b"}, 3)],
        "id string, type string, props map<string,string>, seq int")
    path = str(tmp_path / "n")
    store_partitioned(nodes, path, ["type", "id"], 32)
    before = files_of(path)
    G.merge_nodes_stored(spark, path, changes)
    rows = lambda df: sorted((r["id"], r["type"], sorted(r["props"].items())) for r in df.collect())
    assert rows(read_partitioned(spark, path)) == rows(G.merge_nodes(nodes, changes))
    assert len(before & files_of(path)) > len(before) // 2

    edges = spark.createDataFrame(
        [(str(i), str(i + 1), "R", {"w": str(i)}) for i in range(50)], "src string, dst string, type string, props map<string,string>")
    more = spark.createDataFrame([("1", "2", "R", {"w": "z"}, 1), ("1", "nobody", "R", {"w": "z"}, 1)],
                                 "src string, dst string, type string, props map<string,string>, seq int")
    path = str(tmp_path / "e")
    store_partitioned(edges, path, ["src", "type", "dst"], 32)
    assert len(G.merge_edges_stored(spark, path, more, nodes)) == 1
    rows = lambda df: sorted((r["src"], r["dst"], r["type"], sorted(r["props"].items())) for r in df.collect())
    assert rows(read_partitioned(spark, path)) == rows(G.merge_edges(edges, more, nodes))


def brute(rows, k, near, often):
    ids = sorted({r[0] for r in rows if r[0] is not None})
    close = lambda x, y, w: x is not None and y is not None and abs(x - y) <= w
    score = lambda a, b: (a[1] is not None and a[1] == b[1]) + 0.5 * close(a[2], b[2], near) + 0.5 * close(a[3], b[3], often)
    out = []
    for i in ids:
        found = [(-max(score(a, b) for a in rows if a[0] == i for b in rows if b[0] == j), j) for j in ids if j != i]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("seed, k", [(1, 3), (2, 5), (3, 100)])
def test_similar_to_each_equals_brute_force(spark, seed, k):
    r = random.Random(seed)
    some = lambda value: None if r.random() < 0.1 else value
    rows = [(r.randrange(40), some(r.choice("abbbb")), some(r.randrange(40)),
             some(r.choice([0.1 * r.randrange(60), float("nan"), -3.0 * r.randrange(4)]))) for _ in range(90)]
    rows += [rows[0], (None, "b", 1, 1.0), (77, None, None, None)]
    df = spark.createDataFrame(rows, "patient_id int, seizure_type string, age_at_onset int, seizure_frequency_per_month double")
    got = sorted(map(tuple, J.similar_to_each(df, k, onset_within=3, frequency_within=0.3).collect()))
    assert got == brute(rows, k, 3, 0.3)


def test_similar_to_each_agrees_with_one_subject_and_no_rows(spark):
    rows = [(str(i), "abc"[i % 3], i % 9, float(i % 5)) for i in range(60)]
    kind = "patient_id string, seizure_type string, age_at_onset int, seizure_frequency_per_month double"
    df = spark.createDataFrame(rows, kind)
    every = J.similar_to_each(df, 4)
    for who in ("7", "31"):
        one = [tuple(r) for r in J.similar_by_profile(df, who, 4).collect()]
        assert [(r[2], r[3]) for r in sorted(map(tuple, every.filter(F.col("patient_id") == who).collect()))] == one
    assert J.similar_to_each(spark.createDataFrame([], kind)).count() == 0
    assert J.similar_to_each(spark.createDataFrame(rows[:1], kind)).count() == 0


def test_lists_of_near_ids_make_no_pairs_of_values(spark, monkeypatch):
    ids = list(range(1500))
    random.Random(5).shuffle(ids)
    rows = [(i, n * 0.002) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id int, frequency double")
    seen, plain = [], J._first_ids
    monkeypatch.setattr(J, "_first_ids", lambda rows, columns, n: seen.append(rows.count()) or plain(rows, columns, n))
    got = {r["frequency"]: r["ids"] for r in J._smallest_ids(df, ["frequency"], {"frequency": 2.0}, 5).collect()}
    assert got == {v: sorted(i for i, x in rows if abs(x - v) <= 2.0)[:5] for _, v in rows}
    assert max(seen) < 20 * len(rows)  # of about two million pairs within the band
