"""SimHash components, repeated passages and components of graphs, against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cohortry.llm import graph, simhash, substring
from tests.llm import brute

VOCABULARY = [f"w{i}" for i in range(400)]


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(VOCABULARY) for _ in range(n))


def edited(text: str, seed: int, times: int) -> str:
    draw, w = random.Random(seed), text.split()
    for _ in range(times):
        w[draw.randrange(len(w))] = draw.choice(VOCABULARY)
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    base = prose(1, 300)
    rows = [(i, prose(100 + i, 20 + 7 * i)) for i in range(30)]
    rows += [(50 + i, edited(base, i, 1 + i % 5)) for i in range(40)]
    rows += [(200 + i, base) for i in range(5)] + [(300, None), (301, ""), (302, " \t\n"), (303, "one"), (304, "One two"),
                                                  (305, "one  TWO"), (306, "é x É"), (307, "x " * 3000)]
    passage = prose(7, 80)
    rows += [(400 + i, f"{prose(500 + i, 40)} {passage} {prose(600 + i, 33)}") for i in range(25)]
    rows += [(440 + i, " ".join(passage.split()[i:i + 50 + i])) for i in range(6)]
    rows += [(460, passage + " " + passage), (461, "z " * 49), (462, "z " * 50), (463, "z " * 60)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in texts],
                                 "doc_id bigint, text string, fp int, id int, doc string").repartition(3)


def test_fingerprints(texts):
    for _, t in texts:
        assert simhash.fingerprint(t or "", 3) & (1 << 64) - 1 == brute.fingerprint(t)


def test_components_equal_brute_force(docs, texts):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute.simhash_components(texts)


def test_large_lists_are_cut_into_blocks(docs, texts, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute.simhash_components(texts)


def test_lists_miss_no_pair():
    for distance in range(6):
        for sets in [simhash._lists(distance)]:
            from itertools import combinations

            for different in combinations(range(8), distance):
                assert any(not set(s) & set(different) for s in sets)


def test_null_and_repeated_keys(spark):
    rows = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q"), (7, "a b c d")],
                                 "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in simhash.near_duplicates(rows).collect())
    assert got == [(0, 0), (0, 5), (5, 5), (5, 5), (7, 5)]
    kept = sorted(r["doc_id"] or 0 for r in simhash.one_of_each(rows).collect())
    assert kept == [0, 0, 5]
    assert simhash.near_duplicates(rows.limit(0)).count() == 0


def test_one_of_each(docs, texts):
    want = sorted(i for i, (_, root) in brute.simhash_components(texts).items() if i == root)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 200), (300, 299), (None, 1)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), 300: 299}


def test_key_filter_misses_none(spark):
    keys = spark.range(5000).selectExpr("id * 7 AS k")
    df = spark.range(0, 40000).selectExpr("id AS k", "'x' AS bits", "1 AS id")
    left = graph.without_keys(df, keys, "k")
    assert left.columns == df.columns and left.count() == 40000 - 5000


def test_repeats_equal_brute_force(docs, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.remove_repeats(docs).collect()}
    assert got == brute.remove_repeats(texts)


def test_odd_window(docs, texts):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"])
           for r in substring.remove_repeats(docs, window=21).collect()}
    assert got == brute.remove_repeats(texts, 21)


def test_repeated_rows_and_null_keys(spark):
    long = prose(3, 60)
    rows = spark.createDataFrame([(2, long), (2, long), (None, long), (3, long), (3, "other words")], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in substring.remove_repeats(rows).collect())
    assert got == [(0, 60, 0), (2, 60, 0), (2, 60, 0), (3, 2, 0), (3, 60, 60)]
    assert substring.remove_repeats(rows.limit(0)).count() == 0


def test_rolling_hashes():
    x = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 7, 25, 50):
        twice = substring.rolling(np.concatenate([x, x]), n)
        assert len(twice) == 2001 - n
        assert (twice[:1001 - n] == twice[1000:]).all() and len(set(twice[:1000].tolist())) == 1000
