"""Source divergence, shards and fill-in-the-middle against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortry.llm import divergence, fill_in_middle, sharding

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# ---------------------------------------------------------------- divergence

def plain_audit(rows, least, top=50):
    found = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    docs = [(lang or "", source or "", found.findall(low(text or ""))) for _, text, lang, source, _ in rows]
    groups = defaultdict(Counter)
    in_docs, totals = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        groups[lang, source].update(words)
        totals[lang].update(words)
        in_docs[lang].update(set(words))
    out = []
    kept = {lang: sorted(w for w, n in in_docs[lang].items() if n >= least) for lang, _ in groups}
    p = lambda n, v: lambda w: 1 + 10**9 * (n[w] + 5) // (sum(n[x] for x in v) + 5 * len(v))
    for (lang, source), n in groups.items():
        v = kept[lang]
        own, whole = p(n, v), p(totals[lang], v)
        pair = [(other, sum(abs(own(w) - p(m, v)(w)) for w in v)) for (la, other), m in groups.items() if la == lang and other != source]
        term = [(w, own(w) - whole(w)) for w in v if n[w] and own(w) > whole(w)]
        for part, values, most in (("pair", pair, None), ("term", term, top)):
            ranked = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_terms", [3, 1 << 16])
def test_audit_equals_plain_version(spark, block_terms, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 40)
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "é", "Éa", "漢字", "x1y", "zz", "q", "ab", "cd", "ef", "gh"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "", None, "Ω"]), 1)
            for i in range(120)]
    rows += [(7, None, "en", "empty", 0), (None, "12 %", "xx", "alone", 0), (None, None, None, None, None), (8, "only here", "yy", "a", 1), (8, "", "yy", "b", 1)]
    rows += [rows[0]] * 3
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS term", "'x' AS block", "2 AS n").repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(docs, 5, 4, block_terms).collect())
    want = plain_audit(rows, 5, 4)
    assert got == want
    assert {(r[1], r[3], r[4]) for r in want if r[0] == "yy"} == {("a", "b", 0), ("b", "a", 0)}  # no kept terms


def test_audit_of_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert divergence.audit(empty).collect() == []


def test_gallop_finds_shared_ids():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, rng.integers(1, 3000), rng.integers(0, 500))) for _ in range(2))
        i, j = divergence.gallop(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(500):
        n, more, v = rng.randrange(10**15), rng.randrange(8 * 10**15), rng.randrange(1, 10**8)
        assert divergence.shares(np.array([n]), n + more, v)[0] == 1 + 10**9 * (n + 5) // (n + more + 5 * v)


def test_terms_are_those_of_the_pattern(monkeypatch):
    rng = random.Random(4)
    signs = [chr(c) for c in range(128)] + ["é", "Ä", "漢", "\u2028", "\u00a0", "😀"] * 8
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 90))) for _ in range(300)] + ["Ab cdé " * 50 + "x" * 90 + " 1 y"]
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(divergence, "SLICE", size)
        for text in texts:
            want = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
            assert [t.decode() for part in divergence.terms_of(text.encode()) for t in part] == want


# -------------------------------------------------------------------- shards

def twister_order(seed: int, n: int) -> list[int]:
    """An inside-out Fisher-Yates shuffle driven by the 32-bit Mersenne twister, as Spark documents its ``shuffle``."""
    bits = np.random.RandomState([seed >> 32 & 0xFFFFFFFF, seed & 0xFFFFFFFF])
    next31 = lambda: int(bits.randint(0, 1 << 32, dtype=np.uint64)) >> 1
    order = [0] * n
    for i in range(n):
        bound = i + 1
        if bound & i == 0:
            j = bound * next31() >> 31
        else:
            while True:
                raw = next31()
                j = raw % bound
                if raw - j + bound - 1 < 1 << 31:
                    break
        order[i] = order[j]
        order[j] = i
    return order


def test_buckets_are_shuffled_as_fisher_and_yates_say(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    scattered = sharding.scatter(docs, 4, 20, [F.col("doc_id")]).cache()
    before = defaultdict(list)
    for r in scattered.collect():
        before[r[0]].append((r[1], r[2]["doc_id"]))
    assert sorted(before) == [0, 1, 2, 3] and all(80 < len(b) < 175 for b in before.values())
    got = defaultdict(dict)
    for r in sharding.shuffle_buckets(scattered, 20).collect():
        got[r[0]][r[1]] = r[2]["doc_id"]
    for bucket, records in before.items():
        ids = [i for _, i in sorted(records)]
        assert [got[bucket][k] for k in range(len(ids))] == [ids[k] for k in twister_order(20 + bucket, len(ids))]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 203])
def test_shards_hold_every_row_once(spark, n):
    rows = [(None if i % 50 == 3 else i, None if i % 7 == 0 else "é" * (i % 5), None, "s", i) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS `__bucket`", "'x' AS shard", "3 AS record")
    placed = sharding.shuffled_shards(docs, 8, bucket_bytes=3000)
    got = sharding.digest(placed).collect()
    assert placed.columns == [*(c for c in docs.columns if c != "shard"), "shard", "slot"]
    counts = Counter(r["shard"] for r in got)
    assert sorted(counts.values(), reverse=True) == [n // 8 + (i < n % 8) for i in range(8) if n // 8 + (i < n % 8)]
    for shard, many in counts.items():
        assert 0 <= shard < 8 and sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(many))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)
    again = sharding.digest(sharding.shuffled_shards(docs, 8, bucket_bytes=3000)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_copies_are_spread_over_buckets(spark):
    docs = spark.createDataFrame([(1, "same text", "en", "s", 9)] * 900 + [(2, "other", "en", "s", 5)] * 100, DOCS).coalesce(2)
    sizes = [r["count"] for r in sharding.scatter(docs, 5, 20, [F.col("doc_id")]).groupBy("__bucket").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 260


def test_shards_are_written_in_folders(spark, tmp_path):
    docs = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(20)], DOCS)
    sharding.write_shards(sharding.shuffled_shards(docs, 3), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {0: 7, 1: 7, 2: 6}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "t", "en", "s", 1)], DOCS)
    plan = sharding.shuffle_buckets(sharding.scatter(docs, 2, 1, [F.col("text")]), 1)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan


# ------------------------------------------------------------------- middles

def plain_middle(i, text):
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def odd_texts(rng, most):
    signs = ["a", "<", "P", ">", "S", "é", "漢", "😀", "<P", "S>", "M>", "\n"]
    return ["".join(rng.choice(signs) for _ in range(rng.choice([0, 1, 2, 5, 30]))) for _ in range(rng.randint(0, most))]


@pytest.mark.parametrize("block", [1, 7, 1 << 20])
def test_scatter_and_gather_on_odd_bytes(monkeypatch, block):
    monkeypatch.setattr(fill_in_middle, "BLOCK", block)
    monkeypatch.setattr(fill_in_middle, "GROUP_BYTES", 150)
    rng = random.Random(block)
    for _ in range(150):
        texts = odd_texts(rng, 9)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["i", "t"])
        for part, data, offsets in fill_in_middle._groups(batch, 1):
            r = fill_in_middle.lay_out(data, offsets, part.column(0).to_pylist())
            out = fill_in_middle._strings(r["out"], r["offsets"]).to_pylist()
            assert out == [plain_middle(i, t)[4] for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            back = fill_in_middle._strings(*fill_in_middle.gather_back(r["out"], r["offsets"], r["plain"], r["spm"]))
            assert back.to_pylist() == part.column(1).to_pylist()


def test_middles_equal_plain_version(spark):
    rng = random.Random(2)
    rows = [(i, t, None, None, 1) for i, t in enumerate(t for _ in range(40) for t in odd_texts(rng, 20))]
    rows += [(None, "null id", "en", "s", 1), (5, None, "en", "s", 1), (3, "twice", "en", "s", 1), (3, "twice", "en", "s", 1), (9, "lang é " * 400_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS output", "'b' AS form", "2 AS n")
    formed = fill_in_middle.restore(fill_in_middle.transform(docs))
    got = Counter(tuple(r) for r in formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect())
    assert got == Counter((i, *plain_middle(i, t), t or "") for i, t, *_ in rows)
    digests = fill_in_middle.digest(formed).where("doc_id = 9 AND n > 1000").first()
    assert digests["restored_sha256"] == hashlib.sha256(("lang é " * 400_000).encode()).hexdigest()


def test_middles_of_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert fill_in_middle.digest(fill_in_middle.restore(fill_in_middle.transform(empty))).collect() == []
