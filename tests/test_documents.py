import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortry.functions import text
from cohortry.functions.text import split_text, window_chunks
from cohortry.operators import documents as D
from cohortry.pipeline import build_knowledge_base


def rows(df, column):
    return [r[column] for r in df.collect()]


@pytest.mark.parametrize("text,want", [
    ("", []),
    ("short", ["short"]),
    ("\n\n\n", []),
    ("a b c", ["a b c"]),
    ("aaaaaaaaaaaa", ["aaaaa", "aaaaa", "aaaaa", "aaa"]),
    # the separator opens the next piece, so ' three' is too long and is cut by characters
    ("one two three", ["one", "two", "thre", "ree"]),
    ("ab\n\ncd\n\nefghij", ["ab", "cd", "efgh", "ghij"]),
])
def test_splitter_by_hand(text, want):
    assert split_text(text, 5, 2) == want


def test_splitter_invariants():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["word", "x", " ", ". ", "\n", "\n\n", "longerword"]) for _ in range(rng.randint(0, 300)))
        size, overlap = rng.choice([(50, 10), (20, 5), (100, 0)])
        chunks = split_text(text, size, overlap)
        assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
        at = 0
        for c in chunks:  # chunks appear in order and every word is kept
            found = text.find(c, max(0, at - size))
            assert found >= 0
            at = found
        letters = set("".join(chunks).split())
        if overlap == 0:
            assert "".join("".join(chunks).split()) == "".join(text.split())
        assert letters or not text.split()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_splitter_keeps_every_letter(text, size, overlap):
    chunks = split_text(text, size, overlap)
    assert all(0 < len(c) <= size for c in chunks)
    assert "".join(chunks).count("a") >= text.count("a")
    if overlap == 0:
        assert "".join("".join(chunks).split()) == "".join(text.split())


def test_long_text_without_separators(spark):
    text = "z" * 33_000
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, text string")
    out = {r["id"]: r["chunks"] for r in D.chunk_documents(df).collect()}
    assert max(map(len, out[1])) <= 1000 and len(out[1]) > 33 and out[2] == [] and out[3] == []


@pytest.mark.parametrize("n", [0, 1, 999, 1000, 1001, 1800, 1801, 2600, 33_000])
def test_windows_cover_the_text(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    got = spark.createDataFrame([(text,)], "t string").select(window_chunks("t").alias("c")).first()["c"]
    count = 0 if n == 0 else 1 if n <= 1000 else -(-(n - 1000) // 800) + 1
    assert got == [text[i * 800 : i * 800 + 1000] for i in range(count)]


def test_windows_keep_line_breaks_and_wide_characters(spark):
    text = "a\n\U0001F600é" * 700
    got = spark.createDataFrame([(text,)], "t string").select(window_chunks("t").alias("c")).first()["c"]
    assert got == [text[i * 800 : i * 800 + 1000] for i in range(len(got))] and got[-1].endswith(text[-5:])


def test_abstract_numbering_skips_blank_pieces(spark):
    df = spark.createDataFrame([("k", "one\n\n \n\ntwo\n\n\n\nthree")], "k string, text string")
    got = [(r["ordinal"], r["content"]) for r in D.split_abstracts(df, "text", ["k"]).orderBy("ordinal").collect()]
    assert got == [(0, "one"), (1, "two"), (2, "three")]


def test_chunk_numbers_run_over_pages(spark, monkeypatch):
    monkeypatch.setattr(D, "PAGE_BLOCK", 2)
    df = spark.createDataFrame([("x/a.b.pdf", p, [f"c{p}{i}" for i in range(p % 3)]) for p in range(7)] + [("y.pdf", 0, ["q"])],
                               "source string, page int, chunks array<string>")
    out = D.number_chunks(df, "source", "page", "guideline").collect()
    mine = sorted((int(r["metadata"]["chunk_index"]), r["id"], r["content"], r["metadata"]["page"]) for r in out if r["id"].startswith("a.b"))
    want = [f"c{p}{i}" for p in range(7) for i in range(p % 3)]
    assert [m[2] for m in mine] == want and [m[1] for m in mine] == [f"a.b_{i}" for i in range(len(want))]
    assert {r["id"] for r in out if r["metadata"]["source"] == "y.pdf"} == {"y_0"}


def test_recursive_chunks_hold_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(text, "TEXTS_AT_ONCE", 3)
    rows = [(i, None if i % 5 == 0 else "word " * (70 * i)) for i in range(11)]
    got = {r["id"]: r["chunks"] for r in D.chunk_documents(spark.createDataFrame(rows, "id int, text string").coalesce(1)).collect()}
    assert got == {i: text.split_text(t) if t else [] for i, t in rows}


def _nearest(docs, q, k):
    d = [(round(1 - float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 10), i) for i, v in docs]
    return [i for _, i in sorted(d)[:k]]


def test_vector_search_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(0)
    docs = [(i, rng.normal(size=8)) for i in range(300)]
    docs += [(300 + i, docs[5][1]) for i in range(3)]  # equal vectors: ties by id
    df = spark.createDataFrame([(i, [float(x) for x in v], {"kind": str(i % 2)}) for i, v in docs],
                               "id int, embedding array<double>, metadata map<string,string>").repartition(5)
    qs = [(f"q{i}", rng.normal(size=8)) for i in range(9)] + [("same", docs[5][1])]
    queries = spark.createDataFrame([(n, [float(x) for x in v]) for n, v in qs], "query_id string, embedding array<double>")
    for page in (1000, 3):
        monkeypatch.setattr(D, "QUERY_PAGE", page)
        got = {}
        for r in D.vector_search(df, queries, 4).orderBy("rank").collect():
            got.setdefault(r["query_id"], []).append(r["doc_id"])
        assert got == {n: _nearest(docs, v, 4) for n, v in qs}
    assert got["same"] == [5, 300, 301, 302]
    odd = D.vector_search(df, queries.filter("query_id = 'q0'"), 500, {"kind": "1"})
    assert odd.count() == sum(i % 2 for i, _ in docs)
    assert D.vector_search(df, queries, 4, {"kind": "none"}).isEmpty()
    assert D.vector_search(df, queries.limit(0), 4).isEmpty()


def test_pages_of_queries_search_equal_vectors_once(spark, monkeypatch):
    asked = []
    page_hits = D._page_hits
    monkeypatch.setattr(D, "QUERY_PAGE", 2)
    monkeypatch.setattr(D, "_page_hits", lambda docs, page, *a: asked.append(page.count()) or page_hits(docs, page, *a))
    docs = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id int, embedding array<double>")
    queries = [(None if i == 7 else i, [7.0, 1.0] if i == 7 else [float(i % 2), 1.0]) for i in range(12)]
    got = D.vector_search(docs, spark.createDataFrame(queries, "query_id int, embedding array<double>"), 2).collect()
    assert sum(asked) == 3 and len(got) == 24
    assert all(r["doc_id"] == (5 if r["query_id"] is None else r["query_id"] % 2) for r in got if r["rank"] == 1)


def test_add_documents_keeps_first_of_new_ids(spark):
    old = spark.createDataFrame([("a", "x")], "id string, content string")
    new = spark.createDataFrame([("a", "y"), ("b", "1"), ("b", "2"), ("c", "z")], "id string, content string")
    got = D.add_documents(old, new).collect()
    assert sorted(r["id"] for r in got) == ["b", "c"]


def test_embedding_has_unit_length(spark):
    df = spark.createDataFrame([("a b c",), ("a a d",), ("",)], "content string")
    vectors = np.array(rows(D.embed_tfidf(df, dim=32), "embedding"))
    assert np.allclose(np.linalg.norm(vectors[:2], axis=1), 1, atol=1e-6) and not vectors[2].any()


@pytest.mark.integration
def test_knowledge_base_and_recommendation(spark, tmp_path):
    folder = tmp_path / "guides"
    folder.mkdir()
    (folder / "one.txt").write_text("epilepsy focal treatment with carbamazepine\n\n" + "more words here. " * 100)
    (folder / "skip.md").write_text("not read")
    pages = spark.createDataFrame([("x.pdf", 0, "absence seizures and valproate"), ("x.pdf", 1, "lamotrigine dosing")],
                                  "source string, page int, text string")
    abstracts = spark.createDataFrame([("PubMed", "q", "first abstract\n\nsecond abstract")], "source string, query string, text string")
    path = str(tmp_path / "kb")
    first = build_knowledge_base(spark, path, str(folder), abstracts, pages, dim=64)
    ids = sorted(rows(first, "id"))
    assert len(ids) == len(set(ids)) and {"x_0", "x_1", "PubMed_0", "PubMed_1", "one_0"} <= set(ids)
    again = build_knowledge_base(spark, path, str(folder), abstracts, pages, dim=64)
    assert again.count() == len(ids)

    model = D.fit_embedding(again.select("content"), dim=64)
    docs = D.embed(again.select("id", "content"), model)
    patients = spark.createDataFrame([
        ("P1", "focal", ["levetiracetam"], [("SCN1A", "v", "missense")]), ("P2", "absence", [], [])],
        "patient_id string, seizure_type string, previous_treatments array<string>, "
        "genetic_variants array<struct<gene:string,variant:string,variant_type:string>>")
    out = {r["patient_id"]: r for r in D.recommendation_context(patients, docs, model, 2).collect()}
    assert out["P1"]["search_text"] == "epilepsy focal SCN1A treatment resistance treatment guidelines recommendations"
    assert "Fonte 1: " in out["P1"]["context"] and "Fonte 2: " in out["P1"]["prompt"]
    assert "- Genótipo: SCN1A\n" in out["P1"]["prompt"] and "- Genótipo: não disponível\n" in out["P2"]["prompt"]
    assert "- Tratamentos anteriores: nenhum\n" in out["P2"]["prompt"]
    assert 0 <= out["P1"]["confidence"] <= 1


def test_template_text_is_not_expanded_twice(spark):
    df = spark.createDataFrame([("{question}",)], "context string").withColumn("seizure_type", F.lit("t"))
    prompt = D.build_prompts(df).first()["prompt"]
    assert "{question}" in prompt and "Pergunta: Qual o melhor" in prompt


@pytest.mark.parametrize("k", [2, 30])
def test_search_with_odd_queries(spark, k):
    docs = spark.createDataFrame([(i, [float(i % 5), 1.0, 0.0] if i else [0.0, 0.0, 0.0]) for i in range(20)],
                                 "id int, embedding array<float>")
    queries = spark.createDataFrame([("zero", [0.0, 0.0, 0.0]), ("null", None), ("x", [1.0, 0.0, 0.0]), ("x", [0.0, 1.0, 0.0])],
                                    "query_id string, embedding array<float>")
    got = [tuple(r) for r in D.vector_search(docs, queries, k).orderBy("query_id", "rank").select(
        "query_id", "rank", "doc_id", "distance").collect()]
    n = min(k, 20)
    assert [g[0] for g in got] == ["x"] * n + ["zero"] * n
    assert [(g[1], g[2], g[3]) for g in got if g[0] == "zero"] == [(i + 1, i, 1.0) for i in range(n)]
    assert got[0][2] == 5 and got[0][3] == 0  # of the two vectors named x the smaller one counts


def test_two_builds_share_one_space_and_can_be_searched(spark, tmp_path):
    from cohortry.pipeline import search_collection

    path = str(tmp_path / "kb")
    abstracts = lambda *rows: spark.createDataFrame(rows, "source string, query string, text string")
    build_knowledge_base(spark, path, abstracts=abstracts(("a", "q", "seizure drug dose"), ("b", "q", "gene variant")), dim=32)
    again = build_knowledge_base(spark, path, abstracts=abstracts(("c", "q", "seizure drug dose"), ("a", "q", "seizure drug dose")), dim=32)
    rows = {r["metadata"]["source"]: r["embedding"] for r in again.collect()}
    assert again.count() == 3 and rows["a"] == rows["c"] != rows["b"]
    hits = search_collection(spark, path, {"one": "gene variant", "two": "drug seizure dose"}, 2).collect()
    first = {r["query_id"]: r["content"] for r in hits if r["rank"] == 1}
    assert first == {"one": "gene variant", "two": "seizure drug dose"}
    only = search_collection(spark, path, {"two": "drug"}, 5, {"source": "b"}).collect()
    assert [r["content"] for r in only] == ["gene variant"]
