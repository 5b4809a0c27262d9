"""Language identification by held-out accuracy and exact Viterbi; neighbours by recall against brute force."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import ann, language

FOLDER = "/root/testdata/sf0.001"
RUSSIAN = "все счастливые семьи похожи друг на друга каждая несчастливая семья несчастлива по своему"
GREEK = "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    more = spark.createDataFrame(
        [(10_000 + i, RUSSIAN if i % 2 else GREEK, "ru" if i % 2 else "el", "s", 1) for i in range(20)]
        + [(20_000, None, "en", "s", 1), (20_001, "", "en", "s", 1), (20_002, "123 $$$ 45", "en", "s", 1),
           (20_003, "the of and " * 20_000, None, "s", 1), (None, "the thing", "en", "s", 1)], rows.schema)
    return rows.unionByName(more).withColumn("score", F.lit("clash")).withColumn("t", F.lit(1))


def test_held_out_accuracy(docs):
    got = language.predict_held_out(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND doc_id < 20000").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    odd = {r["doc_id"]: r for r in got.where("doc_id >= 20000 OR doc_id IS NULL").collect()}
    assert {odd[i]["lang_pred"] for i in (20_000, 20_001, 20_002)} == {"und"} and odd[20_000]["score"] == 0
    assert odd[20_003]["lang_pred"] == "en" and odd[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_spans_and_scripts(spark, docs):
    model = language.train(docs)
    mixed = spark.createDataFrame([(1, f"{RUSSIAN} 12 {GREEK}"), (2, None), (3, "漢字 漢字")], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["start_word"], r["n_words"], r["lang"]) for r in language.spans(mixed, model).collect())
    n = len(RUSSIAN.split())
    assert got[:2] == [(1, 0, n, "ru"), (1, n + 1, len(GREEK.split()), "el")] and got[2][0] == 3


def test_script_of_most_letters(spark):
    rows = [(i, "the thing and the other", "en") for i in range(20)] + [(100 + i, "人人生而自由在尊严和权利上一律平等", "zh") for i in range(20)]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    mixed = spark.createDataFrame([(1, "A人人生而自由在尊严和权利上一律平等"), (2, "thing自")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify(mixed, model).collect()} == {1: "zh", 2: "en"}


def test_model_without_languages(spark, docs):
    model = language.train(docs.limit(0))
    got = language.identify(docs.limit(3), model).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)] * 3
    assert language.keep_known(docs.limit(3), model, 0.1).count() == 0
    assert language.predict_held_out(docs.limit(0)).count() == 0


def test_known_rows_stay(docs):
    kept = language.keep_known(docs, language.train(docs), 0.2)
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and {20_000, 20_001, 20_002} <= gone and len(gone) <= 5


FOREIGN = {
    "ru": RUSSIAN, "el": GREEK, "zh": "人人生而自由 在尊严和权利上一律平等 他们赋有理性和良心 并应以兄弟关系的精神相对待",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti essi sono dotati di ragione e di coscienza e "
          "devono agire gli uni verso gli altri in spirito di fratellanza",
    "pl": "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem "
          "i powinni postępować wobec innych w duchu braterstwa",
    "fi": "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja "
          "heidän on toimittava toisiaan kohtaan veljeyden hengessä",
    "junk": "qzjxv wkpvbq zzxkjq hgqwpz " * 30, "signs": "aGk4ZkQ5eFQxYlZuN0xwUjB3WWM1SHNHdThKZEVhMk1vWGk2S3FCdA" * 20,
}


def test_texts_of_no_learned_language_go(spark, docs):
    given = docs.where("lang IN ('de', 'en', 'es', 'fr')")
    model = language.train(given)
    rows = [(i, t) for i, t in enumerate(FOREIGN.values())] + [(100 + i, t * 20) for i, t in enumerate(FOREIGN.values())]
    foreign = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert language.keep_known(foreign, model, 0.2).count() == 0
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(foreign, model).collect()}
    assert [got[i] for i in range(3)] == [("und", 0.0)] * 3
    half = spark.createDataFrame([(1, f"the and of to in that is was for it {RUSSIAN}")], "doc_id bigint, text string")
    assert language.identify(half, model).first()["lang_pred"] == "und"  # most letters are of no learned script
    assert [(r["lang"], r["start_word"]) for r in language.spans(half, model).collect()] == [("en", 0), ("und", 10)]
    assert language.keep_known(given, model, 0.2).count() >= given.where("text rlike '\\\\pL'").count() - 2


def test_a_language_left_out_goes(docs):
    given = docs.where("lang IN ('de', 'en', 'es', 'fr')")
    long = given.where("length(text) > 300")
    for left in ("de", "en", "es", "fr"):
        model = language.train(given.where(f"lang <> '{left}'"))
        own = long.where(f"lang = '{left}'")
        assert language.keep_known(own, model, 0.2).count() <= 0.1 * own.count()


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    texts = [rng.normal(0, 6, (n, 3)) for n in (1, 2, 3, 5, 6, 7, 7)]
    for scores, path in zip(texts, language.viterbi(texts, 5.0)):
        value = lambda p: sum(scores[i, s] for i, s in enumerate(p)) - 5.0 * sum(a != b for a, b in itertools.pairwise(p))
        best = max(map(value, itertools.product(range(3), repeat=len(scores))))
        assert value(path) == pytest.approx(best)


def test_viterbi_without_the_language_that_is_best_in_all():
    paths = language.viterbi([np.array([[-8.0, 0, -30], [-8, -30, 0]])], 12.0)
    assert paths[0].tolist() == [1, 2]


def test_word_scores_do_not_depend_on_neighbours(docs):
    model = language.train(docs)
    alone = model.word_scores(["thing"])[0][0]
    among = model.word_scores(["der", "thing", "x" * 50_000, "éa", "..."])
    assert np.allclose(alone, among[0][1]) and among[1].tolist() == [3, 5, 50_000, 2, 0]


def brute(rows, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) and len(v) == 8:
            good[i] = min(good.get(i, list(v)), list(v))
    ids, x = np.array(sorted(good)), np.array([good[i] for i in sorted(good)], float)
    out = {}
    for q in ids[ids % 100 == 0]:
        apart = np.sqrt(((x - np.array(good[q], float)) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, apart)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(apart[j])) for j in order]
    return out


def search(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("part", F.lit("x"))
    found = {}
    for r in ann.search(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return found


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, (12, 8))
    return [(i, np.float32(centres[i % 12] + rng.normal(0, 1, 8)).tolist()) for i in range(n)]


def test_recall_and_order(spark):
    rows = vectors(3000)
    got, want = search(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    hits = [len({i for i, _, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want]
    assert np.mean(hits) >= 0.9
    for q, found in got.items():
        assert [r for _, _, r in found] == list(range(1, 11))
        assert [(s, i) for i, s, _ in found] == sorted((s, i) for i, s, _ in found)
        at = dict(rows)
        assert all(s == pytest.approx(np.linalg.norm(np.array(at[q], float) - np.array(at[i], float))) for i, s, _ in found)


def test_copies_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 2)
    monkeypatch.setattr(ann, "ROUTE_MASS", 2.0)  # every part: the result must be exact
    same = [1.0] * 8
    rows = vectors(600) + [(1000 + i, same) for i in range(400)] + [(5000, same), (5000, same), (5001, same), (5001, [0.5] * 8)]
    rows += [(6000, None), (6100, [0.0] * 8), (6200, [float("nan")] * 8), (6300, [1.0] * 7 + [float("inf")]), (None, same),
             (6400, [1.0] * 7 + [None]), (6500, [1.0] * 7), (6600, [])]
    got, want = search(spark, rows), brute(rows)
    assert {q: [i for i, _, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}
    assert [i for i, _, _ in got[1000]] == list(range(1001, 1011))


def test_few_rows(spark):
    rows = [(100, [1.0] * 8), (7, [2.0] * 8)]
    assert {q: [i for i, _, _ in f] for q, f in search(spark, rows).items()} == {100: [7]}
    assert search(spark, [(100, [1.0] * 8)]) == {} and search(spark, []) == {}


def test_cut_is_balanced():
    x = np.array([v for _, v in vectors(1000)])
    graph = ann.neighbour_graph(x, 10)
    label = ann.balanced_cut(graph, 12)
    assert np.bincount(label, minlength=12).max() <= np.ceil(np.ceil(1000 / 12) * ann.SLACK)
    assert np.mean(label[graph] == label[:, None]) > 0.8
