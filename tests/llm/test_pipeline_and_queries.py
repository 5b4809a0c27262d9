"""The pipeline against brute force, every query on the smallest tables, and the contract's shapes."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from cohortry.llm import language
from cohortry.llm.common import stored
from cohortry.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tools.check_oracle import connect

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op2": {"doc_id": "bigint", "item_id": "bigint"},
    "op3": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op4": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op6": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op7": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op8": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op9": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op10": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
    "op12": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op13": {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"},
}


def test_every_query_is_registered():
    assert sorted(q.split("_")[0] for q in QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    kinds = dict(df.dtypes)
    assert all(kinds[c] == t for c, t in COLUMNS[name.split("_")[0]].items())
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in ORACLES:
        con = connect(FOLDER)
        cursor = con.execute(ORACLES[name])
        assert [c[0] for c in cursor.description] == df.columns
        assert sorted(cursor.fetchall(), key=repr) == sorted(rows, key=repr)


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = language.train(docs.where(~language.held_out()))
    known = {r["doc_id"] for r in language.identify(docs, model).collect()
             if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    roots = brute.simhash_components([(i, texts[i]) for i in sorted(known)])
    kept = [i for i, (_, root) in roots.items() if i == root]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaked = {d for d, _ in brute.overlaps([(i, texts[i]) for i in kept], items)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i in sorted(set(kept) - leaked):
        text, at, pieces = texts[i], 0, []
        for _, start, end in sorted(brute.base_spans(text), key=lambda s: s[1:]):
            if start >= at:
                pieces += [text[at:start], "[SECRET]"]
            at = max(at, end)
        want[i] = [*library.encode("".join([*pieces, text[at:]]), add_special_tokens=False).ids, 2]
    got = defaultdict(list)
    for p in corpus_pipeline.run(spark, FOLDER).collect():
        got[p["doc_id"]].append(p)
    assert got.keys() == want.keys()
    for i, ids in want.items():
        at = 0
        for p in sorted(got[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(np.array(ids[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)


def test_stages_take_odd_rows(spark):
    long = "the of and to in that is was " * 3000
    english = "the thing and the other thing are in the house with that one "
    rows = [(1, english, "en", "s", 1), (1, english, "en", "s", 1), (2, english, "en", "s", 1), (3, None, "en", "s", 0),
            (4, "", "en", "s", 0), (None, english + "x", "en", "s", 1), (5, long, None, None, None), (6, "1234 %%%", "en", "s", 1),
            (7, english + "token = abcdefgh", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.selectExpr("*", "1 AS doc", "'b' AS bits", "2 AS fp")
    seen = {}
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, table, FOLDER)
            if name != "packing":
                assert after.columns == docs.columns
            table = stored(after, name)
            seen.setdefault(name, sorted(r["doc_id"] or 0 for r in table.select("doc_id").collect()))
    assert seen["language_id"] == [0, 1, 1, 2, 5, 7]
    assert seen["near_duplicates"][:2] == [0, 1] and 2 not in seen["near_duplicates"]
    assert table.count() == 0
