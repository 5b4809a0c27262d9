"""Token counts against the library; packing by an exact round trip."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortry.llm import packing, token_count

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "  a  b\tc\nd ", "the of and the of", "<s> </s> <unk> <|endoftext|>it's", "é ñ 漢字 😀\x00", "▁▁ a▁b",
         "x" * 5000, "ab " * 9000, "line\r\nline\x1cline\x85line line"]


@pytest.fixture(scope="module")
def rows(spark):
    extra = [(100 + i, t, "n", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*extra, extra[4], (None, "null key", "n", 1)],
                                 "doc_id bigint, text string, n_tokens string, seed int")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abthe .,\n\t▁éñ漢😀\x00<s>/0123́", max_size=60))
def test_counter_equals_library(text):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert token_count.counter(PIECES).count(text) == len(model.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abTHE .,\n\t'sdméÉİ漢😀\x00<|endoftext|>0123́\x1c\x85", max_size=60))
def test_word_ids_equal_library(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.word_ids(WORDS).ids(text), "<u4").tolist() == want


def test_token_counts(spark, rows):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted(token_count.token_counts(rows, PIECES, 4096).collect(), key=str)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 4096)
                   for r in rows.collect()), key=lambda r: str(r))
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == sorted(w for w in want if w[0] is not None)
    assert len(got) == len(TEXTS) + 2
    assert token_count.token_counts(rows.limit(0), PIECES, 4096).count() == 0


def test_packing_round_trip(spark, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    unique = rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).repartition(3)
    pieces = packing.pack(unique, WORDS, 4096, 2).collect()
    own, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        own[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    for r in unique.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(own[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at:at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 4096 and at & (at - 1) == 0  # a power of two: no padding
    assert packing.pack(rows.limit(0), WORDS, 4096, 2).count() == 0
    assert sum(p["doc_id"] is None for p in packing.pack(rows, WORDS, 4096, 2).collect()) >= 1


def test_level_choice_has_the_least_sum_of_squares():
    packer = packing.Packer(16, 0)
    rng = np.random.default_rng(3)
    for i, size in enumerate(rng.integers(1, 16, 300).tolist()):
        before = packer.counts.copy()
        packer._place((i, 0, b"\0" * 4 * size, size))
        total = lambda c: int((c[1:16] ** 2).sum())
        options = []
        for level in range(0, 16 - size + 1):
            if level == 0 or before[level]:
                after = before.copy()
                after[level] -= level > 0
                if level + size < 16:
                    after[level + size] += 1
                options.append(total(after))
        assert total(packer.counts) == min(options)
        assert packer.open == packer.counts[1:16].sum()
    packer.finish()
    assert not packer.open


def test_open_windows_stay_bounded(monkeypatch):
    monkeypatch.setattr(packing, "OPEN_WINDOWS", 8)
    packer = packing.Packer(64, 0)
    for i in range(500):
        packer.add(i, b"\1\0\0\0" * 40)  # two of them never fit in one window uncut
        assert packer.open <= 9
    packer.finish()
    assert sum(r[2] for r in packer.take()) == 500 * 40
