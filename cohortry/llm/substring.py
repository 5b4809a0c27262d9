"""Removal of long word passages that repeat across documents, by fixed-block anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import batch_of, map_batches, stored, text_or_empty
from cohortry.llm.graph import key_filter, may_hold

GRAM = 8                    # words hashed together for the pre-filter
CACHED_WORDS = 200_000
CACHED_LENGTH = 48
EMPTY = hashlib.sha256(b"").hexdigest()
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_WORDS: list["WordHashes"] = []


class WordHashes(dict):
    """word -> 64-bit hash, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


def hashes(words: list[bytes]) -> np.ndarray:
    if not _WORDS:
        _WORDS.append(WordHashes())
    return np.fromiter(map(_WORDS[0].__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """The hash of every ``n`` consecutive words, as unsigned numbers; doubles the width step by step."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    factor = int(_MIX[which])
    done, width, power = np.zeros(len(words) + 1, np.uint64), 0, 1
    part, size, lift = words, 1, factor
    with np.errstate(over="ignore"):
        while True:
            if n & size:  # put the next ``size`` words behind those done
                keep = len(words) - width - size + 1
                done = done[:keep] * np.uint64(lift) + part[width:width + keep]
                width += size
                power = power * lift % (1 << 64)
            if width == n:
                break
            part = part[:len(part) - size] * np.uint64(lift) + part[size:]
            lift, size = lift * lift % (1 << 64), size * 2
        done ^= done >> np.uint64(32)
        done *= _MIX[1 - which]
        return done ^ (done >> np.uint64(29))


def least_grams(words: np.ndarray, window: int) -> np.ndarray:
    """For every window: the smallest hash of the GRAM consecutive words in it. Equal windows have equal ones."""
    low, span, n = rolling(words, GRAM), 1, window - GRAM + 1
    if len(low) < n:
        return np.zeros(0, np.uint64)
    while 2 * span <= n:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    rest = n - span
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def split(text: str) -> list[bytes]:
    return text.encode().split()  # bytes: the six ASCII white-space signs


def digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _outline(body: DataFrame, window: int, kind: str) -> DataFrame:
    """(doc, n_words, sha, grams): the words' digest and the windows' smallest gram hashes, each once."""

    def each(batches, names):
        for batch in batches:
            rows = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = split(t)
                low = least_grams(hashes(words), window) if len(words) >= window else np.zeros(0, np.uint64)
                rows.append((doc, len(words), digest(words), np.unique(low).view(np.int64)))
            if rows:
                yield batch_of(names, list(zip(*rows)))

    return map_batches(body, ["doc", "text"], each, f"doc {kind}, n_words bigint, sha string, grams array<bigint>")


def _anchors(texts: DataFrame, kind: str, window: int) -> DataFrame:
    """(anchor, doc, at) of every rolling half window of words inside windows whose gram hash is shared."""
    block = window // 2

    def each(batches, names):
        for batch in batches:
            for doc, t, sha, shared in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = split(t)
                if digest(words) != sha:
                    continue  # another row of the same key
                words = hashes(words)
                low = least_grams(words, window)
                inside = _spread(np.isin(low, np.array(shared, np.int64).view(np.uint64)), window - block + 1)
                at = np.flatnonzero(inside)
                if len(at):
                    yield batch_of(names, [rolling(words, block)[at].view(np.int64), np.full(len(at), doc), at])

    return map_batches(texts, ["doc", "text", "sha", "shared"], each, f"anchor bigint, doc {kind}, at int")


def _spread(mask: np.ndarray, width: int) -> np.ndarray:
    """True for each place covered when every true place covers itself and the ``width`` - 1 after it."""
    count = np.zeros(len(mask) + width, np.int64)
    count[:len(mask)] += mask
    count[width:] -= mask
    return np.cumsum(count)[:len(mask) + width - 1] > 0


def _extensions(texts: DataFrame, kind: str, window: int) -> DataFrame:
    """(one, two, doc, at): 128 bits of every whole window that holds a hit half window."""
    reach = window - window // 2

    def each(batches, names):
        for batch in batches:
            for doc, t, sha, hits in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = split(t)
                if digest(words) != sha:
                    continue
                words, last = hashes(words), len(words) - window
                hits = np.array(hits)
                first, final = np.maximum(hits - reach, 0), np.minimum(hits, last)
                kept = first <= final
                steps = np.bincount(first[kept], minlength=last + 2) - np.bincount(final[kept] + 1, minlength=last + 2)
                at = np.flatnonzero(np.cumsum(steps)[:last + 1])
                if len(at):
                    one, two = rolling(words, window)[at], rolling(words, window, 1)[at]
                    yield batch_of(names, [one.view(np.int64), two.view(np.int64), np.full(len(at), doc), at])

    return map_batches(texts, ["doc", "text", "sha", "hits"], each, f"one bigint, two bigint, doc {kind}, at int")


def remove_repeats(docs: DataFrame, window: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256, removed): each row without words of passages that a smaller key has too.

    ``removed`` lists the ranges of words that go, (start, end). A word goes if
    it lies in ``window`` consecutive words that also occur in a row with a
    smaller key; windows are judged on the texts as given. A null text has no
    words. Rows are kept one for one, identical ones alike; a row with a null
    key is neither cut nor a source, and rows with equal keys don't cut each
    other. Of rows with one key and different words, the first by digest takes
    part; the others only go as a whole, if a smaller key has the same words.

    1. Rows with the same words are one: all but those of the smallest key go
       whole (if they have a window), and only these are looked at further.
    2. Equal windows have the same smallest hash of GRAM words. Rows that share
       such a hash with another row, and in them the windows that have it, go on.
    3. Non-overlapping blocks of half a window are the index; every rolling
       half window probes it. A window holds a whole block of any row it is
       shared with, so a hit at a smaller key comes with every repeat.
    4. Hits are extended on both sides: the whole windows around them and
       around the blocks they met are compared by 128-bit hashes, and a window
       is a repeat if the smallest key that has it is another one. Unions of
       these windows are the maximal exact repeats.
    """
    kind = docs.schema[key].dataType.simpleString()
    body = docs.select(F.col(key).alias("doc"), text_or_empty(text))
    outline = stored(_outline(body, window, kind), "outline")
    firsts = stored(
        outline.where((F.col("n_words") >= window) & F.col("doc").isNotNull())
        .groupBy("sha").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n")), "firsts")
    taking = firsts.groupBy("doc").agg(F.min("sha").alias("sha"))
    grams = outline.join(taking, ["doc", "sha"], "left_semi").select("doc", "sha", F.explode("grams").alias("gram"))
    # what rows are joined to by a key that may be very common is stored first: then Spark can split the key's rows
    shared = stored(grams.groupBy("gram").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
                    .where("low < high").select("gram"), "shared")
    flags = stored(grams.join(shared, "gram").groupBy("doc", "sha")
                   .agg(F.collect_set("gram").alias("shared")), "flags")
    near = _texts_of(body, flags)
    probes = stored(_anchors(near, kind, window), "probes")
    index = probes.where(F.col("at") % (window // 2) == 0)
    least = stored(index.groupBy("anchor").agg(F.min("doc").alias("low")), "least")
    hits = stored(probes.join(least, "anchor").where("low < doc").select("anchor", "doc", "at"), "hits")
    most = stored(hits.groupBy("anchor").agg(F.max("doc").alias("high")), "most")
    met = index.join(most, "anchor").where("doc < high")
    around = stored(hits.select("doc", "at").unionByName(met.select("doc", "at"))
                    .groupBy("doc").agg(F.collect_set("at").alias("hits"))
                    .join(flags.select("doc", "sha"), "doc"), "around")
    whole = stored(_extensions(_texts_of(body, around), kind, window), "windows")
    owners = stored(whole.groupBy("one", "two").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
                    .where("low < high").select("one", "two", "low"), "owners")
    repeats = stored(whole.join(owners, ["one", "two"]).where("low < doc")
                     .groupBy("doc").agg(F.collect_set("at").alias("starts"))
                     .join(flags.select("doc", "sha"), "doc"), "repeats")

    copies = firsts.where("n > 1").select("sha", F.col("doc").alias("first"))
    rows = (outline.drop("grams").join(copies, "sha", "left")
            .join(repeats.select("doc", "sha", F.lit(True).alias("partly")), ["doc", "sha"], "left"))
    gone = F.coalesce(F.col("first") < F.col("doc"), F.lit(False))
    ranges = "array<struct<start:bigint,end:bigint>>"
    all_words = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end")))
    plain = rows.where(gone | F.col("partly").isNull()).select(
        F.col("doc").alias(key), "n_words", F.when(gone, F.col("n_words")).otherwise(F.lit(0).cast("bigint")).alias("n_removed"),
        F.when(gone, F.lit(EMPTY)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(gone, all_words.cast(ranges)).otherwise(F.array().cast(ranges)).alias("removed"))
    return plain.unionByName(_cut(_texts_of(body, repeats), kind, window, key, ranges))


def _texts_of(body: DataFrame, some: DataFrame) -> DataFrame:
    """``some`` with the texts of its documents; only texts that pass the pre-filter are shuffled."""
    held = F.col("doc").isNotNull() & may_hold(key_filter(some, "doc"), F.xxhash64("doc"))
    return body.where(held).join(some, "doc")


def _cut(texts: DataFrame, kind: str, window: int, key: str, ranges: str) -> DataFrame:
    """The rows that lose some windows, from their start places."""

    def each(batches, names):
        for batch in batches:
            out = []
            for doc, t, sha, starts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = split(t)
                if digest(words) != sha:
                    continue
                mask = np.zeros(len(words) - window + 1, bool)
                mask[starts] = True
                goes = _spread(mask, window)
                kept = [w for w, g in zip(words, goes.tolist()) if not g]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], goes.astype(np.int8), [0]]))).reshape(-1, 2)
                out.append((doc, len(words), int(goes.sum()), digest(kept),
                            [{"start": int(s), "end": int(e)} for s, e in edges]))
            if out:
                yield batch_of(names, list(zip(*out)))

    return map_batches(texts, ["doc", "text", "sha", "starts"], each,
                       f"{key} {kind}, n_words bigint, n_removed bigint, kept_sha256 string, removed {ranges}")
