"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import stored
from cohortry.llm.graph import bit_table, key_filter, may_hold, without_keys

# (mask, least and most words of the items it is for). 1: the word counts, 0: any word will do. By enumeration, whatever
# words of an overlap are replaced within SHARE, the masks for its item's length hit it (tests/llm counts every pattern).
LONGEST = (1 << 31) - 1
MASKS = (("111011", 8, LONGEST), ("11111", 8, LONGEST), ("11010011", 8, 15),
         ("1111", 5, 7), ("11101", 5, 7), ("11011", 5, 7), ("10111", 5, 7))
WINDOW = 20          # words of an overlap that are compared
SHARE = 0.8          # of them that must be equal, each at its place
LEAST_WORDS = 5      # shorter items are too common to be evidence
SEED_BITS = 1 << 22  # bits of the pre-filter over the benchmark's seeds


def word_hashes(text: Column) -> Column:
    """A 64-bit hash of each run of letters and digits, case ignored."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(words: Column, mask: str, number: int, used: Column | None = None) -> Column:
    """The hash of the mask's number and the words that count, at every place where the mask fits; none if not ``used``."""
    places = [i for i, sign in enumerate(mask) if sign == "1"]
    fits = F.size(words) - len(mask)
    applies = fits >= 0 if used is None else (fits >= 0) & used
    starts = F.when(applies, F.sequence(F.lit(0), fits)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(number), *[F.get(words, i + place) for place in places]))


def _masks(items: DataFrame) -> list[int]:
    """Places in MASKS of those that some item needs."""
    size = F.size("words")
    needed = items.agg(*[F.max(size.between(low, high)).alias(f"m{i}") for i, (_, low, high) in enumerate(MASKS)]).first()
    return [i for i in range(len(MASKS)) if needed[f"m{i}"]] or [0]


def _rows(table: DataFrame, keep: list[str], masks: list[int], own: bool) -> DataFrame:
    """(kept columns, place, seed) of every place of every row's ``words``; the mask is part of the seed.

    With ``own``, rows have seeds under the masks for their length only.
    """
    size = F.size(F.col("words"))
    every = F.concat(*[seeds(F.col("words"), MASKS[i][0], i, size.between(*MASKS[i][1:]) if own else None) for i in masks])
    exploded = table.select(*keep, F.size("words").alias("size"), every.alias("seeds")).select(
        *keep, "size", F.posexplode_outer("seeds").alias("place", "seed")).where("seed IS NOT NULL")
    # (without _outer the optimizer would compute the seeds again to drop empty arrays)
    place, before = F.col("place"), F.lit(0)
    for mask, low, high in (MASKS[i] for i in masks):  # the places of one mask come after those of the last
        place = F.when(F.col("place") >= before, F.col("place") - before).otherwise(place)
        count = F.greatest(F.col("size") - (len(mask) - 1), F.lit(0))
        before = before + (F.when(F.col("size").between(low, high), count).otherwise(0) if own else count)
    return exploded.select(*keep, place.alias("place"), "seed")


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
             item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, matched, compared): each document with each benchmark text it overlaps, and the best window.

    A seed is the hash of the words that a mask lets count. Where a document
    and a text share a seed, they are laid on each other at that place and
    compared word by word: some window of WINDOW words (the whole text, if
    shorter) must have SHARE of its words equal at their places, so replaced
    words are tolerated, wherever they are. Texts that occur more than once in the benchmark are
    one, named by their smallest id; those under LEAST_WORDS words are left
    out. Null texts are empty, rows with a null key are not reported, repeated
    rows are one. An empty table gives no rows.

    Seeds of documents are never shuffled as a whole: a bit table of the
    benchmark's seeds, of fixed size, lets through those that may match. What
    passes is joined by seed; documents with hits are hashed again to compare.
    """
    items = stored(
        benchmark.where(F.col(item).isNotNull())
        .select(F.col(item).alias("item"), word_hashes(F.coalesce(F.col(item_text).cast("string"), F.lit(""))).alias("words"))
        .where(F.size("words") >= LEAST_WORDS).groupBy("words").agg(F.min("item").alias("item")), "benchmark")
    masks = _masks(items)
    known = stored(_rows(items, ["item"], masks, own=True), "seeds")
    bits = bit_table(known, F.col("seed"), SEED_BITS)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashed = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), word_hashes(body).alias("words"))
    passed = _rows(hashed, ["doc"], masks, own=False).where(may_hold(bits, F.col("seed"), SEED_BITS))
    laid = stored(
        passed.withColumnRenamed("place", "at").join(known, "seed")
        .groupBy("doc", "item", (F.col("at") - F.col("place")).alias("shift")).agg(F.count(F.lit(1)).alias("hits")), "hits")
    held = may_hold(key_filter(laid, "doc"), F.xxhash64(key))
    again = docs.where(F.col(key).isNotNull() & held).select(F.col(key).alias("doc"), word_hashes(body).alias("words"))
    both = again.join(laid, "doc").join(items.withColumnRenamed("words", "wanted"), "item")
    ahead, behind = F.greatest(F.col("shift"), F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    length = F.least(F.size("words") - ahead, F.size("wanted") - behind)
    equal = F.zip_with(F.slice("wanted", behind + 1, length), F.slice("words", ahead + 1, length),
                       lambda a, b: F.when(a == b, 1).otherwise(0).cast("bigint"))
    size = F.least(F.lit(WINDOW), F.size("wanted"))
    full = F.expr(f"shiftleft(1L, least({WINDOW}, size(wanted))) - 1")

    def slide(state: Column, bit: Column) -> Column:  # the window's words as bits, and the most that were equal
        window = F.shiftleft(state["window"], 1).bitwiseOR(bit).bitwiseAND(full)
        return F.struct(window.alias("window"), F.greatest(state["most"], F.bit_count(window)).alias("most"))

    start = F.struct(F.lit(0).cast("bigint").alias("window"), F.lit(0).alias("most"))
    best = both.select("doc", "item", size.alias("compared"),
                       F.aggregate(equal, start, slide, lambda state: state["most"]).alias("matched"))
    return (best.groupBy(F.col("doc").alias(key), F.col("item").alias(item))
            .agg(F.max("matched").cast("bigint").alias("matched"), F.max("compared").cast("bigint").alias("compared"))
            .where(F.col("matched") >= F.ceil(F.col("compared") * F.lit(SHARE))))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows of documents that overlap the benchmark; rows with a null key stay."""
    return without_keys(docs, overlaps(docs, benchmark, key, text).select(key), key)
