"""How far the sources of a language are apart in their words: a sparse merge per pair of sources.

Each source's counts of the kept terms are arrays sorted by term id, cut into
blocks of ids. The arrays of two sources meet in one small task per unordered
pair and block (a co-group); a galloping intersection finds the shared ids, and
shared, one-sided and absent terms are priced for both directions at once.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import batch_of, map_batches, stored, text_or_empty

# a byte of a term: A-Z in lower case, a-z, or part of a code point from 80 on; any other byte is a space
SIGNS = bytes(c if c > 0x7F or chr(c).isalpha() else 0x20 for c in range(256)).lower()
LEAST_DOCUMENTS = 30
SMOOTHING = 5          # added to each count
UNIT = 1000            # shares are in units of UNIT ** 3
BLOCK_TERMS = 1 << 16  # terms of a block, about
CELLS = 64             # parts of a block whose terms are numbered apart
HELD_TERMS = 300_000   # (lang, source, term) entries that a worker holds before it hands them on
SLICE = 1 << 20        # bytes of a text that are cut into terms together
CHUNK = 64             # ids of the shorter array that gallop together
TOP = 50


def terms_of(text: bytes):
    """The terms of a UTF-8 text in lists; a long text is split slice by slice, no slice ending inside a term."""
    signs, at = text.translate(SIGNS), 0
    while at < len(signs):
        end = signs.find(b" ", at + SLICE) if at + SLICE < len(signs) else -1
        end = len(signs) if end < 0 else end
        yield signs[at:end].split()
        at = end


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, added up in the workers first.

    A row with an empty term, once per task and group, stands for the group
    itself, so that groups without terms are there too.
    """

    def each(batches, names):
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def handed():
            for (lang, source), (n, in_docs) in held.items():
                terms = pa.array([b"", *n], pa.binary()).cast(pa.string())
                # both counters met their terms in the same order
                columns = [pa.array([0, *n.values()], pa.int64()), pa.array([0, *in_docs.values()], pa.int64())]
                for at in range(0, len(terms), 50_000):
                    part = terms.slice(at, 50_000)
                    group = [pa.array([name] * len(part), pa.string()) for name in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*group, part, *(c.slice(at, 50_000) for c in columns)], schema=names)
            held.clear()

        entries = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, here = len(n), {}
                for terms in terms_of(text):
                    n.update(terms)
                    here.update(dict.fromkeys(terms))
                in_docs.update(list(here))
                entries += len(n) - before
                if entries >= HELD_TERMS:
                    yield from handed()
                    entries = 0
        yield from handed()

    rows = map_batches(docs, [text_or_empty(c) for c in ("lang", "source", "text")], each,
                       "lang string, source string, term string, n bigint, docs bigint")
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 (n + 5) / (total + 5 terms)) in whole numbers, three decimal digits at a time."""
    whole = total + SMOOTHING * terms
    digits, rest = F.lit(0).cast("long"), n + SMOOTHING
    for _ in range(3):
        step = rest * UNIT
        digits, rest = digits * UNIT + F.call_function("div", step, whole), step % whole
    return digits + 1


def shares(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """As ``share``; exact while totals are under 9 * 10**15."""
    whole = total + SMOOTHING * terms
    digits, rest = 0, np.asarray(n, np.int64) + SMOOTHING
    for _ in range(3):
        rest = rest * UNIT
        digits, rest = digits * UNIT + rest // whole, rest % whole
    return digits + 1


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both of the ids that two ascending arrays share.

    A chunk of the shorter array looks from where the last one ended: the step
    doubles until the long array has passed the chunk, then the chunk is
    searched in that stretch alone.
    """
    low, mine, theirs = 0, [], []
    for at in range(0, len(short), CHUNK):
        chunk = short[at:at + CHUNK]
        step, high = CHUNK, low
        while high < len(long) and long[high] < chunk[-1]:
            high, step = high + step, step * 2
        stretch = long[low:high + 1]
        place = np.searchsorted(stretch, chunk)
        inside = np.flatnonzero(place < len(stretch))
        hit = inside[stretch[place[inside]] == chunk[inside]]
        mine.append(hit + at)
        theirs.append(place[hit] + low)
        low += int(np.searchsorted(stretch, chunk[-1]))
    none = np.empty(0, np.int64)
    return np.concatenate([none, *mine]), np.concatenate([none, *theirs])


def distance(a: tuple, b: tuple, block_terms: int, terms: int) -> int:
    """Sum of |p - q| over a block's terms; ``a`` and ``b`` are (ids, counts, total of the source)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ids_a, n_a, total_a), (ids_b, n_b, total_b) = a, b
    in_a, in_b = gallop(ids_a, ids_b)
    p, q = shares(n_a, total_a, terms), shares(n_b, total_b, terms)
    p0, q0 = int(shares(np.zeros(1), total_a, terms)[0]), int(shares(np.zeros(1), total_b, terms)[0])
    one_sided = lambda own, shared, other: int(np.abs(np.delete(own, shared) - other).sum())
    absent = block_terms - len(ids_a) - len(ids_b) + len(in_a)
    return int(np.abs(p[in_a] - q[in_b]).sum()) + one_sided(p, in_a, q0) + one_sided(q, in_b, p0) + absent * abs(p0 - q0)


def _price(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """One pair and block: both sides hold one row, the source's array."""
    lang, _, one, other = (k.as_py() for k in key)
    read = lambda t: (np.asarray(t.column("ids").chunk(0).values), np.asarray(t.column("counts").chunk(0).values), t.column("total")[0].as_py())
    value = 0
    if left.column("terms")[0].as_py():
        value = distance(read(left), read(right), left.column("block_terms")[0].as_py(), left.column("terms")[0].as_py())
    return pa.table({"lang": [lang], "one": [one], "other": [other], "value": pa.array([value], pa.int64())})


def kept_counts(docs: DataFrame, least: int, block_terms: int) -> tuple[DataFrame, DataFrame]:
    """(counts of kept terms, groups).

    Counts: (lang, source, term, n, n_lang, block, cell, place, id). A term's
    hash gives its block and its cell in the block; the terms of a cell are
    numbered in term order from 0, and cell and number together are the id.
    Groups: every (lang, source) with its total, its language's total and kept
    terms.
    """
    counts = count_terms(docs)
    same_term = Window.partitionBy("lang", "term")
    sums = counts.withColumns({"n_lang": F.sum("n").over(same_term), "in_docs": F.sum("docs").over(same_term)})
    kept = stored(sums.where((F.col("term") == "") | (F.col("in_docs") >= least)).drop("docs", "in_docs"), "kept-terms")
    real = kept.where(F.col("term") != "")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = real.groupBy("lang").agg(F.sum("n").alias("total_lang"), F.count_distinct("term").alias("terms"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    groups = stored(groups.join(langs, "lang", "left").select("lang", "source", "total", zero("total_lang"), zero("terms")), "groups")
    blocks = stored(langs.select("lang", F.ceil(F.col("terms") / block_terms).cast("int").alias("blocks")), "blocks")
    in_cell = Window.partitionBy("lang", "block", "cell").orderBy("term")
    slot = F.pmod(F.xxhash64("term"), F.col("blocks") * CELLS)
    numbered = real.join(blocks, "lang").withColumns({"block": F.floor(slot / CELLS).cast("int"), "cell": (slot % CELLS).cast("int")}).withColumn(
        "place", F.dense_rank().over(in_cell) - 1).withColumn("id", F.shiftleft(F.col("cell").cast("long"), 32) + F.col("place")).drop("blocks")
    return stored(numbered, "numbered-terms"), groups


def pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language."""
    packed = counts.groupBy("lang", "block", "source").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("all"))
    arrays = packed.select("lang", "block", "source", F.col("all.id").alias("ids"), F.col("all.n").alias("counts"))
    cells = counts.groupBy("lang", "block", "cell").agg((F.max("place") + 1).cast("long").alias("n"))
    sizes = cells.groupBy("lang", "block").agg(F.sum("n").alias("block_terms"))
    places = stored(groups.join(sizes, "lang", "left").select(
        "lang", "source", "total", "terms", F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("block_terms", F.lit(0)).alias("block_terms")), "places")
    none = F.array().cast("array<bigint>")
    sides = stored(places.join(arrays, ["lang", "block", "source"], "left").select(
        *places.columns, F.coalesce(F.col("ids").cast("array<bigint>"), none).alias("ids"), F.coalesce("counts", none).alias("counts")), "sides")
    names = groups.select("lang", F.col("source").alias("partner"))
    paired = sides.join(names, "lang")
    carried = ["lang", "block", "total", "terms", "block_terms", "ids", "counts"]

    def side(order: str, **named: str) -> DataFrame:
        return paired.where(order).select(*[F.col(c).alias(c) for c in carried], *[F.col(c).alias(n) for n, c in named.items()])

    left, right = side("source < partner", one="source", other="partner"), side("source > partner", one="partner", other="source")
    key = ["lang", "block", "one", "other"]
    priced = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_price, "lang string, one string, other string, value bigint")
    values = priced.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    way = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("item"))
    both = F.inline(F.array(way("one", "other"), way("other", "one")))
    return values.select("lang", both, "value")


def term_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each kept term of a group with a greater share than in its language."""
    rows = counts.join(groups, ["lang", "source"])
    p = share(F.col("n"), F.col("total"), F.col("terms"))
    q = share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    return rows.where("n > 0").select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between sources, and each source's most overused terms.

    Null languages, sources and texts are empty strings; each row is a document
    of its own, repeated or not. A language without kept terms has distance 0
    between its sources; a lone source has no partner. Ties rank by item, in
    order of its UTF-8 bytes. Exact while a language has fewer than 9 * 10**15
    words. The columns read are ``lang``, ``source`` and ``text``. No task holds
    more than a block of two sources' arrays; the rows of the pair part are
    the ordered pairs of sources themselves.
    """
    counts, groups = kept_counts(docs, least, block_terms)
    by_rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    parts = [("pair", pair_values(counts, groups), None), ("term", term_values(counts, groups), top)]
    ranked = []
    for part, values, most in parts:
        rows = values.withColumn("rank", F.row_number().over(by_rank))
        rows = rows if most is None else rows.where(F.col("rank") <= most)
        ranked.append(rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank"))
    return reduce(DataFrame.unionByName, ranked)
