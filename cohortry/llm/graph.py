"""Connected components of an edge table, and filters on sets of keys that need not fit anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import stored

KEY_BITS = 1 << 20  # bits of the pre-filter; a larger set only lets more rows through


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge that is no root; root is the smallest node that can be reached.

    Turns the edges into stars by linking, in turn, the larger and the smaller
    neighbours of every node to its smallest one. Neighbours are never
    gathered: only their minimum is. Each round is stored; their number grows
    with the logarithm of the longest path. Nulls are no nodes.
    """
    x, y = F.col(a), F.col(b)
    star = stored(edges.where(x != y).select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u")).distinct(), "edges")
    before = None
    while True:
        both = star.unionByName(star.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = (both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct()
        lower = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (large.join(lower, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
                 .unionByName(lower.select("v", F.col("m").alias("u"))))
        star = stored(small.distinct(), "edges")
        mark = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return star.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = mark


def bit_table(rows: DataFrame, value: Column, size: int = KEY_BITS) -> DataFrame:
    """A stored row with ``size`` bits, whatever the number of rows; those at the hashes ``value`` are set."""
    words = (rows.select(F.pmod(value, F.lit(size)).alias("b"))
             .groupBy((F.col("b") / 64).cast("bigint").alias("id"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("w")))
    every = rows.sparkSession.range(0, size // 64, 1, 1)
    row = every.join(words, "id", "left").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0)).alias("w")))),
                    lambda s: s["w"]).alias("bits"))
    return stored(row, "bits")


def key_filter(keys: DataFrame, key: str) -> DataFrame:
    """The bit table of a set of keys: ``may_hold`` never misses one."""
    return bit_table(keys, F.xxhash64(key))


def may_hold(bits: DataFrame, value: Column, size: int = KEY_BITS) -> Column:
    """Whether the hash's bit is set; ``value`` is the hash of a key. A scalar subquery brings the one row of bits."""
    at = F.pmod(value, F.lit(size))
    word = F.get(bits.select("bits").scalar(), (at / 64).cast("int"))
    return F.getbit(word, (at % 64).cast("int")) == 1


def without_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key isn't among ``keys``; rows with a null key stay.

    Only rows that pass the pre-filter are shuffled, so a small set of keys
    costs little however wide the rows are.
    """
    found = stored(keys.select(key).where(F.col(key).isNotNull()).distinct(), "keys")
    hit = may_hold(key_filter(found, key), F.xxhash64(key)) & F.col(key).isNotNull()
    return df.where(~hit).unionByName(df.where(hit).join(found, key, "left_anti").select(*df.columns))
