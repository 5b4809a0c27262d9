"""Joins that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


HOT_ROWS = 1_000_000
HOT_KEYS = 1_000


def split_hot(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame | None, DataFrame]:
    """(rows of very frequent keys, all other rows); None if no key is that frequent.

    Adaptive execution splits a hot key only where both sides of a join come
    straight from a shuffle, which a side that was aggregated does not. So the
    at most HOT_KEYS most frequent keys with HOT_ROWS rows or more are looked
    up (one partial count over the key columns) and broadcast; what is left has
    no key with more than a thousandth of the rows or a million of them.
    """
    keys = list(keys)
    found = (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= HOT_ROWS)
        .orderBy(F.desc("__n")).limit(HOT_KEYS).select(*keys).dropna().collect()
    )
    if not found:
        return None, df
    hot = F.broadcast(df.sparkSession.createDataFrame(found, df.select(*keys).schema))
    return df.join(hot, keys, "left_semi"), df.join(hot, keys, "left_anti")


def fan_out_left_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """``left LEFT JOIN right`` where ``right`` may hold one key very often.

    The matched part is an inner join. Rows of hot keys on the right are not
    shuffled: the left rows of those keys are sent to them. The unmatched part
    is an anti join against the keys alone, collapsed before they are shuffled.
    """
    on = list(on)
    hot, cold = split_hot(right, on)
    matched = left.join(cold, on, "inner")
    if hot is not None:
        partners = left.join(F.broadcast(hot.select(*on).distinct()), on, "left_semi")
        matched = matched.unionByName(small_side(partners).join(hot, on, "inner").select(*matched.columns))
    missing = left.join(right.select(*on).distinct(), on, "left_anti")
    return matched.unionByName(missing, allowMissingColumns=True).select(*matched.columns)


def flag_repeated(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Add a boolean: this row's key occurs more than once.

    Keys are counted with a partial aggregate and only the repeated ones are
    joined back; ``count(*) over (partition by key)`` would sort all copies of
    a key in one task. Rows of hot keys are repeated by definition and are not
    joined at all. A text key is counted and compared by its 128-bit digest and
    length, so long texts are not shuffled as keys.
    """
    short = {f"__s{i}": _short(df, k) for i, k in enumerate(keys)}
    df = df.withColumns(short)
    hot, cold = split_hot(df, list(short))
    flagged = _flag_by_count(cold, list(short), flag)
    if hot is not None:
        flagged = flagged.unionByName(hot.withColumn(flag, F.lit(True)).select(*flagged.columns))
    return flagged.drop(*short)


def _short(df: DataFrame, key: str) -> Column:
    if not isinstance(df.schema[key].dataType, T.StringType):
        return F.col(key)
    digest = F.struct(F.md5(F.col(key)).alias("digest"), F.length(key).alias("length"))
    return F.when(F.col(key).isNotNull(), digest)


def _flag_by_count(df: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    repeated = (
        df.filter(complete)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > 1)
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.lit(True).alias(flag))
    )
    match = F.lit(True)
    for i, key in enumerate(keys):
        match = match & (F.col(key) == F.col(f"__k{i}"))
    joined = df.join(repeated, match, "left")
    return joined.drop(*[f"__k{i}" for i in range(len(keys))]).withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def within(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has at most ``rows`` rows; reads no more than that + 1."""
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` as a broadcast local table if it has at most ``rows`` rows, else ``df`` itself.

    Reads ``rows`` + 1 rows at most to find out; a larger table is left to a
    shuffle join.
    """
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema))


def counted_side(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` marked to be broadcast if it has at most ``rows`` rows, else to be shuffled and sorted.

    For a side whose size Spark misjudges: a stored table is many times as
    large in memory, and what ``explode`` adds is not in the estimate. The
    driver holds all of a broadcast table.
    """
    return F.broadcast(df) if within(df, rows) else df.hint("merge")
