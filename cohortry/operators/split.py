"""Splits, folds, rank-weighted confidence and distribution comparison."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators.aggregate import moments
from cohortry.plans.ordered import hash_cuts, running_total
from cohortry.plans.skew import small_side

KS_TERMS = 100
NAMES = ("train", "val", "test")


def _seeded(key: str, seed: int) -> Column:
    return F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))


def _check(fractions: Sequence[float]) -> None:
    if abs(sum(fractions) - 1.0) >= 1e-6:
        raise ValueError("fractions must sum to 1")


def _cut_points(df: DataFrame, key: str, label: str | None, fractions: Sequence[float], seed: int) -> DataFrame:
    """Rows with their digest ``__h`` and the cut digests ``__cuts`` of their class.

    The cuts (one row per class) are found first and broadcast; the rows
    themselves are not moved.
    """
    source = df.withColumn("__h", F.md5(_seeded(key, seed)))
    source = source.withColumn("__class", F.col(label) if label else F.lit(0))
    cuts = small_side(hash_cuts(source, "__h", "__class", fractions)).select(
        F.col("__class").alias("__g"), F.col("cuts").alias("__cuts"))
    none = F.array(*[F.lit("") for _ in fractions])
    joined = source.join(cuts, F.col("__class").eqNullSafe(F.col("__g")), "left")
    return joined.withColumn("__cuts", F.coalesce("__cuts", none)).drop("__g", "__class")


def stratified_split(df: DataFrame, key: str, label: str | None = None,
                     fractions: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Add ``split``: exact shares (rounded) of every class, in the order of md5(key|seed).

    A row's part follows from its own digest and two cut points of its class,
    so assigning it needs no shuffle. Shares are exact if ``key`` identifies a
    row; copies of a key stay together.
    """
    _check(fractions)
    placed = _cut_points(df, key, label, [fractions[0], fractions[0] + fractions[1]], seed)
    digest, cuts = F.col("__h"), F.col("__cuts")
    name = F.when(digest <= cuts[0], NAMES[0]).when(digest <= cuts[1], NAMES[1]).otherwise(NAMES[2])
    return placed.withColumn("split", name).drop("__h", "__cuts")


def hash_split(df: DataFrame, key: str, fractions: Sequence[float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Add ``split`` by the key's md5 alone: no shuffle, approximate shares, copies stay together."""
    _check(fractions)
    point = F.conv(F.substring(F.md5(_seeded(key, seed)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    name = F.when(point < fractions[0], NAMES[0]).when(point < fractions[0] + fractions[1], NAMES[1])
    return df.withColumn("split", name.otherwise(NAMES[2]))


def parts(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The train, validation and test rows of a split table."""
    train, val, test = (df.filter(F.col("split") == n).drop("split") for n in NAMES)
    return train, val, test


def assign_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..k-1: equal runs of every class in the order of md5(key|seed).

    The folds of a class differ by one row at most, and assigning them needs no shuffle.
    """
    placed = _cut_points(df, key, label, [i / k for i in range(1, k)], seed)
    passed = F.filter("__cuts", lambda cut: F.col("__h") > cut)
    return placed.withColumn("fold", F.size(passed)).drop("__h", "__cuts")


def retrieval_confidence(hits: DataFrame, queries: DataFrame | None = None, query: str = "query_id",
                         rank: str = "rank", distance: str = "distance") -> DataFrame:
    """(query, confidence): mean of 1 - distance with weights 1/rank; 0 for queries without hits."""
    weight = F.lit(1.0) / F.col(rank)
    scored = hits.groupBy(query).agg(
        (F.sum(weight * (1 - F.col(distance))) / F.sum(weight)).alias("confidence")
    )
    if queries is None:
        return scored
    return queries.select(query).distinct().join(scored, query, "left").fillna(0.0, subset=["confidence"])


def kolmogorov_p(statistic: Column, n1: Column, n2: Column) -> Column:
    """Asymptotic two-sided p-value."""
    a, b = n1.cast("double"), n2.cast("double")
    x = F.sqrt(a * b / (a + b)) * statistic
    # two series for the same function: each converges fast on its side
    alternating = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * x * x),
    )
    theta = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)),
        F.lit(0.0),
        lambda acc, j: acc + F.exp(-((2 * j - 1) * (2 * j - 1)) * F.lit(math.pi**2) / (8 * x * x)),
    )
    small = 1 - F.lit(math.sqrt(2 * math.pi)) / x * theta
    p = F.when(x < 1e-3, F.lit(1.0)).when(x < 1.0, small).otherwise(alternating)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def compare_distributions(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column in both tables: means, sample stds, KS statistic, asymptotic p, p < 0.05.

    Equal values are collapsed to (column, value, n1, n2) before they are put
    in order, and the two distribution functions are running totals.
    """
    shared = [c for c in columns if c in a.columns and c in b.columns]
    if not shared:
        return a.sparkSession.createDataFrame(
            [], "column string, df1_mean double, df2_mean double, df1_std double, df2_std double, "
                "ks_statistic double, p_value double, distributions_differ boolean")

    def long(df: DataFrame, first: int) -> DataFrame:
        doubles = df.select(*[F.col(c).cast("double").alias(c) for c in shared])
        return (
            doubles.unpivot([], shared, "column", "value")
            .filter(F.col("value").isNotNull())
            .withColumns({"n1": F.lit(first).cast("bigint"), "n2": F.lit(1 - first).cast("bigint")})
        )

    collapsed = (
        long(a, 1).unionByName(long(b, 0)).groupBy("column", "value")
        .agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
    )
    ranked = running_total(collapsed, "value", ["n1", "n2"], ["column"]).withColumnsRenamed(
        {"total_n1": "t1", "total_n2": "t2"})
    gap = F.abs(F.col("run_n1") / F.col("t1") - F.col("run_n2") / F.col("t2"))
    statistic = ranked.groupBy("column", "t1", "t2").agg(F.max(gap).alias("ks_statistic"))
    tested = statistic.withColumn("p_value", kolmogorov_p(F.col("ks_statistic"), F.col("t1"), F.col("t2")))

    def summary(df: DataFrame, name: str) -> DataFrame:
        return moments(df, shared).select("column", F.col("mean").alias(f"{name}_mean"), F.col("std").alias(f"{name}_std"))

    return (
        tested.join(F.broadcast(summary(a, "df1")), "column").join(F.broadcast(summary(b, "df2")), "column")
        .select("column", "df1_mean", "df2_mean", "df1_std", "df2_std", "ks_statistic", "p_value",
                (F.col("p_value") < 0.05).alias("distributions_differ"))
    )
