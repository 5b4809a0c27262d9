"""Global order without a single-partition window.

A running total over a whole table, written as ``sum() over (order by v)``,
moves every row to one task. Here the value range is first cut into buckets
that keep the order; a bucket's offset comes from the (small) table of bucket
totals, and only the rows inside one bucket are sorted together.

Bucket bounds come from a sample chosen by the hash of the value, so they do
not depend on task timing: a task that is run again sees the same bounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.plans.skew import small_side

SAMPLES_PER_BUCKET = 8
HASH_RANGE = 1 << 40

BUCKET = "__bucket"
_GROUP = "__group"


def _fan(df: DataFrame) -> int:
    """fan * fan buckets, about one per shuffle partition, 64 at least.

    A bucket is found in two steps of fan - 1 comparisons. The result of a
    running total does not depend on the number of buckets, which follows the
    cluster's setting without a bound.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, math.ceil(math.sqrt(width)))


def _bounds(df: DataFrame, value: str, measures: Sequence[str], group: Sequence[str], fan: int) -> DataFrame:
    """Per group: totals, fan-1 coarse bounds and fan lists of fan-1 fine bounds.

    The sample carries a measure along although only its values are used: all
    readers of ``df`` then need the same columns, and Spark runs the shuffle
    behind ``df`` once for all of them.
    """
    sizes = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("__size"), *[F.sum(m).alias(f"total_{m}") for m in measures]
    )
    point = F.pmod(F.xxhash64(value), F.lit(HASH_RANGE)) / F.lit(float(HASH_RANGE))
    sample = (
        df.join(F.broadcast(sizes), list(group))
        .filter(point * F.col("__size") < SAMPLES_PER_BUCKET * fan * fan)
        .groupBy(*group, "__size", *[f"total_{m}" for m in measures])
        .agg(F.sort_array(F.collect_list(F.struct(value, *measures))).alias("__pairs"))
        .withColumn("__sample", F.transform("__pairs", lambda pair: pair[value]))
    )

    def bound(position: Column) -> Column:
        index = F.floor(position * F.size("__sample") / F.lit(fan * fan)) + 1
        return F.element_at("__sample", index.cast("int"))

    steps = F.sequence(F.lit(1), F.lit(fan - 1))
    return sample.select(
        *group,
        *[f"total_{m}" for m in measures],
        F.transform(steps, lambda i: bound(i * fan)).alias("__coarse"),
        F.transform(
            F.sequence(F.lit(0), F.lit(fan - 1)),
            lambda hi: F.transform(steps, lambda lo: bound(hi * fan + lo)),
        ).alias("__fine"),
    )


def order_buckets(df: DataFrame, value: str, measures: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Add ``__bucket`` and the group's totals: v1 < v2 implies bucket(v1) <= bucket(v2)."""
    fan = _fan(df)
    joined = df.join(F.broadcast(_bounds(df, value, measures, group, fan)), list(group))
    hi = F.size(F.filter("__coarse", lambda b: b < F.col(value)))
    lo = F.size(F.filter(F.element_at("__fine", F.col("__hi") + 1), lambda b: b < F.col(value)))
    return (
        joined.withColumn("__hi", hi)
        .withColumn(BUCKET, F.col("__hi") * fan + lo)
        .drop("__coarse", "__fine", "__hi")
    )


def running_total(
    df: DataFrame, value: str, measures: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """Add ``run_<m>``, the sum of m over this and all smaller values of the group, and ``total_<m>``.

    ``df`` must hold each (group, value) once: collapse equal values first, so
    that a value shared by a third of all rows is one row here. The number of
    groups must be small (columns of a table, classes of a model): the offset
    table broadcast below has a row per group and bucket, about as many buckets
    as there are shuffle partitions.
    """
    source = df
    if not group:
        source = df.withColumn(_GROUP, F.lit(0))
        group = [_GROUP]
    group = list(group)
    bucketed = order_buckets(source, value, measures, group).repartition(*group, BUCKET)
    before = Window.partitionBy(*group).orderBy(BUCKET)
    # the largest value keeps the columns equal to those of the rows below, so
    # that one shuffle by bucket serves both
    totals = bucketed.groupBy(*group, BUCKET).agg(
        F.max(value).alias("__top"),
        *[F.sum(m).alias(f"__t_{m}") for m in measures],
        *[F.max(f"total_{m}").alias(f"__g_{m}") for m in measures],
    )
    offsets = totals.select(
        *group,
        BUCKET,
        "__top",
        *[f"__g_{m}" for m in measures],
        *[(F.sum(f"__t_{m}").over(before) - F.col(f"__t_{m}")).alias(f"__b_{m}") for m in measures],
    )
    inside = Window.partitionBy(*group, BUCKET).orderBy(value)
    summed = bucketed.withColumns({f"__r_{m}": F.sum(m).over(inside) for m in measures})
    out = summed.join(F.broadcast(offsets), [*group, BUCKET]).filter(F.col(value) <= F.col("__top"))
    out = out.withColumns({f"run_{m}": F.col(f"__b_{m}") + F.col(f"__r_{m}") for m in measures})
    extra = [f"{p}{m}" for m in measures for p in ("__b_", "__r_", "__g_")]
    return out.drop(BUCKET, _GROUP, "__top", *extra)


def dense_index(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """0..n-1 by sorted ``key``; ``key`` must be unique in ``df``."""
    ranked = running_total(df.withColumn("__one", F.lit(1).cast("long")), key, ["__one"])
    return ranked.withColumn(name, F.col("run___one") - 1).drop("__one", "run___one", "total___one")


def exact_quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """Interpolated quantiles, one row per column: (column, n, q0, q1, ...).

    ``percentile`` keeps every distinct value of a column in one task. Here
    equal values are collapsed with a partial count, and the two rows around
    each rank are picked from the running counts.
    """
    counts = value_counts_long(df, columns)
    placed = running_total(counts, "value", ["n"], ["column"]).withColumnRenamed("total_n", "total")

    first = F.col("run_n") - F.col("n")
    aggs = []
    for i, fraction in enumerate(fractions):
        position = F.lit(float(fraction)) * (F.col("total") - 1)
        for name, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            hit = (rank >= first) & (rank < F.col("run_n"))
            aggs.append(F.max(F.when(hit, F.col("value"))).alias(f"{name}{i}"))
    picked = placed.groupBy("column", "total").agg(*aggs)
    return picked.select(
        "column",
        F.col("total").alias("n"),
        *[
            (
                F.col(f"lo{i}")
                + (F.col(f"hi{i}") - F.col(f"lo{i}"))
                * (F.lit(float(q)) * (F.col("total") - 1) - F.floor(F.lit(float(q)) * (F.col("total") - 1)))
            ).alias(f"q{i}")
            for i, q in enumerate(fractions)
        ],
    )


def value_counts_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for non-null values of numeric columns, one scan."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return (
        doubles.unpivot([], list(columns), "column", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def hash_cuts(df: DataFrame, hashed: str, group: str, fractions: Sequence[float]) -> DataFrame:
    """(group, cuts): per fraction, the hash of the row at rank round(n * fraction).

    ``hashed`` is a hex digest. Its first digits give even buckets, 4096 or
    16 times as many as shuffle partitions and more; their counts tell which
    bucket holds a rank, and only the digests of those buckets are sorted,
    equal ones as one. A rank of 0
    gives the empty text, which no digest is below; a group with no other rank
    has no row here.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = max(3, math.ceil(math.log(width, 16)) + 1)
    rows = df.select(F.col(group).alias("g"), F.col(hashed).alias("h")).withColumn("b", F.substring("h", 1, digits))
    counts = rows.groupBy("g", "b").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("g").orderBy("b")
    placed = counts.withColumns({
        "end": F.sum("n").over(before),
        "total": F.sum("n").over(Window.partitionBy("g")),
    })
    ranks = [
        F.struct(F.lit(i).alias("i"), F.round(F.col("total") * F.lit(float(f))).cast("bigint").alias("rank"))
        for i, f in enumerate(fractions)
    ]
    wanted = placed.select("g", "b", "n", "end", F.inline(F.array(*ranks))).filter(
        (F.col("rank") <= F.col("end")) & (F.col("rank") > F.col("end") - F.col("n"))
    ).select(F.col("g").alias("wg"), F.col("b").alias("wb"), "i", (F.col("rank") - F.col("end") + F.col("n")).alias("nth"))
    narrow = rows.join(small_side(wanted), F.col("g").eqNullSafe(F.col("wg")) & (F.col("b") == F.col("wb")))
    copies = narrow.groupBy("g", "i", "nth", "h").agg(F.count(F.lit(1)).alias("copies"))
    reached = copies.withColumn("at", F.sum("copies").over(Window.partitionBy("g", "i").orderBy("h")))
    found = reached.filter((F.col("at") >= F.col("nth")) & (F.col("at") - F.col("copies") < F.col("nth")))
    listed = found.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("i", "h"))).alias("by_rank"))
    cuts = F.array(*[F.coalesce(F.try_element_at("by_rank", F.lit(i)), F.lit("")) for i in range(len(fractions))])
    return listed.select(F.col("g").alias(group), cuts.alias("cuts"))
