"""Set operations and table maintenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.validate import dedup_first
from cohortry.plans.partitions import rewrite_touched


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; columns a frame lacks become null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def distinct_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def upsert(target: DataFrame, updates: DataFrame, key: str, stamp: Column, order: Sequence[Column | str],
           created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """New state of ``target``: updates replace, new keys are added.

    ``updated_at`` is stamped on the rows an update touches and on new rows;
    ``created_at`` stays as it was. Several updates of one key: the first one by
    ``order`` wins, chosen before the join, so a target row is never doubled.
    """
    values = [c for c in target.columns if c not in (key, created, updated)]
    updates = dedup_first(updates, key, order)
    given = [c for c in values if c in updates.columns]
    incoming = updates.select(
        F.col(key).alias("__key"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__new_{c}") for c in given]
    )
    joined = target.withColumn("__old", F.lit(True)).join(incoming, F.col(key) == F.col("__key"), "full_outer")
    hit, old = F.col("__hit").isNotNull(), F.col("__old").isNotNull()
    out = [F.coalesce(F.col(key), F.col("__key")).alias(key)]
    for c in target.columns:
        if c == key:
            continue
        if c == created:
            out.append(F.when(old, F.col(c)).otherwise(stamp).alias(c))
        elif c == updated:
            out.append(F.when(hit, stamp).otherwise(F.col(c)).alias(c))
        elif c in given:
            out.append(F.when(hit, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out).select(*target.columns)


def upsert_stored(spark: SparkSession, path: str, updates: DataFrame, key: str, stamp: Column,
                  order: Sequence[Column | str], created: str = "created_at", updated: str = "updated_at") -> list[int]:
    """``upsert`` on a table of ``store_partitioned`` by ``key``: only partitions with a key of the updates are read and rewritten.

    Gives the numbers of those partitions. Target rows with a null key stay as they are.
    """
    return rewrite_touched(
        spark, path, updates, lambda old, new: upsert(old, new, key, stamp, order, created, updated))


def cascade_delete(tables: Mapping[str, DataFrame], root: str, keys: DataFrame,
                   links: Sequence[tuple[str, str, str, str]], root_key: str) -> dict[str, DataFrame]:
    """Delete keys from ``root`` and every row that depends on them.

    ``links``: (child, child column, parent, parent column), parents first.
    ``keys`` has the column ``root_key``.
    """
    out = dict(tables)
    gone = {root: tables[root].join(keys.select(root_key), root_key, "left_semi")}
    out[root] = tables[root].join(keys.select(root_key), root_key, "left_anti")
    for child, child_col, parent, parent_col in links:
        dead = gone[parent].select(F.col(parent_col).alias(child_col))
        gone[child] = out[child].join(dead, child_col, "left_semi")
        out[child] = out[child].join(dead, child_col, "left_anti")
    return out


def drop_collection(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
