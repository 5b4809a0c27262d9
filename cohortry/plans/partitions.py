"""Tables kept in hash partitions, of which a change rewrites only those it touches."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.plans.session import cut_lineage

PARTITION = "__part"
PARTITIONS = 256
SPREAD = 4
LAYOUT = "_layout"


def partition_of(keys: Sequence[str], partitions: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(partitions)).cast("int")


def store_partitioned(df: DataFrame, path: str, keys: Sequence[str], partitions: int = PARTITIONS) -> None:
    """Write ``df`` as a new table at ``path``, one folder for each hash value of ``keys``.

    Keys, number of folders and schema are kept beside it in ``_layout``, which
    Spark's readers pass over, so that an empty table can be read too.
    """
    _write(df.withColumn(PARTITION, partition_of(keys, partitions)), path, keys, "errorifexists")
    layout = df.sparkSession.range(1).select(
        F.array(*[F.lit(k) for k in keys]).alias("keys"), F.lit(partitions).alias("partitions"),
        F.lit(df.schema.json()).alias("schema"))
    layout.coalesce(1).write.parquet(f"{path}/{LAYOUT}")


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], int]:
    layout = spark.read.parquet(f"{path}/{LAYOUT}").first()
    schema = T.StructType.fromJson(json.loads(layout["schema"]))
    return spark.read.schema(schema.add(PARTITION, T.IntegerType())).parquet(path), layout["keys"], layout["partitions"]


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path)[0].drop(PARTITION)


def rewrite_touched(spark: SparkSession, path: str, updates: DataFrame,
                    merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
    """Replace the partitions that hold keys of ``updates`` by ``merge(their rows, updates)``; gives their numbers.

    The rest of the table is neither read nor written. The updates are stored
    first, so that what decides the partitions and what is merged are the same
    rows. The new rows are stored as a whole before any folder of the table is
    replaced: the table is only ever replaced by a copy of stored rows, so a call
    that fails there can be made again with the same updates if merging them
    twice gives what merging them once does. One writer at a time. ``updates``
    has the key columns under the table's names. No updates: nothing is written.
    """
    table, keys, partitions = _read(spark, path)
    updates = cut_lineage(updates.withColumn(PARTITION, partition_of(keys, partitions)), "updates")
    touched = sorted(r[0] for r in updates.select(PARTITION).distinct().collect())  # at most ``partitions``
    if not touched:
        return []
    old = table.filter(F.col(PARTITION).isin(touched)).drop(PARTITION)
    merged = merge(old, updates.drop(PARTITION)).withColumn(PARTITION, partition_of(keys, partitions))
    _write(cut_lineage(merged.select(*table.columns), "staged"), path, keys, "overwrite")
    return touched


def _write(df: DataFrame, path: str, keys: Sequence[str], mode: str) -> None:
    """Up to SPREAD tasks write a folder, so that one of many rows isn't one task's work."""
    spread = df.repartition(PARTITION, F.pmod(F.hash(*keys), F.lit(SPREAD)))
    spread.write.option("partitionOverwriteMode", "dynamic").mode(mode).partitionBy(PARTITION).parquet(path)
