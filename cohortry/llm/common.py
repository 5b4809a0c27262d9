"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cohortry.plans.session import cut_lineage

ROWS_AT_ONCE = 256  # rows of a batch that are turned into Python objects together


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared folder; lost executors cost no more than what follows it."""
    return cut_lineage(df, f"llm-{label}")


def map_batches(df: DataFrame, columns: Sequence,
                each: Callable[[Iterator[pa.RecordBatch], pa.Schema], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``each`` over the Arrow batches of the named columns, sliced to a bounded number of rows.

    It gets the Arrow schema of what it must yield too.
    """
    names = to_arrow_schema(T._parse_datatype_string(schema))
    owner = each.__module__

    def run(batches):
        kept_tables(owner)
        return each(_slices(batches), names)

    return df.select(*columns).mapInArrow(run, schema)


_KEPT: dict[str, dict] = {}


def kept_tables(owner: str) -> dict:
    """What ``owner`` keeps in this Python worker from task to task.

    Workers outlive a job, so what other owners kept is let go, and Arrow's
    unused memory given back: one stage takes no memory in the next.
    """
    for other in [name for name in _KEPT if name != owner]:
        del _KEPT[other]
    pa.default_memory_pool().release_unused()
    return _KEPT.setdefault(owner, {})


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def batch_of(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def bucket_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
