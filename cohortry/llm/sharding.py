"""Random shards by a two-pass external shuffle.

Pass one scatters the records over buckets that fit in a task's memory, by a
seeded hash. Pass two shuffles each bucket (Spark's ``shuffle`` function is a
Fisher-Yates shuffle by a seeded Mersenne twister) and writes it. The buckets
one behind the other are a random order of all records; shards are equal
stretches of it, so their row counts differ by one at most.

DataFrame functions only: records stay in the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import stored

BUCKET_BYTES = 32 << 20  # text bytes of a bucket, about; held by one task together with a copy or two
RECORD_BYTES = 64        # counted for a record beside its text
RUN = 1024               # buckets whose starting places are added up together
BUCKET, PLACE, RECORD, ORDER = "__bucket", "__place", "__record", "__order"


def size_of(text: str) -> Column:
    """UTF-8 bytes and one for the end of the record; a null text has none."""
    return (F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 1).cast("long")


def bucket_total(docs: DataFrame, text: str, bucket_bytes: int) -> int:
    whole = docs.agg(F.sum(size_of(text) + RECORD_BYTES)).first()[0]
    return max(1, math.ceil((whole or 0) / bucket_bytes))


def scatter(docs: DataFrame, buckets: int, seed: int, columns: list[Column]) -> DataFrame:
    """Pass one: each record, with its random order in the bucket, goes to the task of its bucket.

    The hash takes in a number that each row of a task has for itself: copies
    of a row, and rows of one key, are spread like any others. 64 bits of hash
    order a bucket before it is shuffled, so that its order does not depend on
    when records arrive.
    """
    row = F.monotonically_increasing_id()
    marked = docs.select(F.struct(*columns).alias(RECORD), row.alias("__row"))
    hashed = marked.select(RECORD, F.xxhash64(F.lit(seed), "__row").alias(ORDER), F.xxhash64(F.lit(seed + 1), "__row").alias("__to"))
    bucket = F.pmod(F.col("__to"), F.lit(buckets)).cast("int").alias(BUCKET)
    return hashed.select(bucket, ORDER, RECORD).repartitionById(buckets, F.col(BUCKET))


def shuffle_buckets(scattered: DataFrame, seed: int) -> DataFrame:
    """Pass two: (bucket, place, record), each bucket's places from 0 in shuffled order.

    A bucket is one task's only group, so its generator starts at ``seed`` plus its number.
    """
    records = F.array_sort(F.collect_list(F.struct(ORDER, RECORD))).alias("all")
    ordered = scattered.groupBy(BUCKET).agg(records)
    shuffled = ordered.select(BUCKET, F.shuffle("all", F.lit(seed)).alias("all"))
    return shuffled.select(BUCKET, F.posexplode("all").alias(PLACE, "one")).select(BUCKET, PLACE, F.col(f"one.{RECORD}").alias(RECORD))


def starting_places(written: DataFrame) -> DataFrame:
    """(bucket, rows before it in all buckets, rows in all): added up within runs of buckets, then over the runs."""
    counts = written.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("__n")).withColumn("__run", F.floor(F.col(BUCKET) / RUN))
    runs = counts.groupBy("__run").agg(F.sum("__n").alias("__run_n"))
    before = Window.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("__run", F.coalesce(F.sum("__run_n").over(before), F.lit(0)).alias("__before"),
                       F.sum("__run_n").over(Window.partitionBy()).alias("__rows"))
    inside = Window.partitionBy("__run").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__inside", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(runs, "__run").select(
        BUCKET, (F.col("__before") + F.col("__inside")).alias("__start"), "__rows")


def shuffled_shards(docs: DataFrame, shards: int = 8, seed: int = 20, text: str = "text",
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(columns of ``docs``, shard, slot): every row once, in random order over ``shards`` shards.

    Law ``rows``: shards 0, 1, .. are stretches of the shuffled order with row
    counts at most one apart (with fewer rows than shards, some are empty);
    ``slot`` counts a shard's rows from 0. Rows with null keys or texts, and
    repeated rows, are records like any others. Columns of ``docs`` may have
    any names; one named shard or slot is replaced. ``docs`` should be a stored
    table: a task that runs again must see the rows of its split in the same
    order. A very long text makes its bucket as large as itself.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    buckets = bucket_total(docs, text, bucket_bytes)
    written = stored(shuffle_buckets(scatter(docs, buckets, seed, columns), seed), "shuffled")
    starts = stored(starting_places(written), "starts")
    position = F.col("__start") + F.col(PLACE)
    placed = written.join(starts, BUCKET).select(RECORD, position.alias("__at"), "__rows")
    small, larger = F.expr(f"__rows div {shards}"), F.col("__rows") % shards  # the first `larger` shards have one row more
    in_larger = F.expr(f"__at div (__rows div {shards} + 1)")
    after_larger = larger + F.expr(f"(__at - (__rows % {shards}) * (__rows div {shards} + 1)) div greatest(__rows div {shards}, 1)")
    shard = F.when(F.col("__at") < larger * (small + 1), in_larger).otherwise(after_larger)
    slot = F.col("__at") - (F.col("__shard") * small + F.least(F.col("__shard"), larger))
    return placed.withColumn("__shard", shard).select(
        F.col(f"{RECORD}.*"), F.col("__shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard (``shard=0`` ..), rows with their slots. Each task adds its stretch's file to its shard."""
    placed.write.partitionBy("shard").parquet(path)


def digest(placed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Size, checksum and place of every record. No shard is added later under law ``rows``."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return placed.select(
        key, size_of(text).alias("size"), F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
