"""Session, lineage and scratch-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
# parquet looks at sizes after a hundred rows only: without these it holds a hundred blocks of megabytes as one page
SMALL_PAGES = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(1 << 24)}


_LOCAL_DIRS: dict[str, str] = {}  # application id -> folder, for local sessions without a setting


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  shared: str | None = None) -> SparkSession:
    """A single-machine session for tests and the benchmark.

    On a cluster the caller brings its own session; nothing in the package
    changes the session's configuration.
    """
    builder = SparkSession.builder
    if shared:
        builder = builder.config(CHECKPOINT_KEY, shared)
    spark = (
        builder.master(f"local[{cores}]")
        .appName("cohortry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and scratch tables.

    Read from ``spark.checkpoint.dir``. Only a local session without that
    setting gets a folder of its own: on a cluster a machine-local folder
    would be lost together with its machine.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_DIRS:
        _LOCAL_DIRS[application] = tempfile.mkdtemp(prefix="cohortry-")
    return _LOCAL_DIRS[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, never used twice."""
    return f"{shared_dir(spark)}/cohortry-scratch/{label}-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over the cores, or over its own partitions if it has more of them.

    For rows that are read many times: a table in one file, or with one row
    group, is otherwise read by one task each time.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, df.rdd.getNumPartitions()))


def cut_lineage(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    Lost executors cost no recomputation of what came before. As a parquet
    table it also has a known size, so that Spark can tell a small step (a
    frontier, a list of hits) from a large one when it plans the next join.
    A column ``block`` holds megabytes a row, and gets small pages.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.options(**(SMALL_PAGES if "block" in df.columns else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
