"""Warehouse tables: bulk load, prediction sink, model registry."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry import schemas
from cohortry.operators.join import resolve_keys, surrogate

COPY_BLOCK = 10_000


def explode_treatments(df: DataFrame, value: str = "previous_treatments", sep: str = ";",
                       name: str = "treatment_name") -> DataFrame:
    """One row per list item, trimmed; null and empty lists give no row, empty items stay."""
    return _list_items(df, value, sep, name).drop("position")


def _list_items(df: DataFrame, value: str, sep: str, name: str) -> DataFrame:
    items = F.split(F.col(value), "\\Q" + sep + "\\E", -1)
    given = df.filter(F.coalesce(F.col(value), F.lit("")) != "")
    return given.select("*", F.posexplode(items).alias("position", name)).withColumn(
        name, F.regexp_replace(name, r"^\s+|\s+$", "")
    )


def number_copies(df: DataFrame, name: str = "copy") -> DataFrame:
    """Number identical rows 1..n, so that each can get an id of its own.

    Copies are counted, not sorted, and written out where they were counted; only
    those of a row with very many copies are in blocks spread over the tasks.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    few = counted.filter(F.col("__n") <= COPY_BLOCK).withColumn(name, F.explode(F.sequence(F.lit(1).cast("bigint"), "__n")))
    last = F.floor((F.col("__n") - 1) / F.lit(COPY_BLOCK)).cast("bigint")
    blocks = counted.filter(F.col("__n") > COPY_BLOCK).withColumn(
        "__block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    spread = blocks.repartition(*df.columns, "__block")
    start = F.col("__block") * COPY_BLOCK + 1
    stop = F.least(F.col("__n"), start + COPY_BLOCK - 1)
    many = spread.withColumn(name, F.explode(F.sequence(start, stop))).drop("__block")
    return few.unionByName(many).drop("__n")


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Declared columns in order and type; absent ones become null."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def warehouse_tables(clinical: DataFrame, genetic: DataFrame | None, created: Column) -> dict[str, DataFrame]:
    """Patients, clinical data, treatments and variants with surrogate keys.

    ``clinical`` has one row per patient, as the unique rule demands; variants
    of unknown patients are left out. Ids are hashes of the row (equal variant
    rows are numbered), so a second load of the same file gives the same ids.
    """

    def row_id(df: DataFrame) -> Column:
        return F.sha2(F.to_json(F.struct(*df.columns)), 256)

    patients = clinical.select(
        surrogate("patient_id").alias("id"), "patient_id", "age", "sex",
        created.alias("created_at"), created.alias("updated_at"),
    )
    keys = patients.select("id", "patient_id")
    known = resolve_keys(clinical, keys, "patient_id", "id")
    records = known.drop("age", "sex")
    treatments = _list_items(known, "previous_treatments", ";", "treatment_name").select(
        "patient_id", "position", "treatment_name", F.col("treatment_response").alias("response"))
    out = {
        "patients": patients,
        "clinical_data": records.withColumns({"id": row_id(records), "created_at": created, "updated_at": created}),
        "treatments": treatments.withColumns({"id": row_id(treatments), "created_at": created}),
    }
    if genetic is not None:
        # rows are matched and counted under the natural key, a quarter as long as the surrogate that follows from it
        variants = number_copies(resolve_keys(genetic, keys, "patient_id", "patient_id")).withColumn(
            "patient_id", surrogate("patient_id"))
        out["genetic_variants"] = variants.withColumns({"id": row_id(variants), "created_at": created})
    return {name: _conform(df, schemas.WAREHOUSE[name]) for name, df in out.items()}


def load_warehouse(base: str, clinical: DataFrame, genetic: DataFrame | None, created: Column,
                   mode: str = "error") -> list[str]:
    """Write the tables below ``base`` as parquet; returns their names."""
    tables = warehouse_tables(clinical, genetic, created)
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{base}/{name}")
    return list(tables)


def read_warehouse(spark: SparkSession, base: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schemas.WAREHOUSE[name]).parquet(f"{base}/{name}") for name in names}


def create_table(spark: SparkSession, name: str, base: str | None = None) -> None:
    """Create an empty warehouse table in the catalog, at ``base`` if given."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.WAREHOUSE[name].fields)
    location = f" LOCATION '{base}/{name}'" if base else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({fields}) USING parquet{location}")


def prediction_rows(scored: DataFrame, model_version: str, created: Column) -> DataFrame:
    """Scored rows in the shape of the predictions table."""
    explanation = F.col("explanation") if "explanation" in scored.columns else F.lit(None)
    rows = scored.select(
        "patient_id", F.lit(model_version).alias("model_version"), "predicted_treatment",
        "response_probability", "confidence", explanation.cast("string").alias("explanation"),
        created.alias("created_at"),
    )
    key = F.concat_ws("|", "patient_id", "model_version", F.col("created_at").cast("string"))
    return _conform(rows.withColumn("id", surrogate(key)), schemas.WAREHOUSE["predictions"])


def write_predictions(rows: DataFrame, path: str) -> None:
    """Append, partitioned by day, so that the recent-days report reads recent folders only.

    The rebalance hint gathers each day into few files and splits a day that is too large for one task.
    """
    dated = rows.withColumn("created_date", F.to_date("created_at"))
    dated.hint("rebalance", "created_date").write.mode("append").partitionBy("created_date").parquet(path)


def model_metadata(spark: SparkSession, version: str, model_type: str, metrics: Mapping, params: Mapping,
                   n_samples: int, features: list[str], active: bool = True) -> DataFrame:
    row = spark.createDataFrame(
        [(version, model_type, json.dumps(dict(metrics)), json.dumps(dict(params)), int(n_samples),
          json.dumps(features), active)],
        "version string, model_type string, metrics string, hyperparameters string, dataset_size bigint, "
        "feature_names string, is_active boolean",
    )
    now = F.current_timestamp()
    return _conform(
        row.withColumns({"id": surrogate("version"), "training_date": now, "created_at": now}),
        schemas.WAREHOUSE["model_metadata"],
    )


def append_model_metadata(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def model_info(spark: SparkSession, path: str) -> DataFrame:
    """The newest active model."""
    registry = spark.read.schema(schemas.WAREHOUSE["model_metadata"]).parquet(path)
    return registry.filter("is_active").orderBy(F.desc("created_at"), F.desc("version")).limit(1)
