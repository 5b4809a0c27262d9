"""File readers and writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Tab-separated fields of a variant line.
# ---------------------------------------------------------------------------
VCF_FIELDS = {"chrom": 0, "pos": 1, "ref": 3, "alt": 4, "qual": 5}
# ---------------------------------------------------------------------------


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header. Without a schema all columns are text: no extra pass to guess
    types, and the validation rules can report the values that do not parse."""
    reader = spark.read.option("header", True).option("multiLine", False)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_clinical(spark: SparkSession, source: str, partition_column: str | None = None,
                  bounds: tuple[int, int] | None = None, partitions: int = 8, table: str = "clinical_data") -> DataFrame:
    """Clinical CSV, or the relational table behind a Postgres URL.

    A whole-number column with its bounds splits the read of a table into
    ranges; without them one connection reads it all.
    """
    if source.startswith(("postgresql://", "jdbc:")):
        return read_jdbc(spark, source, table, partition_column, bounds, partitions)
    if "://" in source and not source.startswith(("file:", "hdfs:", "s3", "abfs", "gs:")):
        raise ValueError(f"unsupported source: {source}")
    return read_csv(spark, source)


def jdbc_options(url: str, table: str, partition_column: str | None = None,
                 bounds: tuple[int, int] | None = None, partitions: int = 8, fetch: int = 10_000) -> dict[str, str]:
    """Options of a JDBC read; with a partition column the read is split into ranges."""
    options = {
        "url": url if url.startswith("jdbc:") else f"jdbc:{url}",
        "dbtable": table,
        "fetchsize": str(fetch),
    }
    if partition_column:
        if bounds is None:
            raise ValueError("a partition column needs bounds")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 8) -> DataFrame:
    options = jdbc_options(url, table, partition_column, bounds, partitions)
    return spark.read.format("jdbc").options(**options).load()


def read_genetic(spark: SparkSession, path: str) -> DataFrame:
    """Variants by file suffix: VCF or CSV."""
    if path.endswith((".vcf", ".vcf.gz")):
        return read_vcf(spark, path)
    if path.endswith(".csv"):
        return read_csv(spark, path)
    raise ValueError(f"unsupported format: {path}")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """VCF files (a path or glob); the sample is the file's name without suffix."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    return parse_vcf(lines, F.regexp_replace("file_name", r"\.vcf(\.gz)?$", ""))


def parse_vcf(lines: DataFrame, sample: Column, value: str = "value") -> DataFrame:
    """Variant rows from text lines: comments skipped, '.' quality becomes null."""
    line = F.col(value)
    fields = F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), "\t", -1)
    parsed = lines.filter(~line.startswith("#") & (F.trim(line) != "")).select(
        fields.alias("f"), sample.alias("sample_id")
    )
    got = {name: F.try_element_at("f", F.lit(i + 1)) for name, i in VCF_FIELDS.items()}
    return parsed.select(
        got["chrom"].alias("chrom"),
        got["pos"].try_cast("int").alias("pos"),
        got["ref"].alias("ref"),
        got["alt"].alias("alt"),
        got["qual"].try_cast("double").alias("qual"),
        "sample_id",
    )


def image_stats(voxels: DataFrame, image: str, value: str, headers: DataFrame | None = None,
                zooms: Sequence[str] = ("dx", "dy", "dz")) -> DataFrame:
    """Per image: mean, population std, minimum, maximum, voxel count and volume.

    Volume is the voxel count times the voxel size of the image's header; an
    image without a header stays, with no volume.
    """
    stats = voxels.groupBy(image).agg(
        F.avg(value).alias("mean_intensity"),
        F.stddev_pop(value).alias("std_intensity"),
        F.min(value).alias("min_intensity"),
        F.max(value).alias("max_intensity"),
        F.count(F.lit(1)).alias("n_voxels"),
    )
    if headers is None:
        return stats
    size = F.col(zooms[0]) * F.col(zooms[1]) * F.col(zooms[2])
    return stats.join(headers.select(image, size.alias("__size")), image, "left").withColumn(
        "volume_cm3", F.col("__size") * F.col("n_voxels")
    ).drop("__size")


def annotate_variants(variants: DataFrame, samples: DataFrame, genes: DataFrame) -> DataFrame:
    """VCF rows as variant records (patient_id, gene, variant, variant_type, allele_frequency, clinvar_significance).

    ``samples``: (sample_id, patient_id). ``genes``: (chrom, pos, gene), and any
    of the last three columns. A row without a sample or gene keeps null there,
    which validation reports; no row is dropped.
    """
    named = variants.join(samples.select("sample_id", "patient_id"), "sample_id", "left")
    given = [c for c in ("gene", "variant_type", "allele_frequency", "clinvar_significance") if c in genes.columns]
    found = named.join(genes.select("chrom", "pos", *given), ["chrom", "pos"], "left")
    change = F.concat_ws("", "chrom", F.lit(":"), F.col("pos").cast("string"), "ref", F.lit(">"), "alt")
    missing = {"gene": "string", "variant_type": "string", "allele_frequency": "double", "clinvar_significance": "string"}
    return found.select(
        "patient_id", *[F.col(c) if c in given else F.lit(None).cast(kind).alias(c) for c, kind in missing.items()],
        change.alias("variant"))


def image_shape(voxels: DataFrame, image: str, axes: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """(image, shape): extent along each axis."""
    return voxels.groupBy(image).agg(F.array(*[F.max(a) + 1 for a in axes]).alias("shape"))


def read_modalities(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: read_csv(spark, f"{folder}/{name}.csv") for name in names}


def read_guidelines(spark: SparkSession, folder: str) -> DataFrame:
    """One row per *.txt file: (source, text)."""
    files = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; null fields are kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", multi_line)
    return reader.schema(schema).json(path) if schema else reader.json(path)


def tables(spark: SparkSession, folder: str, names: Sequence[str]) -> Mapping[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in names}
