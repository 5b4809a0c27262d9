"""Modality registry and the end-to-end jobs."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry import schemas
from cohortry.functions.text import recursive_chunks
from cohortry.ml.ensemble import EnsembleClassifier, EnsembleModel
from cohortry.ml.members import default_members
from cohortry.ml.tuning import cross_validate, parzen_search
from cohortry.operators import documents, encode
from cohortry.operators.aggregate import aggregate_variants
from cohortry.operators.features import feature_target, treatment_counts
from cohortry.operators.join import merge_modalities
from cohortry.operators.maintain import union_sources
from cohortry.operators.split import parts, stratified_split
from cohortry.operators.validate import (
    CLINICAL_RULES, GENETIC_RULES, Processed, RuleSet, dedup_first, process,
)
from cohortry.plans.session import cut_lineage
from cohortry.sources import files, warehouse


@dataclass(frozen=True)
class Modality:
    """How one kind of source is read, validated and transformed."""

    reader: Callable[[SparkSession, str], DataFrame]
    rules: RuleSet
    transform: Callable[[DataFrame], DataFrame]
    row_key: str = "patient_id"


def transform_clinical(df: DataFrame) -> DataFrame:
    """Derived columns, codes and scaled numbers of the clinical table."""
    out = df.withColumns({
        "years_since_onset": F.col("age") - F.col("age_at_onset"),
        "seizure_burden": F.col("seizure_frequency_per_month") * F.col("epilepsy_duration_years") * 12,
    })
    out = treatment_counts(out, empty_as_one=True)
    out = encode.label_encode(out, "sex", "seizure_type", "treatment_response")
    scaled = ["age", "seizure_frequency_per_month", "epilepsy_duration_years", "seizure_burden"]
    return encode.standard_scale(out, scaled)


ROW_ORDER = ["__file", "__block", "__row"]


def read_imaging(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows with their place: file, start of the block read, and running number inside it."""
    return files.read_csv(spark, path).withColumns({
        "__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"),
        "__row": F.monotonically_increasing_id()})


def transform_imaging(df: DataFrame) -> DataFrame:
    """First row per patient in the order of the files, and the scaled mean intensity if there is one.

    Rows without a place (not from :func:`read_imaging`) are ordered by their values.
    """
    order = ROW_ORDER if set(ROW_ORDER) <= set(df.columns) else df.columns
    out = dedup_first(df, "patient_id", order).drop(*ROW_ORDER)
    return encode.standard_scale(out, ["mean_intensity"]) if "mean_intensity" in df.columns else out


IMAGING_RULES = RuleSet(schema=schemas.IMAGING)

_REGISTRY: dict[str, Modality] = {
    "clinical": Modality(files.read_clinical, CLINICAL_RULES, transform_clinical),
    "genetic": Modality(files.read_genetic, GENETIC_RULES, aggregate_variants),
    "neuroimaging": Modality(read_imaging, IMAGING_RULES, transform_imaging),
}


def register_modality(name: str, modality: Modality) -> None:
    _REGISTRY[name] = modality


def process_all(spark: SparkSession, sources: Mapping[str, str], samples: DataFrame | None = None,
                genes: DataFrame | None = None) -> dict[str, Processed]:
    """Read, validate and transform every source; unknown names warn and are skipped.

    Variants from VCF files name a sample and a position: ``samples`` and
    ``genes`` (see :func:`files.annotate_variants`) give them patient and gene.
    Without those the absent columns are reported and nothing is transformed.
    """
    out: dict[str, Processed] = {}
    for name, source in sources.items():
        modality = _REGISTRY.get(name)
        if modality is None:
            warnings.warn(f"no modality registered as {name}", stacklevel=2)
            continue
        raw = modality.reader(spark, source)
        if samples is not None and genes is not None and {"sample_id", "chrom", "pos"} <= set(raw.columns):
            raw = files.annotate_variants(raw, samples, genes)
        out[name] = process(raw, modality.rules, modality.transform, name, modality.row_key)
    return out


SUFFIXES = {"neuroimaging": "neuro"}


def merge_processed(results: Mapping[str, Processed], on: str = "patient_id") -> DataFrame:
    """Clinical rows with the other modalities joined to them.

    A column name already taken gets a suffix: ``_neuro`` for images, else the modality's name.
    """
    for name, result in results.items():
        if on not in result.data.columns:
            raise ValueError(f"{name} has no column {on}; absent columns: {result.metadata.get('absent', '')}")
    others = {SUFFIXES.get(name, name): r.data for name, r in results.items() if name != "clinical"}
    return merge_modalities(results["clinical"].data, others, on)


def build_knowledge_base(spark: SparkSession, path: str, guidelines: str | None = None,
                         abstracts: DataFrame | None = None, pages: DataFrame | None = None,
                         dim: int = 256) -> DataFrame:
    """Split, number, embed and append documents to the collection at ``path``; returns the whole collection.

    ``abstracts``: (source, query, text). ``pages``: (source, page, text). The
    first build fits the embedding and saves it beside the collection; later
    builds load it, so all vectors lie in one space, and embed only documents
    whose ids the collection does not hold yet.
    """
    found: list[DataFrame] = []
    if pages is not None:
        chunked = cut_lineage(pages.select("source", "page", recursive_chunks("text").alias("chunks")))
        found.append(documents.number_chunks(chunked, "source", "page"))
    if abstracts is not None:
        pieces = documents.split_abstracts(abstracts, "text", ["source", "query"])
        key = F.concat_ws("_", "source", F.col("ordinal").cast("string"))
        found.append(pieces.select(
            key.alias("id"), "content",
            F.create_map(F.lit("source"), F.col("source"), F.lit("pmid"), F.col("ordinal").cast("string"),
                         F.lit("query"), F.col("query")).alias("metadata")))
    if guidelines is not None:
        chunked = documents.chunk_documents(files.read_guidelines(spark, guidelines))
        found.append(documents.number_chunks(chunked, "source", kind="guideline"))
    if not found:
        raise ValueError("no sources given")
    rows = union_sources(found)
    collection = _collection(spark, path)
    if collection is None:
        rows = cut_lineage(dedup_first(rows, "id", [F.md5("content")]))
        model = documents.fit_embedding(rows, dim=dim)
        model.write().overwrite().save(model_path(path))
    else:
        rows = documents.add_documents(collection, rows)
        model = load_embedding(path)
    documents.embed(rows, model).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def model_path(path: str) -> str:
    """Where the embedding of the collection at ``path`` is saved."""
    return f"{path.rstrip('/')}-embedding"


def load_embedding(path: str) -> PipelineModel:
    return PipelineModel.load(model_path(path))


def search_collection(spark: SparkSession, path: str, texts: Mapping[str, str] | DataFrame, k: int = 5,
                      metadata: Mapping[str, str] | None = None) -> DataFrame:
    """(query_id, rank, doc_id, distance, content): the k documents of the stored collection nearest to each text.

    ``texts`` is a mapping from query id to text, or a table (query_id, content).
    """
    if not isinstance(texts, DataFrame):
        texts = spark.createDataFrame(list(texts.items()), "query_id string, content string")
    collection = spark.read.parquet(path)
    queries = documents.embed(texts.select("query_id", "content"), load_embedding(path)).select("query_id", "embedding")
    hits = documents.vector_search(collection, queries, k, metadata)
    return hits.join(collection.select(F.col("id").alias("doc_id"), "content"), "doc_id").select(
        "query_id", "rank", "doc_id", "distance", "content")


def _collection(spark: SparkSession, path: str) -> DataFrame | None:
    """The collection written so far: the files listed now, so appending does not disturb the read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


@dataclass(frozen=True)
class Trained:
    model: EnsembleModel
    metrics: dict[str, float]
    cv_metrics: dict[str, float] | None
    best_params: dict[str, dict] = field(default_factory=dict)


def train(df: DataFrame, key: str, target: str, drop: Sequence[str] = (), labels: Sequence[int] = (0, 1, 2),
          members=None, weights: Sequence[float] | None = tuple(schemas.ENSEMBLE_WEIGHTS), search: int = 0,
          folds: int = 0, seed: int = 42, model_path: str | None = None, registry: str | None = None,
          version: str = "v1") -> Trained:
    """Split 70/15/15, optionally search and cross-validate, fit, test, save and register."""
    spark = df.sparkSession
    _, features = feature_target(df, target, [key, *drop])
    split = cut_lineage(stratified_split(df.select(key, *features, target), key, target, seed=seed))
    training, val, test = parts(split)
    best: dict[str, dict] = {}
    if search:
        for kind in ("boosted", "leafwise"):
            best[kind], _ = parzen_search(kind, training, val, features, target, labels, trials=search, seed=seed)
    chosen = members or default_members(best)
    classifier = EnsembleClassifier(chosen, "weighted_voting", weights, seed, list(labels))
    cv = None
    if folds:
        cv = cross_validate(classifier, training, features, key, target, folds, seed).first().asDict()
    model = classifier.fit(training, features, target, val)
    metrics = model.evaluate(test, target).first().asDict()
    n_samples = training.count()
    if model_path:
        model.save(model_path)
    if registry:
        params = {"best_params": best, "n_features": len(features), "weights": list(weights) if weights else None}
        row = warehouse.model_metadata(spark, version, "ensemble", metrics, params, n_samples, features)
        warehouse.append_model_metadata(row, registry)
    return Trained(model, metrics, cv, best)


def train_sources(spark: SparkSession, sources: Mapping[str, str], target: str = "treatment_response_encoded",
                  key: str = "patient_id", **options) -> Trained:
    """From files to a tested model: process, merge, then :func:`train` on the numeric columns."""
    merged = cut_lineage(merge_processed(process_all(spark, sources)))
    return train(merged, key, target, drop=["treatment_response", "previous_treatments"], **options)
